"""The whole analysis of a table of documents: detect, resolve, group, number. One pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.operators import rowwise
from inkveil.operators.detect import detect, spread
from inkveil.operators.resolve import candidates, resolve
from inkveil.registry import Settings
from inkveil.sources.stored import shared_path, stored

__all__ = ["analyse", "shared_path", "stored"]

#: Columns of an analysis beside doc_id.
COLUMNS = tuple(rowwise.COLUMNS)


def analyse(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One row per document: doc_id, raw, norm, index, spans (all found), kept (disjoint), candidates (with numbers), or those of columns.

    Built-in rules run row by row in Python (operators.rowwise); with rules or detectors of users the same is done by columns.
    """
    settings = settings or Settings()
    if rowwise.supported(settings):
        rows = docs.select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("raw"))
        return rowwise.analyse_rows(spread(rows), settings, columns)
    rows = detect(docs, settings, id_col, text_col)
    rows = resolve(rows, settings) if "kept" in columns or "candidates" in columns else rows
    rows = candidates(rows, settings) if "candidates" in columns else rows
    return rows.select("doc_id", *columns, *(["failures"] if settings.detectors else []))
