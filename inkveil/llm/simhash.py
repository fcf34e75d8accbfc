"""SimHash near-dedup by covering locality-sensitive hashing.

Each of the 64 bit positions has a class from 1 to 7, read as a vector over GF(2) in three dimensions. Table v (1 to 7)
keeps the bits whose class has an odd product with v, about 37 of 64. Two bits that differ lie in some table's dropped
part both, as two linear conditions in three dimensions have a solution other than zero: so each pair of fingerprints
within two bits collides in some table, without exception.

Equal fingerprints are one class from the start. Buckets of a few classes are compared directly. In larger ones each class
names itself and its 64 neighbours at one bit; classes within two bits share such a name, and at most 65 distinct classes
share one: a bucket costs work in proportion to its size, however many near copies there are, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import components, slices, write_table

#: Largest difference in bits that links; the tables below are made for it.
RADIUS = 2

#: Words of a shingle in the fingerprint.
SHINGLE_WORDS = 3

#: Classes up to which a bucket's classes are compared directly.
SMALL_BUCKET = 32

_SIGN = 1 << 63


def _signed(x: int) -> int:
    return (x ^ _SIGN) - _SIGN


def table_masks() -> list[int]:
    """The seven masks, as signed 64-bit numbers."""
    return [_signed(sum(1 << b for b in range(64) if bin((b % 7 + 1) & v).count("1") % 2)) for v in range(1, 8)]


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    found = text.lower().split()  # bytes: A-Z only, and ASCII spaces 0x20, 0x09 to 0x0D
    if not found:
        return 0
    joined, hash_of = b" ".join(found), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    ones, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, n, step):
        h = [hash_of(joined[a:b], 42) for a, b in zip(starts[at : at + step], ends[at : at + step], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The id and fp (signed long) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = [_signed(fingerprint(t, words)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, fp long").withColumnRenamed("_id", id_col)


def _class_links(classes: DataFrame) -> DataFrame:
    """Links between classes (rep, fp) within RADIUS bits, enough of them to connect all that are; a, b: reps."""
    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(table_masks())])
    keys = classes.select("rep", "fp", F.explode(tables).alias("x")).select("rep", "fp", "x.t", "x.k")
    sizes = write_table(keys.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = write_table(keys.join(sizes, ["t", "k"]), "members")

    small = members.filter(F.col("n") <= SMALL_BUCKET)
    left = small.select("t", "k", F.col("rep").alias("a"), F.col("fp").alias("x"))
    right = small.select("t", "k", F.col("rep").alias("b"), F.col("fp").alias("y"))
    near = (left["t"] == right["t"]) & (left["k"] == right["k"]) & (F.col("x") < F.col("y"))
    pairs = left.join(right, near & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS)).select("a", "b")

    large = members.filter(F.col("n") > SMALL_BUCKET).select("rep", "fp").distinct()
    names = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    named = large.select("rep", F.explode(names).alias("name")).groupBy("name").agg(F.collect_list("rep").alias("reps"))
    stars = named.filter(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    return pairs.unionByName(stars).filter("a <> b").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Links between ids (a, b) of fingerprints within RADIUS bits, enough of them to connect all that are; rows with a null id have none."""
    fps = write_table(fingerprints(docs, id_col, text_col, words).filter(F.col(id_col).isNotNull()), "fingerprints")
    classes = write_table(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    equal = fps.join(classes, "fp").select(F.col("rep").alias("a"), F.col(id_col).alias("b")).filter("a <> b")
    return equal.unionByName(_class_links(classes))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (smallest id that links reach), kept.

    Null and empty texts, and texts of spaces alone, have fingerprint zero, which links like any other. A text of fewer
    words than a shingle is one shingle. Repeated rows are rows of their own and share their id's fate. Rows with a null
    id have the component of their fingerprint if another row has that fingerprint, else none; they are never kept.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    fps = write_table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = write_table(fps.groupBy("fp").agg(F.min(id_col).alias("rep")).filter(F.col("rep").isNotNull()), "classes")
    found = components(_class_links(classes))
    known = classes.join(found, classes["rep"] == found["node"], "left")
    known = write_table(known.select("fp", F.coalesce("component", "rep").alias("component_id")), "components")
    out = fps.join(known, "fp", "left")
    return out.select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest id; columns as in docs."""
    gone = simhash_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
