"""Rewriting: replace spans of a text, and put originals back in place of placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.arrays import between, cut, let
from inkveil.functions.spans import matches
from inkveil.operators.entities import PLACEHOLDER
from inkveil.sources.stored import stored


class SelectionError(ValueError):
    """A selected place isn't among the places found."""


def splice(text: Column, ops: Column) -> Column:
    """The text with disjoint ops (start, end, value, replacement, in order of start) carried out.

    An op whose value isn't what stands at its place is left out. Returns struct<text, applied, skipped>.
    """

    def spliced(good: Column, parts: Column) -> Column:
        end = lambda i: F.coalesce(F.get(good, i)["end"], F.lit(0))
        each = F.transform(good, lambda o, i: F.concat(between(parts, text, end(i - 1), o["start"]), o["replacement"]))
        whole = F.array_join(F.concat(each, F.array(F.substring(text, end(F.size(good) - 1) + 1, F.length(text)))), "")
        return F.struct(whole.alias("text"), F.size(good).alias("applied"), (F.size(ops) - F.size(good)).alias("skipped"))

    fits = lambda parts: F.filter(ops, lambda o: between(parts, text, o["start"], o["end"]) == o["value"])
    none = F.struct(text.alias("text"), F.lit(0).alias("applied"), F.lit(0).alias("skipped"))
    done = let(cut(text), lambda parts: let(fits(parts), lambda good: spliced(good, parts)))
    return F.when(text.isNotNull() & (F.size(ops) > 0), done).otherwise(none)


def ops_of(candidates: Column, replacement: str) -> Column:
    """Ops of all occurrences in order; replacement: a field of the candidate, "masked" or "placeholder"."""
    each = lambda c: F.transform(c["occurrences"], lambda o: F.struct(o["raw_start"].alias("start"), o["raw_end"].alias("end"), o["text"].alias("value"), c[replacement].alias("replacement")))
    return F.array_sort(F.flatten(F.transform(candidates, each)))


def redact(found: DataFrame, replacement: str = "placeholder") -> DataFrame:
    """candidates() rows to doc_id, text, applied, skipped, with all places replaced. No shuffle."""
    done = let(ops_of(F.col("candidates"), replacement), lambda ops: splice(F.col("raw"), ops))
    return found.select("doc_id", done.alias("r")).select("doc_id", "r.text", "r.applied", "r.skipped")


def annotate(found: DataFrame) -> DataFrame:
    """doc_id and text with each place as <<TYPE#cid|confidence|masked>>; confidence with three decimals."""
    tag = lambda c: F.concat(F.lit("<<"), c["type_id"], F.lit("#"), c["cid"].cast("string"), F.lit("|"), F.format_string("%.3f", c["confidence"]), F.lit("|"), c["masked"], F.lit(">>"))
    each = lambda c: F.transform(c["occurrences"], lambda o: F.struct(o["raw_start"].alias("start"), o["raw_end"].alias("end"), o["text"].alias("value"), tag(c).alias("replacement")))
    ops = F.array_sort(F.flatten(F.transform(F.col("candidates"), each)))
    return found.select("doc_id", let(ops, lambda o: splice(F.col("raw"), o))["text"].alias("text"))


def mapping_items(found: DataFrame) -> DataFrame:
    """One row per occurrence: what stood where, and the placeholder and mask that stand for it."""
    each = found.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c", F.explode("c.occurrences").alias("o"))
    fields = ("type_id", "label", "severity", "category")
    return each.select(
        "doc_id", *[F.col(f"c.{f}") for f in fields], F.col("o.text").alias("original"), F.col("c.value").alias("entity_value"), "c.placeholder", "c.number", "c.masked",
        F.col("o.raw_start").alias("start"), F.col("o.raw_end").alias("end"), "c.confidence", "c.cid",
    )


def select_items(items: DataFrame, selection: DataFrame, strict: bool = True) -> DataFrame:
    """Items whose (doc_id, type_id, start, end) a row of selection has. strict: raise SelectionError for one that none has.

    The check needs the items before the result: strict stores them, so that what they come from runs once.
    """
    items = stored(items, "items") if strict else items
    keys = ["doc_id", "type_id", "start", "end"]
    chosen = selection.select(*keys).distinct()
    if strict and (lost := chosen.join(items, keys, "left_anti").limit(1).collect()):
        raise SelectionError(f"no such place: {lost[0].asDict()}")
    return items.join(chosen, keys, "left_semi")


def apply_items(docs: DataFrame, items: DataFrame, replacement: str = "placeholder", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' texts with mapping items carried out: doc_id, text, applied, skipped; documents without items too."""
    ops = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("original").alias("value"), F.col(replacement).alias("replacement")))).alias("ops"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw")).join(ops.hint("merge"), "doc_id", "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,replacement:string>>")
    return rows.select("doc_id", splice(F.col("raw"), F.coalesce("ops", none)).alias("r")).select("doc_id", "r.text", "r.applied", "r.skipped")


def mapping_sequences(items: DataFrame) -> DataFrame:
    """For each placeholder of a document its originals in the order of the text."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("start", "original"))), lambda x: x["original"])
    return items.groupBy("doc_id", "placeholder").agg(seq.alias("originals"))


def placeholders_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per placeholder in a text: doc_id, start, placeholder, nth (of its kind in the document, from 1)."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(matches(F.col(text_col), PLACEHOLDER, F.contains(F.col(text_col), F.lit("#")))).alias("m"))
    found = found.select("doc_id", F.col("m.start").alias("start"), F.col("m.m").alias("placeholder"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "placeholder").orderBy("start")))


def restore(redacted: DataFrame, items: DataFrame) -> DataFrame:
    """Put originals back: the k-th place of a placeholder gets its k-th original in the order of the text.

    redacted: doc_id, text. items: doc_id, placeholder, original, start. Returns doc_id, text, restored, excess: places of a
    known placeholder beyond its originals. A document with excess keeps its text and restores nothing. Bracketed text that
    isn't a placeholder of the document stays.
    """
    nth = Window.partitionBy("doc_id", "placeholder").orderBy("start")
    originals = items.select("doc_id", "placeholder", "original", F.row_number().over(nth).alias("nth"), F.lit(True).alias("known"))
    kinds = items.select("doc_id", "placeholder").distinct()
    places = placeholders_in(redacted).join(kinds.hint("merge"), ["doc_id", "placeholder"])
    places = places.join(originals.hint("merge"), ["doc_id", "placeholder", "nth"], "left")
    op = F.struct("start", (F.col("start") + F.length("placeholder")).alias("end"), F.col("placeholder").alias("value"), F.coalesce("original", "placeholder").alias("replacement"))
    ops = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(op)).alias("ops"), F.count_if(F.col("known").isNull()).alias("excess"))
    rows = redacted.select("doc_id", "text").join(ops.hint("merge"), "doc_id", "left")
    none = F.array().cast("array<struct<start:int,end:int,value:string,replacement:string>>")
    use = F.when(F.col("excess") > 0, none).otherwise(F.coalesce("ops", none))
    done = rows.select("doc_id", let(use, lambda o: splice(F.col("text"), o)).alias("r"), F.coalesce("excess", F.lit(0)).alias("excess"))
    return done.select("doc_id", "r.text", F.col("r.applied").alias("restored"), "excess")


def missing_placeholders(redacted: DataFrame, items: DataFrame) -> DataFrame:
    """Placeholders of the mapping (doc_id, placeholder) that a document's text has nowhere."""
    return items.select("doc_id", "placeholder").distinct().join(placeholders_in(redacted).hint("merge"), ["doc_id", "placeholder"], "left_anti")


def unmapped_placeholders(redacted: DataFrame, items: DataFrame) -> DataFrame:
    """Placeholders in a document's text (doc_id, placeholder) that its mapping lacks. Both sides are as large as the texts: neither is broadcast."""
    return placeholders_in(redacted).join(items.select("doc_id", "placeholder").hint("merge"), ["doc_id", "placeholder"], "left_anti").select("doc_id", "placeholder")
