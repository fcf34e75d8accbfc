"""Reports over analysed documents, as tables and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.arrays import cut, let
from inkveil.functions.boxes import box_of
from inkveil.functions.text import kwic_at
from inkveil.registry import Settings

# Names of severities, the columns of the CSV report.
SEVERITY_LABELS = {"high": "高", "medium": "中", "low": "低"}
CSV_COLUMNS = ("序号", "类型", "类型名称", "归类", "严重度", "原文值", "脱敏预览", "置信度", "出现次数", "位置", "页码", "上下文", "判定依据")


def candidate_table(found: DataFrame) -> DataFrame:
    """One row per candidate."""
    return found.select("doc_id", F.inline("candidates"))


def occurrence_table(found: DataFrame, context_chars: int = 30) -> DataFrame:
    """One row per occurrence, with its context; nth counts a candidate's occurrences from 1 in the order taken."""

    def told(c: Column, parts: Column) -> Column:
        seen = lambda o: F.struct(o["raw_start"].alias("start"), o["raw_end"].alias("end"), o["text"].alias("text"), kwic_at(parts, F.col("raw"), o["raw_start"], o["raw_end"], context_chars).alias("context"))  # noqa: E501, E731
        return F.struct(c.alias("c"), F.transform(c["occurrences"], seen).alias("o"))

    each = let(F.when(F.size("candidates") > 0, cut(F.col("raw"))), lambda parts: F.transform("candidates", lambda c: told(c, parts)))
    rows = found.select("doc_id", F.inline(each)).select("doc_id", "c", F.posexplode("o").alias("i", "o"))
    return rows.select("doc_id", "c", (F.col("i") + 1).alias("nth"), "o.start", "o.end", "o.text", "o.context")


def by_type(found: DataFrame) -> DataFrame:
    """Occurrences of each type over all documents, most frequent first; pre-aggregated before the shuffle."""
    return candidate_table(found).groupBy("type_id").agg(F.sum("count").alias("occurrences")).orderBy(F.desc("occurrences"), "type_id")


def by_severity(found: DataFrame) -> DataFrame:
    return candidate_table(found).groupBy("severity").agg(F.sum("count").alias("occurrences"))


def summary(found: DataFrame) -> DataFrame:
    """For each document: candidate_types (the number of candidates), occurrences, chars."""
    total = F.aggregate("candidates", F.lit(0), lambda a, c: a + c["count"])
    return found.select("doc_id", F.size("candidates").alias("candidate_types"), total.alias("occurrences"), F.length("raw").alias("chars"))


def csv_report(found: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The CSV report: one row per occurrence, reasons on a candidate's first row only.

    blocks: start, end, location, page of blocks by doc_id (block_offsets), of the text that was analysed; without it, or for
    a place in no block, the location is empty.
    """
    rows = occurrence_table(found)
    if blocks is not None:
        rows = in_block(rows, blocks)
    else:
        rows = rows.withColumns({"location": F.lit(""), "page": F.lit(None).cast("int")})
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY_LABELS.items() for x in kv])[F.col("c.severity")]
    values: list[Column] = [
        F.col("c.cid"), F.col("c.type_id"), F.col("c.label"), F.col("c.category"), severity, F.col("c.value"), F.col("c.masked"), F.col("c.confidence"), F.col("c.count"),
        F.coalesce("location", F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")), F.col("context"), F.when(F.col("nth") == 1, F.array_join("c.reasons", "；")).otherwise(""),
    ]
    return rows.select("doc_id", *[v.alias(n) for v, n in zip(values, CSV_COLUMNS, strict=True)])


def block_offsets(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_index, text, …) with start and end in the full text: texts joined by single line ends."""
    order = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.rtrim(F.col("text"), F.lit("\n")))
    start = F.coalesce(F.sum(size + 1).over(order), F.lit(0)).cast("long")
    return blocks.withColumn("start", start).withColumn("end", F.col("start") + size)


def in_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (doc_id, start) with the block that each starts in: a range join by document, as an equality join and a filter.

    blocks and rows must be of one text: that of sources.text.as_read(), or documents_of() for files. A row that starts in no
    block (or whose document has none) stays, with nulls. Blocks of pages (sources.layout) give their word_boxes too.
    There are as many blocks as rows, whatever size the optimiser takes them for, so they aren't broadcast.
    """
    more = ["word_boxes"] if "word_boxes" in blocks.columns else []
    b = blocks.select(F.col("doc_id").alias("_doc"), "block_index", "location", "page", "block_type", F.col("start").alias("block_start"), F.col("end").alias("block_end"), *more)
    hit = (rows["doc_id"] == b["_doc"]) & (rows["start"] >= b["block_start"]) & (rows["start"] <= b["block_end"])
    return rows.join(b.hint("merge"), hit, "left").drop("_doc")


def top(found: DataFrame, n: int = 20) -> DataFrame:
    """The n first candidates of each document."""
    return found.select("doc_id", F.inline(F.slice("candidates", 1, n)))


def review_types(found: DataFrame) -> DataFrame:
    """For each document the types found, with label, category, severity and count."""
    return candidate_table(found).groupBy("doc_id", "type_id", "label", "category", "severity").agg(F.sum("count").alias("count"))


def mapping_entities(items: DataFrame) -> DataFrame:
    """For each entity of a document its placeholder, first original, and occurrences."""
    return items.groupBy("doc_id", "type_id", "label", "number", "placeholder").agg(F.min_by("original", "start").alias("original"), F.count("*").alias("occurrences"))


def _totals(field: str) -> Column:
    """A map of a field's values to the occurrences of candidates that have them, most frequent first."""
    values = F.array_distinct(F.transform("candidates", lambda c: c[field]))

    def total(v: Column) -> Column:
        return F.aggregate(F.filter("candidates", lambda c: c[field] == v), F.lit(0), lambda a, c: a + c["count"])

    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-total(v)).alias("n"), i.alias("i"), v.alias("v"))))
    return F.map_from_entries(F.transform(ranked, lambda x: F.struct(x["v"], -x["n"])))


def _engine() -> Column:
    return F.struct(F.lit("inkveil").alias("name"), F.lit("2").alias("version"), F.lit("offline").alias("mode"))


def report_json(
    found: DataFrame,
    blocks: DataFrame | None = None,
    settings: Settings | None = None,
    warnings: DataFrame | None = None,
    generated_at: str | None = None,
) -> DataFrame:
    """The report of each document as JSON: doc_id and report.

    blocks: as in csv_report; without them occurrences have no block; with word_boxes they have the box around their words. warnings: doc_id, warnings. generated_at: a time stamp,
    the same for all documents of a job; by default the time of the query. Documents without candidates have empty items.
    """
    settings = settings or Settings()
    rows, box = occurrence_table(found), F.lit(None).cast("array<double>")
    if blocks is not None:
        rows = in_block(rows, blocks)
        if "word_boxes" in rows.columns:
            rows = rows.withColumn("bbox", box_of(F.col("word_boxes"), F.col("start") - F.col("block_start"), F.col("end") - F.col("block_start"))).drop("word_boxes")
            box = F.col("bbox")
        local = F.when(F.col("block_index").isNotNull(), F.array(F.col("start") - F.col("block_start"), F.col("end") - F.col("block_start")))
        sizes = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    else:
        kinds = {"page": "int", "location": "string", "block_type": "string", "block_index": "int"}
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
        local, sizes = F.lit(None).cast("array<int>"), None
    place = F.struct(
        "page", "location", "block_type", F.array("start", "end").alias("offset"), "block_index", local.alias("local_offset"),
        box.alias("bbox"), "context", "text",
    )
    each = rows.groupBy("doc_id", F.col("c.cid").alias("id")).agg(F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("nth", place.alias("o")))).alias("o"))
    fields = ("label", "category", "severity", "value", "masked", "confidence", "count", "reasons")
    item = F.struct("id", F.col("c.type_id").alias("type"), *[F.col(f"c.{f}") for f in fields], F.transform("o", lambda x: x["o"]).alias("occurrences"))
    items = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    total = F.aggregate("candidates", F.lit(0), lambda a, c: a + c["count"])
    rows = found.select("doc_id", "raw", "candidates").join(items.hint("merge"), "doc_id", "left")
    rows = rows.join(sizes.hint("merge"), "doc_id", "left") if sizes is not None else rows.withColumn("blocks", F.lit(None).cast("long"))
    rows = rows.join(warnings, "doc_id", "left") if warnings is not None else rows.withColumn("warnings", F.array().cast("array<string>"))
    body = F.struct(
        F.lit("contract-sensitive-candidates/v1").alias("schema"),
        _engine().alias("engine"),
        (F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("generated_at"),
        F.struct(F.sha2("raw", 256).alias("sha256"), "blocks", F.length("raw").alias("chars")).alias("source"),
        F.struct(
            F.lit(float(settings.min_confidence)).alias("min_confidence"), F.lit(settings.min_severity).alias("min_severity"),
            F.array(*[F.lit(t) for t in sorted(set(settings.type_map()) - set(settings.active()))]).cast("array<string>").alias("disabled_types"),
        ).alias("settings"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.struct(F.size("candidates").alias("candidate_types"), total.alias("occurrences"), _totals("type_id").alias("by_type"), _totals("severity").alias("by_severity")).alias("summary"),
        F.coalesce("items", F.from_json(F.lit("[]"), items.schema["items"].dataType)).alias("items"),
    )
    return rows.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def mapping_json(items: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """The mapping of each document as JSON: doc_id and mapping, items in the order of the text, entities by type and number.

    blocks: as in csv_report; items then have block_index, block_location and page.
    """
    if blocks is not None:
        items = in_block(items, blocks).withColumnRenamed("location", "block_location")
    else:
        kinds = {"page": "int", "block_index": "int", "block_location": "string"}
        items = items.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    fields = ("label", "severity", "original", "entity_value", "placeholder", "masked", "confidence", "category", "page", "block_index", "block_location")
    item = F.struct(F.col("start"), F.col("end"), F.col("type_id").alias("type"), *[F.col(c) for c in fields])
    grouped = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    entity = F.struct(F.col("type_id").alias("type"), "number", "label", "placeholder", "occurrences")
    entities = mapping_entities(items).groupBy("doc_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    body = F.struct(F.lit(1).alias("version"), F.lit("contract-mapping/v1").alias("schema"), _engine().alias("engine"), "entities", "items")
    return grouped.join(entities.hint("merge"), "doc_id").select("doc_id", F.to_json(body).alias("mapping"))


MAPPING_SCHEMA = "version int, schema string, items array<struct<start:int,end:int,type:string,label:string,severity:string,original:string,entity_value:string,placeholder:string,masked:string,confidence:double>>"


def read_mapping(mappings: DataFrame) -> DataFrame:
    """mapping_json() rows back to items; a mapping of another schema raises an error when it is read."""
    parsed = mappings.select("doc_id", F.from_json("mapping", MAPPING_SCHEMA).alias("m"))
    ok = F.col("m.schema").isNull() | F.startswith(F.col("m.schema"), F.lit("contract-mapping/"))
    items = F.when(ok, F.col("m.items")).otherwise(F.raise_error(F.concat(F.lit("unknown mapping schema: "), F.col("m.schema"))))
    return parsed.select("doc_id", F.inline(items)).withColumnRenamed("type", "type_id")
