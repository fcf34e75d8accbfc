"""Blocks of plain text: from a table of documents, or from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a text is cut into lines.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Line ends of plain text files alone.
NEWLINES = "\r\n|[\n\r]"


def lines(text: Column, ends: str = LINE_ENDS) -> Column:
    """Lines that aren't blank, as array<struct<line, text>>; line counts all lines from 1. A blank text is one line as it is."""
    every = F.transform(F.split(text, ends), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    full = F.filter(every, lambda x: F.trim(F.translate(x["text"], "\t　", "  ")) != "")
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.struct(F.lit(0).alias("line"), text.alias("text"))))


def full_text(text: Column) -> Column:
    """What is analysed: the lines that aren't blank, joined by single line ends."""
    return F.array_join(F.transform(lines(text), lambda x: x["text"]), "\n")


def as_read(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text that their blocks make: places found in it are those of plans.report.block_offsets(blocks_from_documents(docs))."""
    return docs.withColumn(text_col, full_text(F.col(text_col)))


def blocks_from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: str = LINE_ENDS) -> DataFrame:
    """One row per line that isn't blank: doc_id, block_index, text, block_type, location, page. A null text has none. ends: where lines end."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines(F.col(text_col), ends)).alias("block_index", "b")).filter("b.text is not null")
    place = F.when(F.col("b.line") > 0, F.concat(F.lit("第 "), F.col("b.line").cast("string"), F.lit(" 行"))).otherwise(F.lit("全文"))
    return rows.select("doc_id", "block_index", "b.text", F.lit("line").alias("block_type"), place.alias("location"), F.lit(None).cast("int").alias("page"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """.txt and .md files below a path: path, doc_id (hash of the path), file_type, sha256, text (UTF-8)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.filter(kind.isin("txt", "md", "markdown"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), kind.alias("file_type"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))


#: Kinds of files that are read, by extension.
KINDS = {"docx": "docx", "txt": "text", "md": "text", "markdown": "text"}


def list_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Files below a path: path, doc_id (hash of the path), kind (docx or text), sha256, content, error.

    Files of other kinds, old .doc and PDF too, have an error; strict: they raise it when they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[extension]
    advice = F.when(extension == "doc", F.lit("save it as .docx first")).otherwise(F.lit("only .docx, .txt, .md and .markdown are read"))
    error = F.when(kind.isNull(), F.concat(F.lit("can't read "), F.col("path"), F.lit(": "), advice))
    if strict:
        error = F.when(kind.isNull(), F.raise_error(error)).otherwise(F.lit(None).cast("string"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), kind.alias("kind"), F.sha2("content", 256).alias("sha256"), "content", error.alias("error"))


def output_name(path: Column, suffix: str = "_脱敏") -> Column:
    """The name of a rewritten file: the suffix before the extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"^(.+?)(\.[^.]*)?$", f"$1{suffix}$2")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Allowed values (value), one per line; blank lines and lines that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.filter((F.col("value") != "") & ~F.startswith(F.col("value"), F.lit("#")))
