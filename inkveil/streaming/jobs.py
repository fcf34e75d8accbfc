"""Streams: files as they arrive, each analysed once, and counts of events by window of time.

Numbers of entities are a document's own, so the analysis has no state. State is kept for the hashes of files seen, within the time that is waited for,
and for open windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inkveil.plans.analysis import analyse
from inkveil.registry import Settings
from inkveil.sources.docx import word_texts
from inkveil.sources.text import KINDS, as_read

#: Bytes of a file that is read; larger ones have an error.
MAX_FILE_BYTES = 100 << 20

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Documents from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 100, wait: str = "1 day", most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Raw files that appear below a folder: path, arrived, doc_id (hash of the path), kind, sha256, content, error.

    A file whose content came before, within the time that is waited for by the files' times, is left out, whatever its name. Files
    that are too large, which aren't opened, or of a kind that isn't read have an error and no content; they aren't compared.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]
    large = F.col("length") > most_bytes
    error = F.when(kind.isNull(), F.lit("not of a kind that is read")).when(large, F.lit(f"more than {most_bytes} bytes"))
    content = F.when(error.isNull(), F.col("content"))
    rows = files.select("path", F.col("modificationTime").alias("arrived"), F.xxhash64("path").alias("doc_id"), kind.alias("kind"), content.alias("content"), error.alias("error"))
    # files with an error are told apart by their paths
    sha = F.when(F.col("error").isNull(), F.sha2("content", 256))
    rows = rows.withColumns({"sha256": sha, "_same": F.coalesce(sha, F.col("path"))}).withWatermark("arrived", wait)
    return rows.dropDuplicatesWithinWatermark(["_same"]).select("path", "arrived", "doc_id", "kind", "sha256", "content", "error")


def texts_of(files: DataFrame) -> DataFrame:
    """stream_files() rows, or those of sources.text.list_files(), with text in place of content, as the analysis reads it: Word files by their paragraphs.

    A file that can't be read has an error.
    """
    plain = as_read(files.filter("kind = 'text' or error is not null").withColumn("text", F.col("content").cast("string"))).drop("content")
    word = word_texts(files.filter("kind = 'docx' and error is null"))
    return plain.unionByName(word.select(*plain.columns))


def stream_items(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per candidate of a stream of documents. Numbers are a document's own, so there is no state."""
    return analyse(docs, settings, columns=("candidates",)).select("doc_id", F.inline("candidates"))


def without_repeats(docs: DataFrame, time_col: str, wait: str = "1 day", text_col: str = "text") -> DataFrame:
    """A stream of documents without those whose text came before within the time that is waited for."""
    return docs.withColumn("sha256", F.sha2(text_col, 256)).withWatermark(time_col, wait).dropDuplicatesWithinWatermark(["sha256"])


def write_items(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet what has arrived by now, each file once, and end."""
    return items.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyse_files(files: DataFrame, out: str, checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Analyse stream_files() as they arrive, by now, and end: candidates to out/items, files with their errors to out/files.

    Each batch writes folders of its own and replaces what a failed attempt at it left, so a restart neither loses nor repeats rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        texts = texts_of(rows).persist()
        try:
            found = analyse(texts.filter("error is null"), settings, columns=("candidates",))
            found.select("doc_id", F.inline("candidates")).write.mode("overwrite").parquet(f"{out}/items/batch={number}")
            texts.select("path", "doc_id", "sha256", "error").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        finally:
            texts.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str = "ts", by: tuple[str, ...] = ("event_type",), window: str = "1 day", wait: str = "2 days", found: Column | None = None) -> DataFrame:
    """For each window of time and key: window_start, keys, events, and hits, the events for which found holds (by default those with a value).

    On a stream, windows are given out once the watermark has passed their ends; later events are left out. On a table all count.
    """
    hit = F.col("value").isNotNull() if found is None else found
    rows = events
    if events.isStreaming:  # a watermark needs a time with a zone: a time without one is taken in the session's
        rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, wait)
    counted = rows.groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("events"), F.count_if(hit).alias("hits"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "events", "hits")
