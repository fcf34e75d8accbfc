"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort brings equal texts together within each
partition, and a window over whole neighbouring texts finds the groups. The range key is a short prefix and a 64-bit
hash, so a sampled key has a bounded size; whole texts decide equality. One text shuffle.

A text that is more than 1/HOT of all rows is dealt over several partitions by a salt before the sort. There are fewer
than HOT such hashes whatever the data, which bounds what is broadcast; their salted groups are merged at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import write_table

#: A hash is hot from 1/HOT of all rows on: fewer than HOT + 1 hashes can be.
HOT = 4096

#: Characters of the prefix in the range key.
PREFIX = 16


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    keep: which identifier of a group of equal texts stays, "smallest" or "largest". normalise: applied to the text first;
    by default texts are equal only when identical. A null text counts as empty. Null ids form part of their group but
    never stay if the group has another id; a group of null ids alone has keep_id null and kept false. Rows repeated with
    the same id and text count each towards group_size, and each is kept if the id is. An empty table gives an empty
    result. Other columns of docs are not read, whatever their names.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.monotonically_increasing_id().alias("_row")).withColumn("_hash", F.xxhash64("_text"))

    counts = rows.groupBy("_hash").agg(F.count("*").alias("_n"))
    total = docs.count()
    hot = counts.filter(F.col("_n") > max(8, total // HOT)).select("_hash", "_n")
    salted = rows.join(F.broadcast(hot), "_hash", "left").withColumn("_prefix", F.substring("_text", 1, PREFIX))
    # a hot text's rows are dealt over so many salts that each holds about 1/HOT of all rows; by row, as ids may be null or repeated
    parts = F.ceil(F.col("_n") / F.lit(max(8, total // HOT)))
    salted = salted.withColumn(
        "_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), parts)).cast("long")
    )
    placed = salted.repartitionByRange("_prefix", "_hash", "_salt")
    same = Window.partitionBy("_prefix", "_hash", "_salt", "_text")
    grouped = placed.select(
        "_id",
        "_hash",
        F.col("_n").isNotNull().alias("_hot"),
        best("_id").over(same).alias("_best"),
        F.count(F.lit(1)).over(same).alias("_size"),
        # a hot group has one row per salt that carries the text on, for the merge
        F.when(F.col("_n").isNotNull() & (F.row_number().over(same.orderBy("_id")) == 1), F.col("_text")).alias("_sample"),
        F.sha2(F.col("_text"), 256).alias("text_sha256"),
        "_salt",
    )
    grouped = write_table(grouped, "content-sort")
    merged = grouped.filter(F.col("_sample").isNotNull()).groupBy("_sample").agg(
        best("_best").alias("_all_best"), F.sum("_size").alias("_all_size"), F.first("text_sha256").alias("text_sha256")
    )
    merged = merged.select("text_sha256", "_all_best", "_all_size", F.lit(True).alias("_hot"))
    out = grouped.drop("_sample").join(F.broadcast(merged), ["text_sha256", "_hot"], "left")
    keep_id = F.when(F.col("_hot"), F.col("_all_best")).otherwise(F.col("_best"))
    return out.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_all_size", "_size").cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == keep_id, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another id keeps; columns as in docs.

    Rows with a null id, and rows that repeat both id and text of a kept row, stay.
    """
    found = exact_dedup(docs, id_col, text_col, keep=keep)
    gone = found.filter(F.col(id_col).isNotNull() & ~F.col("kept"))
    gone = gone.select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (sha == gone["_sha"]), "left_anti")
