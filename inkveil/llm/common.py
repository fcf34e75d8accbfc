"""Helpers that several operators share: tables in the shared folder, links to components, words of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles; bounds a task's memory whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20

#: A key is hot from 1/HOT of all rows on: fewer than HOT keys can be.
HOT = 4096

#: Bytes of the batches that Python functions get within scratch(), about: JVM and worker hold several of them beside the heap, in buffers that double.
BATCH_BYTES = 4 << 20

#: Rows of a few numbers that a file of a table on the way has, about.
FILE_ROWS = 500_000

#: The ASCII bytes between words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return base.rstrip("/")


@cache
def _local_dir() -> str:
    """One folder of this process, for local mode; the session's settings stay as they are."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files once it has ended, the size of batches, and the tables of each scratch() around, outermost first.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def write_table(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: df as Parquet in the shared folder, read back. It survives lost executors and has a known size.

    Within scratch() the table goes at its end.
    """
    return _written(df, tag, _SCRATCH.get())


def kept_table(df: DataFrame, tag: str) -> DataFrame:
    """write_table() for what a scratch() results in: it stays until the next one around ends."""
    return _written(df, tag, _SCRATCH.get()[:-1])


def _written(df: DataFrame, tag: str, scopes: tuple[list[str], ...]) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, which has so many rows at most, in partitions of about each rows, but not fewer than there are cores.

    A small table that is written as many files costs a task and two files for each of them, and again where it is read.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except (AttributeError, PySparkException):  # a remote session doesn't tell: the partitions stay
        return df
    return df.coalesce(max(cores, -(-rows // each)))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Disk is given back: tables written within go at the end, shuffle files of each query once it has ended. Batches are small, if nobody has set their size.

    What is made of such tables must be a kept_table() before. A remote session has no file system, so its tables stay.
    """
    before, seen = {k: spark.conf.get(k, None) for k in (_SHUFFLES_GO, _BATCH_SIZE)}, []
    spark.conf.set(_SHUFFLES_GO, "true")
    spark.conf.set(_BATCH_SIZE, before[_BATCH_SIZE] or str(BATCH_BYTES))
    token = _SCRATCH.set((*_SCRATCH.get(), seen))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        for path in seen if hasattr(spark, "_jsparkSession") else []:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """left with the columns of right, which has a row for each key at most; inner.

    Keys with more than 1/HOT of all rows of left, of which there are fewer than HOT, are joined by broadcasting right's rows
    of them: no task gets all rows of a key. counts: keys with the number n of their rows in left, if known.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    rows = left.count()
    bound = max(10_000, rows // HOT)
    hot = write_table(few_files(counts.filter(F.col("n") > bound).select(*keys), rows), "hot")
    if hot.isEmpty():
        return left.join(right, keys)
    few = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys)
    return few.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys))


def unit_hash(*columns: Column | str) -> Column:
    """A number in [0, 1) from the columns, the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11)) / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n rows, the same in every run: those of the least hashes of columns. Rows that are equal in them count once, and so can't fill the sample.

    Hashes alone are shuffled, summed up in each task first; rows move only if they are chosen.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*columns))
    least = hashed.select("_hash").distinct().orderBy("_hash").limit(n).agg(F.max("_hash")).first()[0]
    if least is None:
        return rows.limit(0)
    chosen = hashed.filter(F.col("_hash") <= least).groupBy("_hash").agg(*[F.first(c).alias(c) for c in rows.columns])
    return chosen.drop("_hash")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Links (a long, b long) to (node, component): the smallest node that links reach.

    Alternating large and small stars; each round is two aggregations and two joins by key over the links, so hot nodes
    are pre-aggregated before a shuffle and the joins read written tables, which lets adaptive execution split hot keys.
    Null ends and self links are left out; nodes without links have no row. An empty input gives an empty result.
    No table of a round has more rows than there are links, so few links are in few files.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = write_table(edges.filter("hi > lo").distinct(), "links")
    state = _checksum(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        written = lambda df, tag, n=state[0]: write_table(few_files(df, n), tag)
        least = written(edges.groupBy("hi").agg(F.min("lo").alias("to")), "least")
        large = edges.join(least.select(F.col("hi").alias("lo"), "to"), "lo", "left")
        large = written(large.select("hi", F.coalesce("to", "lo").alias("lo")).distinct(), "large")
        least = written(large.groupBy("hi").agg(F.min("lo").alias("to")), "least")
        moved = large.join(least, "hi").filter("lo > to").select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
        edges = written(least.select("hi", F.col("to").alias("lo")).unionByName(moved).distinct(), "links")
        before, state = state, _checksum(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"no fixed point of the components in {max_rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in runs of rows with about so many bytes of text, and their UTF-8 texts (null: empty)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.array([0 if x is None else x for x in pc.binary_length(column).to_pylist()], np.int64)
    ends = np.cumsum(sizes + 64)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        texts = column.slice(start, stop - start).cast(pa.binary()).to_pylist()
        yield batch.slice(start, stop - start), [x or b"" for x in texts]
        start = stop


def give_back() -> None:
    """At the end of a task: free memory of the worker, which waits for further tasks, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


class Words:
    """The words of several texts in one byte buffer: each text stands between single spaces. gaps: the bytes between words.

    data: the bytes, a space first and after each text. start, end: of each word. row: the text of each word.
    first: the index of each text's first word, and at last the number of words.
    """

    def __init__(self, texts: list[bytes], gaps: np.ndarray = IS_SPACE):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = gaps[self.data]
        self.start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = 1 + np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal first columns, over batches that are sorted by them; columns as numpy arrays."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        ids = [table.column(k).to_numpy() for k in range(keys)]
        turn = np.flatnonzero(np.any([np.diff(c) != 0 for c in ids], axis=0)) + 1
        if len(turn):
            whole = {c: table.column(c).slice(0, turn[-1]).to_numpy() for c in table.column_names}
            for a, b in zip([0, *turn[:-1].tolist()], turn.tolist(), strict=True):
                yield {c: v[a:b] for c, v in whole.items()}
        rest = table.slice(turn[-1]) if len(turn) else table
    if rest is not None and len(rest):
        yield {c: rest.column(c).to_numpy() for c in rest.column_names}
