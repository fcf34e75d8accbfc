"""Embedding near-dedup with binary codes of randomly rotated vectors.

A unit vector o is rotated by random orthogonal matrices; the signs are its code, which stands for a unit vector x of equal
absolute components, and <x, o> is stored with it as the correction factor. For another unit vector q, <x, q> / <x, o> is an
unbiased estimate of <o, q>, and its error is below EPSILON * sqrt((1 - <x, o>^2) / (<x, o>^2 * (bits - 1))) with high
probability. Only pairs whose upper bound reaches the threshold are computed again, in double precision; these alone link.

Pairs are looked for where they agree in the signs of further rotations: tables of `bits` signs each, in numbers that miss a
pair at the threshold with probability MISS, and others with less. The bits grow with the number of vectors, so buckets keep
their size. Equal vectors are one class from the start. A large bucket is dealt in blocks, each pair of blocks to its task;
tasks return counts and links to the least of a group, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import components, groups, write_table

#: Cosine from which on vectors link.
THRESHOLD = 0.9

#: Rotations in the code: as many bits as this times the dimensions.
CODE_ROTATIONS = 4

#: Width of the confidence interval; about the standard deviations of a normal error.
EPSILON = 4.0

#: Probability that no table has a pair at the threshold.
MISS = 0.003

#: Vectors that a bucket has on average, as a target, and that a block has at most, on average.
BUCKET, BLOCK = 64, 1024

SEED = 20240501


def rotations(dims: int, rows: int, seed: int) -> np.ndarray:
    """rows x dims, blocks of random orthogonal matrices; the same for each dims, rows and seed."""
    rng, blocks = np.random.default_rng([seed, dims]), []
    for _ in range(math.ceil(rows / dims)):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        blocks.append(q * np.sign(np.diag(r)))
    return np.concatenate(blocks)[:rows]


def table_plan(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for so many vectors."""
    bits = int(np.clip(round(math.log2(max(vectors, 1) / BUCKET)), 6, 20)) if vectors > BUCKET else 6
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed bits) and correction factors of unit vectors."""
    turned = unit @ rotations(unit.shape[1], CODE_ROTATIONS * unit.shape[1], SEED).T
    factors = np.abs(turned).sum(axis=1) / CODE_ROTATIONS / math.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factors


def estimate(codes: np.ndarray, factors: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors (rows) with unit vectors (columns), and the bound on each row's error.

    A code of several rotations stands for the mean of their vectors x, so the estimate is the mean of unbiased ones.
    """
    dims = unit.shape[1]
    bits = CODE_ROTATIONS * dims
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    turned = (unit @ rotations(dims, bits, SEED).T).astype(np.float32)
    found = signs @ turned.T / (CODE_ROTATIONS * math.sqrt(dims)) / factors[:, None]
    return found, EPSILON * np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * max(bits - 1, 1)))


def _unit(raw: list[bytes], dims: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dims)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small numbers
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The id and raw: the vector's doubles, or null if it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = np.array([math.nan if y is None else y for y in x or []], np.float64)
                out.append((v + 0.0).tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "raw"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, raw binary")


_ROW = "dims int, t int, k int, rep long, size long, raw binary, code binary, factor double, keys binary"


def _table_rows(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                raws, dims = batch.column(2).to_pylist(), np.array([len(x) // 8 for x in batch.column(2).to_pylist()])
                for d in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == d)
                    part, raw = batch.take(pa.array(own)), [raws[i] for i in own]
                    unit = _unit(raw, d)
                    codes, factors = encode(unit)
                    signs = (unit @ rotations(d, bits * tables, SEED + 1).T > 0).reshape(len(own), tables, bits)
                    keys = (signs @ (1 << np.arange(bits))).astype(np.int32)
                    packed = pa.array([k.tobytes() for k in keys], pa.binary())
                    coded = pa.array([c.tobytes() for c in codes], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), d, np.int32)), pa.array(np.full(len(own), t, np.int32)), pa.array(keys[:, t]), *part.columns, coded, pa.array(factors), packed],
                            ["dims", "t", "k", "rep", "size", "raw", "code", "factor", "keys"],
                        )

    return classes.select("rep", "size", "raw").mapInArrow(run, _ROW)


def _compare(g: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's members with links found here first: reps, linked vectors, reps again, least rep of their local component."""
    dims, t, i, j = (int(g[c][0]) for c in ("dims", "t", "i", "j"))
    left, right = np.flatnonzero(g["block"] == i), np.flatnonzero(g["block"] == j)
    unit = _unit(list(g["raw"]), dims)
    codes = np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(unit), -1)
    about, error = estimate(codes[left], g["factor"][left].astype(np.float64), unit[right])
    a, b = np.nonzero(about >= threshold - error[:, None] - 1e-5)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    keys = np.frombuffer(b"".join(g["keys"]), np.int32).reshape(len(unit), -1)
    links: list[np.ndarray] = []
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        use = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        use[use] = ~(keys[x[use], :t] == keys[y[use], :t]).any(axis=1)  # an earlier table has the pair
        links.append(np.stack((x[use], y[use])))
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    count = np.zeros(len(unit), np.int64)
    np.add.at(count, a, g["size"][b])
    np.add.at(count, b, g["size"][a])
    label = g["rep"].copy()
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (label == before).all():
            break
    some = np.flatnonzero(count)
    return g["rep"][some], count[some], g["rep"][some], label[some]


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per row of rows: the id, n_links, component_id, kept.

    Vectors of equal length with a cosine of threshold or more in double precision link. n_links: the other rows linked
    directly; component_id: the smallest id that links reach; kept: whether that is the row's own. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing. Equal vectors always link, others by the tables:
    a pair at the threshold is missed with probability miss, and no pair below it is linked. Rows with a null id link as
    others if an equal vector has an id; else they have n_links 0 and component_id null, and are never kept. Repeated rows
    are rows of their own. An empty table gives an empty result. Other columns are not read.
    """
    vectors = write_table(_vectors(rows, id_col, vector_col), "vectors")
    classes = vectors.filter("raw is not null").groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = write_table(classes.filter("rep is not null"), "classes")
    bits, tables = table_plan(classes.count(), threshold, miss)
    placed = write_table(_table_rows(classes, bits, tables), "tables")
    keys = ["dims", "t", "k"]
    large = placed.groupBy(*keys).count().filter(F.col("count") > BLOCK).select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")
    order = [*keys, "i", "j"]
    placed = placed.select(*order, "block", "rep", "size", "raw", "code", "factor", "keys").repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 5):
            if len(g["rep"]) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _compare(g, threshold)[1:]], ["n", "rep", "least"])

    found = write_table(placed.mapInArrow(run, "n long, rep long, least long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    known = classes.join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    known = write_table(known.select("raw", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    out = vectors.join(known, "raw", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
