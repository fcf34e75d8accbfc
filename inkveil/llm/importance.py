"""Importance resampling towards a target corpus, with hashed n-gram features.

1. Features: each row's words become runs, and runs become buckets (crc32 modulo a number), all in one array per row.
2. Counts: the buckets of all rows are counted; sums are made in each task first, so a task sends a row per bucket at most.
3. Gains: a bucket's gain is the log of its smoothed share in the target over that in the corpus. The totals, as many as buckets,
   become one literal array, and each row sums its buckets' gains in place: rows are neither exploded nor shuffled for a score.
4. Draw: a score is the mean gain plus Gumbel noise from the id, so the highest scores are a sample without replacement. Scores are
   whole numbers in a range that gains and noise bound, so counts by score give the score at which the draw ends; only rows above it
   are ranged and numbered, and a score that many rows tie at is split over partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import write_table

#: Buckets of features.
BUCKETS = 10_000

#: Longest run of words that is a feature.
LONGEST_RUN = 1

#: Gains, weights and scores are whole multiples of 1/SCALE.
SCALE = 1000

#: Words that a document of the draw has at least, percent of them that are drawn, seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024

#: What isn't part of a word; texts are in lower case before.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def buckets(text: Column, longest: int = LONGEST_RUN, n: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to longest words, repeats too; empty for a null text."""
    words = F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0))
    of = lambda run: (F.crc32(run) % n).cast("int")
    if longest == 1:
        found = F.transform(words, of)
    else:
        places = lambda ws: F.sequence(F.lit(1), F.size(ws))
        runs = lambda ws, k: F.filter(F.transform(places(ws), lambda i: F.slice(ws, i, F.lit(k))), lambda run: F.size(run) == k)
        of_runs = lambda ws: F.concat(*[F.transform(runs(ws, k), lambda run: of(F.array_join(run, " "))) for k in range(1, longest + 1)])
        found = F.get(F.transform(F.array(F.when(F.size(words) > 0, words)), of_runs), F.lit(0))
    return F.coalesce(found, F.array().cast("array<int>"))


def totals(rows: DataFrame) -> DataFrame:
    """bucket, n of rows with an array column buckets: as many rows as there are buckets at most."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from the totals of both; buckets without features have counts of zero."""
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))  # n rows each at most
    s_all, t_all = float(sum(s.values()) + n), float(sum(t.values()) + n)
    return [math.floor(SCALE * math.log((t.get(b, 0) + 1.0) * s_all / ((s.get(b, 0) + 1.0) * t_all))) for b in range(n)]


def mean_gain(found: Column, gain: list[int]) -> Column:
    """The floored mean gain of an array of buckets; 0 of none."""
    table = F.from_json(F.lit(str(gain)), "array<bigint>")  # one literal after constant folding
    total = F.aggregate(found, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    return F.when(F.size(found) == 0, F.lit(0)).otherwise(F.floor(total / F.size(found))).cast("long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in whole multiples of 1/SCALE, the same in every run; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, drawn: int, id_col: str) -> DataFrame:
    """scored (score long, may_draw boolean) with rank: 1 to drawn for the highest scores among those that may, ties to smaller ids, null ids last."""
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # the number of scores is bounded by the gains' and the noise's range, whatever the number of rows
    counts = scored.filter("may_draw").groupBy("score").agg(F.count("*").alias("n")).collect()
    left, least = drawn, None
    for score, n in sorted(counts, reverse=True):
        left, least = left - n, score
        if left <= 0:
            break
    among = F.col("may_draw") & (F.col("score") >= least)
    # the last key splits rows that tie in score and id; written, places stay as they are
    keys = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_tie")]
    above = scored.filter(among).withColumn("_tie", F.monotonically_increasing_id())
    above = above.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    above = write_table(above.drop("_tie"), "drawn")
    part = F.shiftright("_place", 33)
    sizes = sorted(above.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, at = {}, 0
    for p, rows in sizes:
        before[p], at = at, at + rows
    if not before:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    start = F.element_at(F.from_json(F.lit(str([before.get(p, 0) for p in range(max(before) + 1)])), "array<bigint>"), part.cast("int") + 1)
    rank = start + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    above = above.withColumn("rank", F.when(rank <= drawn, rank)).drop("_place")
    return above.unionByName(scored.filter(~among).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of docs: the id, n_features, weight, score, rank (1, 2, ... by score for those drawn, else null).

    A null or empty text has no features, weight 0 and a score of its noise alone; it is drawn only if least_words is 0. Null ids
    share one noise and come last among ties; rows with equal ids tie and get different ranks in any order. Texts of any length
    are whole: a row holds an array of its buckets. Of an empty table the result is empty; with an empty target gains compare with equal
    shares. Other columns aren't read, so their names may clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), buckets(F.col(text_col), longest).alias("buckets"))
    rows = write_table(rows, "buckets")
    runs = F.size("buckets")
    # of w words there are w + (w - 1) + ... runs; with runs of one word the numbers are equal
    words_from = sum(max(0, least_words - k) for k in range(longest))
    gain = gains(totals(rows), totals(target.select(buckets(F.col(target_text), longest).alias("buckets"))))
    scored = rows.select("_id", runs.cast("long").alias("n_features"), mean_gain(F.col("buckets"), gain).alias("weight"))
    scored = scored.select("*", (F.col("weight") + noise(F.col("_id"), seed)).alias("score"), (F.col("n_features") >= words_from).alias("may_draw"))
    scored = write_table(scored, "scores")
    drawn = percent * scored.filter("may_draw").count() // 100
    return ranked(scored, drawn, "_id").select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")
