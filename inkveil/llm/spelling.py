"""Spelling variants: words that differ from a much more frequent word by one code point, grouped under a root.

1. Words: runs of letters, counted over all texts; sums are made in each task first. A few of the runs, chosen by a checksum of id and run,
   lose a code point.
2. Symmetric deletes: each word emits itself and its distinct single deletions, as 64-bit keys that are made from sums over prefixes, so a
   word of length m costs m keys of a fixed size, however long it is. Words at distance one share a key: one of them is the other's
   deletion, or both have the same deletion.
3. Join: equal keys meet. Two deletions must come from overlapping places of words of one length, else the words are two edits apart
   (all deletions of one word share keys so); such pairs don't leave the join. For each word and key at most the alphabet's letters
   at each place can meet, so no key is hot.
4. Verify: pairs fetch both words, and remain if exactly one code point is inserted, deleted or replaced.
5. Forms and roots: a word's form is its most frequent near word if that is frequent enough; roots follow forms by repeated
   joins, each of which doubles the steps. Counts grow tenfold with each step, so there are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import write_table
from inkveil.llm.importance import lower_ascii
from inkveil.llm.substring_dedup import _mix

#: Code points of a word at least, its occurrences at least, how many times as frequent a form is.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10

#: One in so many pairs of id and run loses a code point.
EVERY = 31

#: Letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"

#: Key rows of an Arrow batch, about.
BATCH = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEYS = "id long, n long, len int, lo int, hi int, key long"


def occurrences(docs: DataFrame, id_col: str, text_col: str, every: int = EVERY, least: int = LEAST_CHARS) -> DataFrame:
    """One row per occurrence: word. Runs of fewer letters than a word has can't become one and aren't taken."""
    run = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(run).alias("run"))
    rows = rows.select("_id", lower_ascii(F.col("run")).alias("run")).withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    rows = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.filter(F.char_length("word") >= least)


def deletion_keys(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a word and of its distinct single deletions; the first and last place whose deletion gives it (the word: -1, -1).

    The places that give the same deletion are a run of one code point.
    """
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    m = len(points)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m, _BASE))))
    terms = _mix(points + np.uint64(1))
    # sums of terms by place, and of terms moved one place to the left
    here = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms * power[:m])))
    moved = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms[1:] * power[: m - 1]))) if m else here
    first = np.flatnonzero(np.concatenate((np.ones(min(m, 1), bool), points[1:] != points[:-1])))
    last = np.concatenate((first[1:], [m]))[: len(first)] - 1
    cut = here[first] + (moved[m - 1] - moved[first] if m else np.zeros(0, np.uint64))
    keys = _mix(np.concatenate((here[m:], cut)) + np.concatenate(([m], np.full(len(first), max(m - 1, 0)))).astype(np.uint64) * _BASE)
    return keys.view(np.int64), np.concatenate(([-1], first)).astype(np.int32), np.concatenate(([-1], last)).astype(np.int32)


def symmetric_keys(words: DataFrame) -> DataFrame:
    """Rows of id, n, len (code points), lo, hi (places), key for words (id, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            parts, sizes, lens, at = [], [], [], 0

            def rows(upto: int) -> pa.RecordBatch:
                row = np.repeat(np.arange(at, upto), sizes)
                keys, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], counts[row], np.repeat(np.array(lens, np.int32), sizes), lo, hi, keys)], ["id", "n", "len", "lo", "hi", "key"])

            for k, word in enumerate(batch.column(1).to_pylist()):
                parts.append(deletion_keys(word))
                sizes.append(len(parts[-1][0]))
                lens.append(len(word))
                if sum(sizes) >= BATCH or k + 1 == len(ids):
                    yield rows(k + 1)
                    parts, sizes, lens, at = [], [], [], k + 1

    return words.select("id", "word", "n").mapInArrow(run, _KEYS)


def one_apart(a: Column, b: Column) -> Column:
    """Whether b is a with exactly one code point inserted, deleted or replaced: what is left without the common front and back is one at most."""
    short, long = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    return (long - short <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of words (id, word, n) that are one edit apart, each once."""
    keys = write_table(symmetric_keys(words), "keys")
    side = lambda end: keys.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "len", "lo", "hi")])
    # b's deletion is a, or the same place of both is replaced
    inserted = (F.col("lo_a") < 0) & (F.col("lo_b") >= 0) & (F.col("len_b") == F.col("len_a") + 1)
    same = (F.col("len_a") == F.col("len_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("lo_a") >= 0) & (F.col("lo_b") >= 0)
    replaced = same & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))
    pairs = side("a").join(side("b"), "key").filter(inserted | replaced).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    text = lambda end: words.select(F.col("id").alias(end), F.col("word").alias(f"word_{end}"), F.col("n").alias(f"n_{end}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").filter(one_apart(F.col("word_a"), F.col("word_b")))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word, form (null: none) with root: the last word that forms lead to."""
    out = write_table(forms.withColumn("root", F.coalesce("form", "word")), "roots")
    for _ in range(most_rounds):
        step = out.filter("root <> word").select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = out.join(step, out["root"] == step["_at"], "left").select(*forms.columns, F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved"))
        out = write_table(moved, "roots")
        if out.filter("moved").isEmpty():
            return out.drop("moved")
        out = out.drop("moved")
    raise RuntimeError(f"forms don't end in {most_rounds} rounds")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null texts and those without letters have no words; a null id counts as empty. Repeated rows count as often as they stand. Among
    near words that are equally frequent, the smallest in code-point order is the form. Words of any length are whole. An empty table
    gives an empty result; other columns aren't read.
    """
    counted = occurrences(docs, id_col, text_col, every, least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    words = write_table(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = write_table(near_pairs(words), "near")
    ends = [F.struct(F.col(f"word_{x}").alias("word"), F.col(f"n_{x}").alias("n"), F.col(f"word_{y}").alias("other"), F.col(f"n_{y}").alias("m")) for x, y in ("ab", "ba")]
    near = pairs.select(F.inline(F.array(*ends))).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = F.when(-F.col("best.m") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n")))
    near = near.select("word", "n_near", enough.alias("f"))
    every_word = words.select("word", "n").join(near, "word", "left")
    found = every_word.select("word", F.col("f.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"))
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")
