"""Arrays within a row against plain Python."""

import bisect
import itertools
import random

from pyspark.sql import functions as F

from inkveil.functions import arrays, spans
from inkveil.operators.resolve import without_overlaps


def test_prefix_and_search(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(-9, 50) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 700, 9000)]
    rows = spark.createDataFrame([(k, v, sorted(v)) for k, v in enumerate(lists)], "k int, v array<int>, s array<int>")
    asked = F.transform(F.sequence(F.lit(-11), F.lit(52)), lambda x: arrays.before(F.col("s"), x))
    close = F.transform(F.sequence(F.lit(-20), F.lit(60)), lambda x: arrays.near(F.col("s"), x, 2))
    got = rows.select("k", arrays.prefix(F.col("v")).alias("sums"), arrays.prefix(F.col("v"), "max").alias("tops"), asked.alias("before"), close.alias("near")).collect()
    for r in got:
        v = lists[r.k]
        assert r.sums == list(itertools.accumulate(v)) and r.tops == list(itertools.accumulate(v, max))
        assert r.before == [bisect.bisect_left(sorted(v), x) for x in range(-11, 53)]
        assert r.near == [any(abs(y - x) <= 2 for y in v) for x in range(-20, 61)]


def test_runs(spark):
    lists = [[], [1], [1, 1, 2, 2, 2, 1], [3, 4, 5]]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<int>")
    got = {r.k: r.r for r in rows.select("k", arrays.runs(F.col("v"), lambda a, b: a != b).alias("r")).collect()}
    assert got == {k: [list(g) for _, g in itertools.groupby(v)] for k, v in enumerate(lists)}


def test_pieces_of_long_texts(spark):
    rng = random.Random(2)
    texts = ["", "short", "".join(rng.choice("ab\n甲😀") for _ in range(5000))]
    asked = [(rng.randrange(-20, 5100), rng.randrange(0, 1025)) for _ in range(60)] + [(1023, 1), (1024, 1024), (0, 1024)]
    rows = spark.createDataFrame([(t, [tuple(a) for a in asked]) for t in texts], "t string, asked array<struct<a:int,n:int>>")
    got = rows.select("t", F.transform("asked", lambda q: arrays.at(arrays.cut(F.col("t")), q["a"], q["n"])).alias("r")).collect()
    for r in got:
        assert r.r == [r.t[max(a, 0) : max(a + n, 0)] for a, n in asked]


def test_matches(spark):
    mark = spans.MARK
    texts = ["", "12 ab 345 12", "9", f"1{mark}22 {mark}3", "none", " ".join(str(k) for k in range(3000))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.matches(F.col("t"), "[0-9]+").alias("m")).collect()
    import re

    for r in got:
        assert [(m.start, m.m) for m in r.m] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", r.t)]


def brute_greedy(ordered):
    kept = []
    for s in ordered:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return kept


def test_overlaps(spark):
    rng = random.Random(3)
    lists = [[], [(0, 5)], [(0, 5), (3, 8)], [(3, 8), (0, 5), (5, 6), (1, 2)]]
    for n, reach, long in ((40, 60, 12), (200, 300, 30), (300, 4000, 9), (120, 50, 50)):
        lists += [[(a := rng.randrange(reach), a + rng.randrange(1, long)) for _ in range(n)] for _ in range(8)]
    lists = [list(v) for v in lists]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<struct<start:int,end:int>>")
    got = {r.k: [tuple(s) for s in r.o] for r in rows.select("k", without_overlaps(F.col("v"), "array<struct<start:int,end:int>>").alias("o")).collect()}
    assert got == {k: brute_greedy(v) for k, v in enumerate(lists)}


def test_cover(spark):
    rng = random.Random(4)
    lists = [[(a := rng.randrange(300), a + rng.randrange(1, 40)) for _ in range(n)] for n in (0, 1, 90)]
    asked = [(a := rng.randrange(300), a + rng.randrange(1, 20)) for _ in range(200)]
    rows = spark.createDataFrame([(k, v, asked) for k, v in enumerate(lists)], "k int, v array<struct<start:int,end:int>>, q array<struct<start:int,end:int>>")
    hit = arrays.let(arrays.cover(F.col("v")), lambda by: F.transform("q", lambda q: arrays.covered(q["start"], q["end"], by)))
    for r in rows.select("k", hit.alias("h")).collect():
        assert r.h == [any(s <= a and b <= e for s, e in lists[r.k]) for a, b in asked]


def test_dictionary_of_many_names(spark):
    """All places of 200 words, of words within words and overlapping ones, in one text; words with signs of patterns too."""
    from inkveil.operators.detect import dictionary

    rng = random.Random(5)
    names = [rng.choice("赵钱孙李王") + rng.choice("一二三四五六七八九十") + rng.choice(["", "上", "中", "下"]) for _ in range(200)] + ["王一", "王一上", "一上王", ".*", "a|b", "[", "😀x", "E"]
    text = "".join(rng.choice([*names, "，", "甲方", "aaa|b", " "]) for _ in range(3000)) + "aaaa" + spans.MARK + "王一上王"
    rows = spark.createDataFrame([(1, text, names), (2, text, []), (3, None, names), (4, "", names), (5, "aaaa", ["aa", "a"])], "k int, t string, w array<string>")
    got = {r.k: [tuple(x) for x in r.d] for r in rows.select("k", dictionary(F.col("t"), F.col("w")).alias("d")).collect()}
    want = sorted({(i, w) for w in names for i in range(len(text)) if text.startswith(w, i)})
    assert sorted(got[1]) == want and [s for s, _ in got[1]] == sorted(s for s, _ in got[1])
    assert got[2] == got[3] == got[4] == [] and sorted(got[5]) == [(0, "a"), (0, "aa"), (1, "a"), (1, "aa"), (2, "a"), (2, "aa"), (3, "a")]


def test_a_text_of_many_hits(spark):
    """8,000 addresses in one text, and names copied 2,000 times: all are found, where they stand."""
    from inkveil.plans.analysis import analyse
    from inkveil.registry import Settings

    text = "法定代表人：张三\n" + "，".join(f"mail{k}@host{k % 50}.example.com" for k in range(8000)) + "张三，" * 2000
    row = analyse(spark.createDataFrame([(1, text)], "doc_id long, text string"), Settings(only=frozenset({"EMAIL", "PERSON_NAME"}))).select("raw", "kept", F.size("candidates").alias("n")).first()
    assert all(row.raw[s.raw_start : s.raw_end] == s.value for s in row.kept)
    real = [d for k in range(8000) if len(d := f"{k}{k % 50}") < 6 or len(set(d)) > 2]  # the others look made up
    assert sum(s.type_id == "EMAIL" for s in row.kept) == len(real) > 7000 and sum(s.value == "张三" for s in row.kept) == 2001 and row.n > 7000
