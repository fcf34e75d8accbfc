"""Exact, SimHash, embedding and substring dedup against brute force, with nulls, empty and repeated rows."""

import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import common, embedding_dedup, exact_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, _id int, fp string, a long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def closure(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(nodes, 2):
            if label[a] != label[b] and linked(a, b):
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {frozenset(p) for p in pairs if None not in p}
    nodes = sorted({x for p in links if len(p) == 2 for x in p})
    assert got == closure(nodes, lambda a, b: frozenset((a, b)) in links)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = [(k, f"text {k % 7}") for k in range(60)] + [(100, None), (101, ""), (102, "x" * 200_000), (103, "x" * 200_000), (5, "text 5"), (None, "text 1"), (None, "alone")]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep=keep).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        want = (min if keep == "smallest" else max)(known) if known else None
        assert (r.keep_id, r.group_size, r.kept) == (want, len(ids), r.doc_id is not None and r.doc_id == want)
    left = {r.doc_id for r in exact_dedup.drop_exact_copies(docs(spark, rows), keep=keep).collect()}
    assert left == {r.doc_id for r in got if r.kept or r.doc_id is None}
    assert exact_dedup.exact_dedup(docs(spark, []), keep=keep).count() == 0


def test_hot_texts_of_repeated_ids_are_dealt_out(spark):
    """A text that a third of the rows have, all with one id or none: its rows go to many salts, and results are as for one group."""
    rows = [(None if k % 2 else 7, "hot") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(800)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).filter("text_sha256 = sha2('hot', 256)").collect()
    assert len(got) == 400 and {(r.keep_id, r.group_size, r.kept) for r in got} == {(7, 400, True), (7, 400, False)}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.table_masks()
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta EPSILON zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(300)]
    rows = [(k, " ".join(base[:290] + [f"w{k}"] + base[291:])) for k in range(40)] + [(50 + k, f"short {k}") for k in range(10)]
    rows += [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (94, "ONE"), (None, "one"), (None, "only here at all")]
    for small in (32, 2):  # buckets compared directly, and by shared neighbours
        monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
        got = simhash.simhash_dedup(docs(spark, rows)).collect()
        assert len(got) == len(rows)
        fps = {f"{brute_fingerprint(t):016x}" for _, t in rows}
        assert {r.fingerprint for r in got} == fps
        known = sorted({f"{brute_fingerprint(t):016x}" for i, t in rows if i is not None})
        label = closure(known, lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1") <= 2)
        least = {}
        for i, t in rows:
            if i is not None:
                g = label[f"{brute_fingerprint(t):016x}"]
                least[g] = min(i, least.get(g, i))
        for r in got:
            want = least[label[r.fingerprint]] if r.fingerprint in label else None
            assert (r.component_id, r.kept) == (want, r.doc_id is not None and r.doc_id == want)
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = embedding_dedup.encode(x)
    about, error = embedding_dedup.estimate(codes, factors, x)
    off = about - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.003 and (np.abs(off) < error[:, None]).mean() > 0.999


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = [(k, (base[k % 30] + 0.12 * rng.standard_normal(16)).tolist()) for k in range(150)] + [(200, base[0].tolist()), (201, base[0].tolist()), (202, (3 * base[0]).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None]), (304, [float("nan")] * 16), (305, [1.0, 0.0]), (306, [2.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, raw string, rep int")
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9
    label = closure(sorted(good), cos)
    for block in (1024, 8):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(table, miss=1e-6).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            if i in good:
                assert (r.n_links, r.component_id) == (sum(cos(i, j) for j in good if j != i), label[i])
            else:
                assert (r.n_links, r.component_id, r.kept) == (0, i, i is not None)
    assert embedding_dedup.embedding_dedup(table.limit(0)).count() == 0


def test_chains():
    # two collinear segments, one that crosses them, one beyond a large gap
    parts = [(0, 0, 10), (12, 12, 10), (13, 2, 5), (200, 200, 9)]
    found = substring_dedup.chains(parts)
    assert found[0] == [(200, 200, 9)] or found[0] == [(0, 0, 10), (12, 12, 10)]
    assert sorted(map(tuple, found)) == sorted([((0, 0, 10), (12, 12, 10)), ((13, 2, 5),), ((200, 200, 9),)])
    assert substring_dedup.edit_distance(np.array([1, 2, 3]), np.array([1, 3, 4])) == 2


def test_shared_passages(spark):
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = word(80)
    changed = [("new" if k in (20, 41, 60) else w) for k, w in enumerate(passage) if k != 33]
    rows = [(k, " ".join(word(200))) for k in range(20)]
    rows += [(30, " ".join(word(50) + passage + word(30))), (31, " ".join(word(10) + passage)), (32, " ".join(changed + word(70))), (33, " ".join(word(20) + passage[:30] + word(20)))]
    rows += [(40, None), (41, ""), (42, "few words"), (None, " ".join(passage)), (43, " ".join(["same"] * 400))]
    got = substring_dedup.shared_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {30, 31, 32}
    for r in got:
        if {r.doc_id, r.partner_id} == {30, 31}:
            assert r.n_equal == 80 and r.identity == 1.0
            assert (r.first_word, r.last_word) == ((50, 129) if r.doc_id == 30 else (10, 89))
    assert substring_dedup.shared_passages(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.shared_passages(docs(spark, []), least_words=10)
    assert substring_dedup.shared_passages(docs(spark, rows).filter(F.col("doc_id") < 20)).count() == 0


def _equal_windows(texts, n=50):
    """For each document the starts of windows of n words that another one has as well."""
    words = {k: t.lower().split() for k, t in texts.items()}
    holders = {}
    for k, w in words.items():
        for s in range(len(w) - n + 1):
            holders.setdefault(tuple(w[s : s + n]), set()).add(k)
    return {k: [s for s in range(len(w) - n + 1) if len(holders[tuple(w[s : s + n])]) > 1] for k, w in words.items()}


def test_no_equal_passage_is_lost(spark):
    """All windows of 50 equal words are reported, whatever else quotes parts of them: frequent lines, fragments, junk, copies."""
    rng = random.Random(17)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, whole = {}, word(90)
    texts[100], texts[101] = word(30) + whole + word(20), word(5) + whole
    for k in range(7):  # fragments of 40 words, each over part of the next, in documents of smaller and of larger ids
        texts[k + 1] = word(20) + whole[8 * k : 8 * k + 40] + word(9)
        texts[200 + k] = word(12) + whole[7 * k : 7 * k + 40] + word(30)
    short = word(50)
    texts[110], texts[111] = word(30) + short + word(31), short
    for k in range(11):  # 49 words at most
        texts[20 + k], texts[220 + k] = word(10) + short[: 39 + k] + word(8), word(6) + short[11 - k :][:49] + word(2)
    lines = [word(rng.randrange(8, 31)) for _ in range(25)]
    for k in range(120):
        texts[300 + k] = sum((rng.choice(lines) if rng.random() < 0.7 else word(15) for _ in range(rng.randrange(2, 12))), [])
    for k in range(6):
        texts[500 + k] = texts[300] if k % 2 else ["same"] * (45 + 3 * k)
        texts[510 + k] = ["a", "b"] * (20 + 3 * k)
    texts[520] = word(3000) + whole + word(40) * 20
    texts = {k: " ".join(w) for k, w in texts.items()}
    rows = [*texts.items(), (101, "a few"), (None, texts[100])]
    want = _equal_windows(texts)  # of an id's texts the greater one counts
    got = substring_dedup.shared_passages(docs(spark, rows)).collect()
    found = {}
    split = {k: t.split() for k, t in texts.items()}
    for r in got:
        assert r.doc_id != r.partner_id and r.last_word - r.first_word >= 49 and r.partner_last_word - r.partner_first_word >= 49 and r.identity >= 0.8
        a, b = split[r.doc_id][r.first_word : r.last_word + 1], split[r.partner_id][r.partner_first_word : r.partner_last_word + 1]
        if len(a) == len(b):
            assert sum(x == y for x, y in zip(a, b, strict=True)) >= 0.8 * len(a)
        found.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word + 1))
    lost = {k: s for k, starts in want.items() if (s := [s for s in starts if not set(range(s, s + 50)) <= found.get(k, set())])}
    assert sum(map(len, want.values())) > 500
    assert not lost


def test_fuzzy_passages(spark):
    """Passages of 80 words with a tenth of them changed, alone and made of lines that others have too."""
    rng = random.Random(23)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = {}
    for k in range(100):
        passage = word(80)
        texts[k] = word(40) + passage + word(30)
        texts[1000 + k] = word(15) + [w if rng.random() > 0.1 else "new" + w for w in passage]
    for k in range(50):  # two lines of 30 words; each also in documents of smaller and of larger ids, alone
        one, two = word(30), word(30)
        texts[2000 + k], texts[3000 + k] = word(9) + one + two + word(12), one + two + word(3)
        for j, line in enumerate((one, one, two, two)):
            texts[100 * j + 4000 * (j % 2) + 200 + k] = word(11) + line + word(20)
    got = {(r.doc_id, r.partner_id) for r in substring_dedup.shared_passages(docs(spark, [(k, " ".join(w)) for k, w in texts.items()])).collect()}
    assert len([k for k in range(100) if (k, 1000 + k) in got and (1000 + k, k) in got]) >= 95
    assert len([k for k in range(50) if (2000 + k, 3000 + k) in got]) == 50


def test_small_tables_of_rounds_are_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10 < 9], "a long, b long")
        found = common.components(links)
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(r["node"], r["component"]) for r in found.collect()} == {(k, k - k % 10) for k in range(300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_passages_without_sorts_or_tables():
    # first and last occurrences are marked where they are made, so that keys are summed up as numbers: (3, 0) is both of its key
    row, key = np.array([0, 0, 0, 1, 1]), np.array([7, 5, 7, 7, 7])
    assert substring_dedup.marks(np.lexsort((key, row)), row, key).tolist() == [1, 3, 2, 1, 2]
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        table[0], table[:, 0] = np.arange(len(b) + 1), np.arange(len(a) + 1)
        for i, j in np.ndindex(len(a), len(b)):
            table[i + 1, j + 1] = min(table[i, j] + (a[i] != b[j]), table[i, j + 1] + 1, table[i + 1, j] + 1)
        assert substring_dedup.edit_distance(a, b) == table[-1, -1]
        n = min(len(a), len(b))
        score = np.cumsum(np.where(a[:n] == b[:n], 1, -4))
        size = int(score.argmax()) + 1 if n and score.max() > 0 else 0
        if (np.maximum.accumulate(score) - score <= 24).all():
            assert substring_dedup._extend(a, b) == (size, int((a[:size] == b[:size]).sum()))
    began = time.process_time()
    assert substring_dedup.edit_distance(np.arange(5000), np.arange(1, 5001)) == 2
    assert time.process_time() - began < 2
