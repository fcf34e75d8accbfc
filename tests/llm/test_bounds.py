"""Bounds that hold whatever the rows are: candidates of near-dedup, samples of fits, recall of fuzzy passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.llm import common, language_id, near_dedup, quality, substring_dedup, toxicity


def written(spark, monkeypatch, module):
    """The numbers of rows that module writes, by the tables' tags."""
    rows = {}

    def keep(df, tag):
        out = common.write_table(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(module, "write_table", keep)
    return rows


def test_prefixes_share_a_key():
    """Each pair at the similarity has a first common key that both sides allow, and that the smaller side has early."""
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.choice([1, 4, 5, 9, 40, 90]))]
        texts.append(" ".join(words).encode())
        for n in (1, 2, 5):
            other = list(words) + [f"x{k}" for k in range(rng.randrange(3))]
            for at in rng.sample(range(len(other)), min(n, len(other))):
                other[at] = f"y{rng.randrange(9)}"
            texts.append(" ".join(other).encode())
    sets = [near_dedup.shingles(t) for t in texts]
    _, every = near_dedup.shingle_hashes(texts)
    for frequent in (np.zeros(0, np.uint64), np.unique(every)[::3]):
        row, m, cap, often, keys = near_dedup.prefixes(texts, frequent, np.arange(1, len(frequent) + 1))
        own = {r: {} for r in range(len(texts))}
        for r, n, c, o, k in zip(row, m, cap, often, keys, strict=True):
            assert n == len(sets[r]) and o == (np.uint64(int(k) % 2**64) in frequent)
            own[r][k] = (len(own[r]), c)
        near = 0
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    near += 1
                    first = min(own[a].keys() & own[b].keys(), key=lambda k: own[a][k][0])
                    caps = own[a][first][1], own[b][first][1]
                    assert caps[0] >= len(sets[b]) and caps[1] >= len(sets[a])
                    small = a if len(sets[a]) < len(sets[b]) else b
                    assert own[small][first][1] >= len(sets[small])
        assert near > 20


@pytest.mark.parametrize("own", [40, 35])
def test_shared_boilerplate_makes_no_candidates(spark, monkeypatch, own):
    """3,000 unlike texts share 60 words, or 180 in which own words are less than a sixth: no pairs, but true copies among them are found."""
    rng = random.Random(2)
    shared = [f"s{k}" for k in range(60)] * (1 if own == 40 else 3)
    texts = [shared + [f"w{rng.randrange(10**9)}" for _ in range(own)] for _ in range(3000)]
    texts += [[*t[:-1], "changed"] for t in texts[:20]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = written(spark, monkeypatch, near_dedup)
    links = {tuple(r) for r in near_dedup.near_links(docs).collect()}
    assert links == {(k, 3000 + k) for k in range(20)}
    assert sum(rows["candidates"]) < 3000


def test_near_copies_in_boilerplate_and_odd_rows(spark):
    """Groups of copies among boilerplate, equal ids, nulls, empty and short texts: the groups are those of all pairs."""
    rng = random.Random(3)
    lines = [" ".join(f"l{j}_{k}" for k in range(12)) for j in range(8)]
    base = [" ".join(rng.sample(lines, 5)) for _ in range(60)]
    rows = [(k, t + f" u{k % 50}") for k, t in enumerate(base)] + [(100 + k, "many " * k) for k in range(6)] + [(200, None), (201, ""), (202, " "), (None, "x"), (203, "a b"), (204, "a  b")]
    big = " ".join(f"b{k}" for k in range(300)).split()
    for k in range(60):
        words = list(big)
        words[rng.randrange(300)] = f"c{k}"
        rows.append((300 + k, " ".join(words)))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    sets = {i: near_dedup.shingles((t or "").encode()) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = [r.doc_id for r in near_dedup.drop_near_copies(docs).collect()]
    assert {i for i in got if i is not None} == {i for i in label if label[i] == i} and None in got
    assert near_dedup.near_links(docs.limit(0)).count() == 0


# samples


def test_bounded_sample(spark):
    rows = [(None, f"t{k}") for k in range(3000)] + [(5, f"t{k}") for k in range(3000)] + [(None, "same")] * 3000 + [(k, None) for k in range(10)]
    docs = spark.createDataFrame(rows, "_id long, _text string").repartition(7)
    got = common.bounded_sample(docs, 50, "_id", "_text").collect()
    assert len(got) == 50 == len(set(got))
    assert sorted(map(str, got)) == sorted(map(str, common.bounded_sample(docs.coalesce(1), 50, "_id", "_text").collect()))
    assert common.bounded_sample(docs, 10**6, "_id", "_text").count() == 6011
    assert common.bounded_sample(docs.filter("_text = 'same'"), 50, "_id", "_text").count() == 1
    assert common.bounded_sample(docs.limit(0), 50, "_id", "_text").count() == 0


def test_fits_on_null_ids(spark, monkeypatch):
    """10,000 rows of null ids, and an id with thousands of texts: no more rows than asked are fitted on, and the models still work."""
    rng = random.Random(4)
    words = {"en": "the of and house water think great going there".split(), "fr": "le la et maison eau penser grand aller avec".split()}
    text = lambda lang, n=12: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(None if k % 2 else 7, text(lang := ("en", "fr")[k // 2 % 2]), lang) for k in range(10_000)] + [(None, "le la", "fr")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    seen = []
    monkeypatch.setattr(quality, "train_scorer", lambda g, b, t: seen.append(len(g)) or (np.zeros(quality.BUCKETS), np.zeros(len(quality.LABELLERS) * quality.BINS), 0.0))
    quality.fit_quality(docs, fit_docs=50)
    assert seen == [50]

    model = language_id.fit_language_model(docs, fit_docs=100)
    got = language_id.identify_languages(docs.limit(40), model).collect()
    assert {r.lang_pred for r in got} <= {"en", "fr"} and len(model.languages) == 2
    right = language_id.identify_languages(docs.limit(200), model, keep_columns=True).filter("_lang_pred = lang").count()
    assert right >= 195

    labels = spark.createDataFrame([(7, 1), (7, 0), (9, 0), (None, 1)], "doc_id long, toxic int")
    tables = written(spark, monkeypatch, toxicity)
    more = docs.unionByName(spark.createDataFrame([(9, text("en"), "en") for _ in range(20)], docs.schema))
    model = toxicity.fit_toxicity(more, labels, fit_docs=50)
    assert max(tables["labelled"]) <= 100
    assert 0 <= toxicity.score_toxicity(more.limit(3), model).first().score <= 1


def test_quality_scorer_against_plain_python(spark):
    """Scores of whole texts are what the model's weights give, trigram by trigram, whatever texts stand beside them."""
    rng = np.random.default_rng(5)
    model = quality.QualityModel(quality.even_label_model(), rng.normal(size=quality.BUCKETS), rng.normal(size=len(quality.LABELLERS) * quality.BINS), 0.3)
    texts = ["", "a", "ab", "abc", "Some words, and some more.\nÜber alles 12 34", "x " * 5000, None, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        words = common.Words([raw])
        every = quality._buckets(words)
        grams = [model.grams[every[1 + j]] for j in range(len(raw) - 1)]  # the last one ends with the space after the text
        bins = quality._bins(quality.statistics(words, 1))[0]
        z = (sum(grams) / len(grams) if grams else 0.0) + sum(model.bins[b] for b in bins) + model.bias
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-9, k


# fuzzy passages

RECALL = {(50, 0.85): 75, (50, 0.9): 90, (50, 0.95): 97, (60, 0.85): 88, (60, 0.9): 95, (80, 0.85): 93, (80, 0.9): 97, (100, 0.82): 93, (100, 0.85): 95}


def test_recall_of_fuzzy_passages(spark):
    """Of 100 planted pairs of each length and part of equal words, spread at random, so many at least are found, at the right place."""
    rng = random.Random(11)
    word = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows, planted = [], {}
    for n, equal in RECALL:
        for _ in range(100):
            passage = word(n)
            copy = list(passage)
            for at in rng.sample(range(1, n - 1), round(n * (1 - equal))):
                copy[at] = f"c{rng.randrange(10**6)}"
            i = len(rows)
            rows += [(i, " ".join(word(40) + passage + word(40))), (i + 1, " ".join(word(33) + copy + word(50)))]
            planted[i] = (n, equal)
    found = dict.fromkeys(RECALL, 0)
    for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id in planted:
            n, equal = planted[r.doc_id]
            inside = min(r.last_word, 39 + n) - max(r.first_word, 40) + 1
            assert r.partner_id == r.doc_id + 1 and inside >= 0.8 * (r.last_word - r.first_word + 1) and r.identity >= 0.8
            found[n, equal] += 1
    assert all(found[k] >= least for k, least in RECALL.items()), found


def test_batches_are_small_within_scratch(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t"))
    most = lambda: texts.mapInArrow(run, "n long").agg(F.max("n")).first()[0]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    with common.scratch(spark):
        assert most() < 2 * common.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    try:
        with common.scratch(spark):
            assert most() < 2 << 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
