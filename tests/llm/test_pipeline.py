"""The pipeline on a small table, against what its stages should leave."""

import random

import pytest

import corpus_pipeline

WORDS = {"en": "the of and house water think great going there", "fr": "le la et maison eau penser grand aller là"}


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    text = lambda lang: " ".join(rng.choice(WORDS[lang].split()) + str(rng.randrange(50)) for _ in range(60))
    rows = [(k, text(lang := "en" if k % 3 else "fr"), lang, f"s{k % 2 * k % 3}", 1) for k in range(60)]
    copies = [(100 + k, rows[k][1], rows[k][2], "s0", 1) for k in range(5)]
    odd = [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "12 34", None, "s1", 5), (None, text("en"), "en", "s1", 1)]
    docs = spark.createDataFrame(rows + copies + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {r[0] for r in rows + copies} | {None}
        if name == "exact_dedup":
            assert ids == {r[0] for r in rows[5:] + copies} | {None}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Rows of run() against plain Python: letters, the largest id of equal texts, the smallest of near copies, the library's pieces."""
    import re

    import sentencepiece
    from inkveil.llm.near_dedup import shingles
    from inkveil.llm.sentencepiece_trie import MODEL_PATH

    rng = random.Random(31)
    text = lambda lang: " ".join(rng.choice(WORDS[lang].split()) + str(rng.randrange(90)) for _ in range(70))
    texts = {k: text("en" if k % 3 else "fr") for k in range(50)}
    texts |= {100 + k: texts[k] for k in range(8)} | {110: texts[0], 200: None, 201: "", 202: "12 34", 203: "  \n"}
    for k in range(10, 20):  # one word of 70 changed: five shingles of 66
        words = texts[k].split()
        words[30] = "another"
        texts[300 + k] = " ".join(words)
    rows = [(k, t, "en" if k % 3 else "fr", f"s{k % 2}", 1) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {k: t for k, t in texts.items() if t and re.search("[^\\W\\d_]", t)}
    kept = {k: t for k, t in kept.items() if k == max(j for j in kept if kept[j] == t)}
    sets, label = {k: shingles(t.encode()) for k, t in kept.items()}, {k: k for k in kept}
    near = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in near:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    kept = {k: t for k, t in kept.items() if label[k] == k}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.ids == library.encode(kept[r.doc_id]) and r.n_pieces == len(r.ids)
    assert times.keys() == kept.keys() and len(near) >= 10 and max(times.values()) <= 3


@pytest.mark.parametrize("pairs_each", [2, 0])
def test_near_copies(spark, monkeypatch, pairs_each):
    """One changed word of 100 or five of 300 (Jaccard about 0.9) are near copies, in small buckets and in large ones."""
    from inkveil.llm import near_dedup
    from inkveil.llm.near_dedup import shingles

    monkeypatch.setattr(near_dedup, "PAIRS_EACH", pairs_each)  # 0: large buckets go through turns
    monkeypatch.setattr(near_dedup, "TURNS", 2)
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"new{rng.randrange(10**6)}"
        return words

    texts, many, other = {}, word(300), word(200)
    for k in range(30):
        texts[k] = word(100 if k % 2 else 300)
        texts[100 + k] = changed(texts[k], 1 if k % 2 else 5)
        texts[200 + k] = changed(texts[k], 12 if k % 2 else 40)
    texts |= {300 + k: changed(many, 2) for k in range(40)} | {400 + k: many[:110] + word(190) for k in range(40)} | {500 + k: changed(other, 3) for k in range(25)}
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    sets = {k: shingles(t.encode()) for k, t in rows}
    component = {k: k for k in sets}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in near:
            component[a] = component[b] = min(component[a], component[b])
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (900, ""), (901, None)], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert sorted(k for k in got if k is not None) == sorted([k for k in component if component[k] == k] + [900]) and None in got
    assert not {100 + k for k in range(30)} & set(got)


def test_near_copies_by_simhash(spark, monkeypatch):
    """SimHash gives candidates, of which the similarity is checked; of the tables on the way only the ids that are left out stay."""
    import os

    from inkveil.llm import common, near_dedup, simhash

    paths, new_path = [], common.new_path
    monkeypatch.setattr(common, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    other = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "many " * 4), (2, "many " * 5), (3, other), (5, other.upper()), (4, None), (None, other)], "doc_id long, text string")
    assert {tuple(r) for r in simhash.links(docs).collect()} == {(1, 2), (3, 5)}
    paths.clear()
    # without the prefix filter's keys
    monkeypatch.setattr(near_dedup, "_shared_keys", lambda rows: spark.createDataFrame([], "id long, m int, cap int, k long"))
    out = corpus_pipeline.dedup_near(spark, docs, "")
    left = [p for p in paths if os.path.exists(p.replace("file://", ""))]
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4]
    assert len(paths) > 5 and len(left) == 1 and "gone-" in left[0]
