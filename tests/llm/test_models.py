"""Language ID, toxicity, quality, mixing, WARC packages, SentencePiece."""

import base64
import hashlib
import math
import random
import struct
import zipfile

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from inkveil.llm import language_id, mixing, quality, sentencepiece_trie, toxicity, warc_zip

WORDS = {"en": "the of and house water think great going there", "de": "der die und schön straße nicht gehen größe über", "ru": "и в не что дом вода большой человек"}


def sentence(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(k, sentence(lang, 40, rng), lang) for k, lang in enumerate(list(WORDS) * 30)] + [(999, None, "en"), (998, "text", None)]
    return language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language(spark, model):
    rng = random.Random(2)
    mixed = sentence("en", 30, rng) + " " + sentence("de", 12, rng) + "\n" + sentence("ru", 6, rng)
    rows = [(1, sentence("en", 20, rng)), (2, sentence("de", 20, rng)), (3, sentence("ru", 3, rng)), (4, mixed), (5, None), (6, ""), (7, "123 !!"), (None, "the house"), (1, "und nicht")]
    docs = spark.createDataFrame([(i, t, "zz", 3) for i, t in rows], "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify_languages(docs, model).collect()]
    assert [x[1] for x in got] == ["en", "de", "ru", "en", "und", "und", "und", "en", "de"]
    assert all(0 <= s <= 1 for *_, s in got) and got[3][2] < 0.9
    spans = [(r.first_word, r.last_word, r.lang) for r in language_id.language_spans(docs.filter("doc_id = 4"), model).orderBy("first_word").collect()]
    assert spans == [(0, 29, "en"), (30, 41, "de"), (42, 47, "ru")]
    assert language_id.identify_languages(docs.limit(0), model).count() == 0
    empty = language_id.fit_language_model(docs.limit(0))
    assert language_id.identify_languages(docs.limit(2), empty).first().lang_pred == "und"


def test_viterbi_is_the_best_path(model):
    import itertools

    text = "the der house nicht and".encode()
    words, label = model.spans([text], penalty=3.0)
    score = np.array([[np.cumsum(np.r_[0, model.scores[k][words.bucket]])[[s - 1, e]] @ [-1, 1] for k in range(3)] for s, e in zip(words.start, words.end, strict=True)])
    score = score[:, :2]  # the third language has another script
    path_score = lambda p: sum(score[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    assert math.isclose(path_score(label.tolist()), max(map(path_score, itertools.product(range(2), repeat=5))), rel_tol=1e-6)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distance():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0, "moron": 1.0, "größer": 1.0})
    rng = random.Random(4)
    for _ in range(1500):
        w = list(rng.choice(list(lexicon.weights)))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "ö", "i"])
        w = "".join(w)
        near = [(d, t) for t in lexicon.weights if (d := distance(w, t)) == 0 or d == 1 and len(t) >= toxicity.FUZZY_LETTERS]
        got = lexicon.nearest(w)
        assert (got is None) == (not near) and (got is None or (got[1], got[0]) in near and got[1] == min(near)[0]), w
        if near and w:
            assert len(lexicon.hits([w.encode()])) == 1, w  # the filter by halves loses nothing


def test_toxicity(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ri", "su") for b in ("lum", "nat", "pet", "rag", "vis")]
    text = lambda bad: " ".join([rng.choice(vocabulary) for _ in range(30)] + ["idiot", "moron"] * bad)
    docs = spark.createDataFrame([(k, text(k % 4 == 0)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    fitted = toxicity.fit_toxicity(docs, labels)
    assert set(fitted.lexicon.weights) == {"idiot", "moron"}
    cases = spark.createDataFrame([(1, "you IDIOT and moron"), (2, "what an idiiot, a m0ron"), (3, 'she said "idiot" once'), (4, "balum konat"), (5, None), (6, ""), (None, "moron idiot")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(cases.withColumn("score", F.lit(1)), fitted).collect()}
    assert [got[k].predicted for k in (1, 4, 5, 6, None)] == [1, 0, 0, 0, 1]
    assert got[1].score > got[2].score > got[4].score and got[1].score > got[3].score and got[5].score == got[6].score
    hits = {(r.term, r.errors, r.quoted) for r in toxicity.toxic_hits(cases.filter("doc_id in (2, 3)"), fitted).collect()}
    assert hits == {("idiot", 1, False), ("moron", 1, False), ("idiot", 0, True)}
    assert toxicity.score_toxicity(cases.limit(0), fitted).count() == 0
    assert toxicity.fit_toxicity(docs, labels.filter("toxic = 0")).lexicon.weights == {}


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    good = lambda: " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(80)).capitalize() + "."
    bad = [lambda: " ".join(word() + "%%%" for _ in range(60)), lambda: "spam " * 90, lambda: good().upper(), lambda: " | ".join(word() for _ in range(60))]
    rows = [(k, good() if k % 5 else bad[k // 5 % 4]()) for k in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, rows[1][1])], "doc_id long, text string")
    found = quality.score_quality(docs, quality.fit_quality(docs)).collect()
    right = sum(r.kept == bool(r.doc_id % 5) for r in found if r.doc_id is not None and r.doc_id < 1000)
    assert len(found) == 403 and right >= 392
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0))).count() == 0


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), "big" if k % 10 else f"s{k % 30}") for k in range(600)] + [(900, None, "big"), (901, "", None), (902, "a b", None), (None, "x y z", "big")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, tokens int")
    got = mixing.mixture(docs, value=0.9, block_tokens=200).collect()
    assert len(got) == len(rows)
    size, taken, alpha = {}, {}, got[0].alpha
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.tokens
        taken[r.source] = taken.get(r.source, 0) + r.tokens * r.copies
    total = sum(size.values())
    weight = {s: (n / total) ** alpha for s, n in size.items() if n}
    z = sum(weight.values())
    entropy = lambda a: (lambda w: -sum(x * math.log(x) for x in w))([(n / total) ** a / sum((m / total) ** a for m in size.values() if m) for n in size.values() if n])
    assert entropy(alpha) >= 0.9 * math.log(len(weight)) > entropy(alpha + 2 / 2**20)
    for s, w in weight.items():
        assert 0 <= taken[s] - int(w / z * total + 1e-6) < 40
    mixed = mixing.mix(docs.union(docs.filter("doc_id = 3")), target="repetition", value=2.0, cover=True, block_tokens=200)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and {i for i, t, s in rows if s} <= set(counts) and counts[3] % 2 == 0
    assert max(n for i, n in counts.items() if i != 3) <= 3
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/b c", "same"), (1, None, "same"), (2, "http://x", None), (4, "u", ""), (5, "u", "é" * 1000), (5, "u", "é" * 1000), (None, "n", "null id"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.through_archives(pages, f"file://{tmp_path}/w").collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(3, 4, digest("same"), "revisit", 1), (1, 4, digest("same"), "response", None), (2, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 2)]
    want += [(5, 2000, digest("é" * 1000), "response", None)] * 2 + [(None, 7, digest("null id"), "response", None), (None, 4, digest("same"), "revisit", 1)]
    assert got == sorted(want, key=str)
    back = warc_zip.read_archives(warc_zip.write_archives(pages, f"{tmp_path}/v")).collect()
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {"same", "", "é" * 1000, "null id"}
    assert warc_zip.through_archives(pages.limit(0)).count() == 0


def test_zip_directories(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("plain", b"12345")
        z.writestr(zipfile.ZipInfo("ünicode"), b"abc")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    data = path.read_bytes()
    # the same archive with a ZIP64 end record and locator
    end = data.rindex(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", data, end + 10)
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    (tmp_path / "b.zip").write_bytes(data[:end] + big + data[end : end + 8] + struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + data[end + 20 :])
    for name in ("a.zip", "b.zip"):
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            found = warc_zip.members(f)
            assert set(found) == {"plain", "ünicode", "packed"}
            member = warc_zip.locate(f, found["plain"])
            assert warc_zip._range(f, member.start + 1, 3) == b"234"
            with pytest.raises(warc_zip.BadPackage):
                warc_zip.locate(f, found["packed"])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "c.zip")) as f, pytest.raises(warc_zip.BadPackage):
        warc_zip.members(f)


def test_toxic_words_within_marks_and_rare_terms(spark):
    lexicon = toxicity.Lexicon({"loser": 3.0, "scum": 2.0})
    texts = [b"loser!!!!!", b"scum!!!!", b"((((((scum))))))", b"\"\"\"\"loser", b"!!!!!!", b"----- ????", b""]
    assert [(row, term, errors) for row, term, errors, _ in lexicon.hits(texts)] == [(0, "loser", 0), (1, "scum", 0), (2, "scum", 0), (3, "loser", 0)]
    rows = [(k, f"word{k % 7} " + ("badterm" if k % 100 else "") + (" rareterm" if k % 200 == 0 else ""), 1) for k in range(7000)] + [(k, f"word{k % 7} clean{k}", 0) for k in range(7000, 14000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).lexicon.weights
    assert found.keys() == {"badterm", "rareterm"}


def test_marks_when_memory_is_full(monkeypatch):
    own = sentencepiece_trie.load_model.__wrapped__()
    texts = ["a▁b ▁\0mark", "plain words here", "x▁▁y z", "more other words ▁"]
    want = [own.encode([t])[0] for t in texts]
    assert [own.decode(x) for x in want] == texts
    monkeypatch.setattr(sentencepiece_trie, "MEMORY", 3)
    for _ in range(3):
        assert own.encode(texts) == want and [own.encode([t])[0] for t in texts] == want


def test_pieces_equal_the_library(spark):
    import sentencepiece

    own, library = sentencepiece_trie.load_model(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL_PATH)
    rng = random.Random(8)
    texts = ["", " ", "  Hello  world\n\nfoo é 你好\t日本 x ", "aaaaaaaa       bbbb", "𝄞x́", "internationalization Straße ﬁ 12345 ....-----=====", "def f(x):\n    return x\n"]
    texts += ["".join(rng.choice("etaoin shrdlu\n.ñé") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    got = own.encode(texts)
    assert got == library.encode(texts)
    assert [own.decode(x) for x in got] == texts
    assert own.decode(own.encode(["a▁b"])[0]) == "a▁b"
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "y")], "doc_id long, text string, ids string")
    assert docs.count() == sentencepiece_trie.piece_digests(docs, own).filter("round_trip").count()
    back = {r.doc_id: r.text for r in sentencepiece_trie.decode_pieces(sentencepiece_trie.encode_pieces(docs, own), own).collect()}
    assert back == dict(enumerate(texts)) | {None: ""}
    assert sentencepiece_trie.encode_pieces(docs.limit(0), own).count() == 0


def test_unigram_takes_the_best_sum():
    import itertools

    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    scores = [0.0] * 256 + [-2.5, -2.0, -2.1, -3.3, -3.1, -3.9, -5.05]
    own = sentencepiece_trie.PieceModel(pieces, scores, kind="unigram")
    value = dict(zip(pieces, scores, strict=True))
    for text in map("".join, itertools.product("ab", repeat=5)):
        word = "▁" + text
        best = [0.0] + [-1e9] * len(word)
        for i in range(1, len(word) + 1):
            best[i] = max(best[j] + value[word[j:i]] for j in range(i) if word[j:i] in value)
        assert math.isclose(sum(scores[i] for i in own.encode([text])[0]), best[-1])


def test_long_words_and_common_starts():
    """A word of a megabyte without spaces, and words that agree in their first hundred characters."""
    import sentencepiece

    rng = random.Random(11)
    own, library = sentencepiece_trie.load_model.__wrapped__(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL_PATH)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    head = long[:100]
    texts = [long, f"{head}x {head}y {head} {head[:24]} {head[:25]}\0 {head[:24]}\0"]
    got = own.encode(texts)
    assert own.decode(got[0]) == long and got[1] == library.encode(texts[1]) and got[0][:2000] == library.encode(long[:8000])[:2000]
    words = sorted({"a" * n + "b" * m for n in range(30) for m in range(3)} | {"", "\0", "a\0"})
    want = [0] + [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(words, words[1:], strict=False)]
    assert sentencepiece_trie._common_starts(words) == want


def test_letters_decide_about_und(spark, model):
    rng = random.Random(3)
    rows = [(1, "සිංහල"), (2, "१२३ ४५६"), (3, "٣٤٥ ।"), (4, "ꓡꓲꓢꓴ"), (5, "བོད"), (6, "。 ！"), (7, "১২৩ the house"), (8, "ᏣᎳᎩ the house and water"), (9, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (2, 3, 6, 9))
    assert all(got[k][0] in model.languages and got[k][1] == 0.0 for k in (1, 4, 5)) and got[7] == got[8] == ("en", 1.0)
    kept = language_id.identify_languages(spark.createDataFrame([(1, "the house", 0.5), (1, None, None)], "doc_id long, text string, score double"), model, keep_columns=True)
    assert [tuple(r) for r in kept.collect()] == [(1, "the house", 0.5, "en", 1.0), (1, None, None, "und", 0.0)]
    with pytest.raises(ValueError):
        language_id.fit_language_model(spark.range(1100).selectExpr("id as doc_id", "'x' as text", "id as lang"))
    assert sentence("en", 3, rng)


def test_one_long_text_among_short_ones(model):
    """A text of 4 MB with 255 short ones, labelled as if each stood alone, in memory by the words."""
    import tracemalloc

    rng = random.Random(6)
    texts = [sentence("en", 700_000, rng).encode()] + [sentence(rng.choice(["en", "de"]), rng.randrange(1, 30), rng).encode() for _ in range(255)]
    alone = [model.predict([t])[0] for t in texts[1:]]
    tracemalloc.start()
    got = model.predict(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [("en", 1.0), *alone] and most < 400e6


def test_toxicity_scores_against_brute_force():
    """Scores from every word's distance to every term."""
    rng = random.Random(12)
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0, "x": 1.5, "moron": 1.0, "größer": 1.0, "a" * 60: 2.5}, frozenset({"idiom", "maron"}))
    own = toxicity.ToxicityModel(lexicon, np.array([1.0, 0.4, 0.7, 0.2, -3.0]))
    words = ["idiot", "idiom", "idio", "(idiot!!!)", "scum", "scums", "x", "xx", "maron", "moro", "gröser", "a" * 59, '"scum"', "called", "plain", "words", "here", "...", "said"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)] + ["plain " * 50_000 + "idiot", ""]
    for text, got in zip(texts, own.scores([t.encode() for t in texts]), strict=True):
        found, sums = text.split(), dict.fromkeys(toxicity.FEATURES, 0.0)
        for i, raw in enumerate(found):
            w = raw.strip(toxicity.EDGES)
            near = [(d, -v, t) for t, v in lexicon.weights.items() if w and abs(len(w) - len(t)) < 2 and ((d := distance(w, t)) == 0 or d == 1 and len(t) >= toxicity.FUZZY_LETTERS)]
            if not near or min(near)[0] and w in lexicon.innocent:
                continue
            errors, minus, _ = min(near)
            at = raw.index(w)
            before, after = " ".join([*found[max(0, i - 6) : i], raw[:at]]), " ".join([raw[at + len(w) :], *found[i + 1 : i + 7]])
            mentioned = any(x.strip(toxicity.EDGES) in toxicity.MENTIONS for x in before.split()[-2:])
            quoted = sum(before.count(q) for q in toxicity.QUOTES) % 2 == 1 and any(q in after for q in toxicity.QUOTES) or mentioned
            sums[("exact", "fuzzy")[errors] + "_quoted" * quoted] -= minus
        z = sum(c * math.log1p(v) for c, v in zip(own.coefficients, sums.values(), strict=False)) + own.coefficients[-1]
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9), text[:300]


def test_contradictory_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} w{k} " + ("badterm" if k < 20 else "clean")) for k in range(200)], "doc_id long, text string")
    labels = [(k, int(k < 20)) for k in range(200)] + [(k, 0) for k in range(20)] * 2
    for order in (labels, labels[::-1]):
        found = toxicity.fit_toxicity(docs, spark.createDataFrame(order, "doc_id long, toxic int").repartition(3))
        assert set(found.lexicon.weights) == {"badterm"}


def test_label_model_recovers_simulated_labellers():
    """Documents of known kinds: EM finds how labellers vote and the part of good documents, at any size, and equals EM by rows."""
    rng = np.random.default_rng(5)
    n, faults = 40_000, np.array([g == quality.NEVER for _, g, _ in quality.LABELLERS])
    on_good, on_bad = np.where(faults[None, :, None], [[[0.995, 0.005, 0.0]], [[0.85, 0.15, 0.0]]], [[[0.15, 0.005, 0.845]], [[0.3, 0.1, 0.6]]])
    for good in (0.55, 0.8):
        kind = rng.integers(1, len(faults) + 1, n) * (rng.random(n) > good)  # 0: good
        each = np.stack([on_good] + [np.where(np.arange(len(faults))[:, None] == k, [0.1, 0.9, 0.0], on_bad) for k in range(len(faults))])
        rates, true = np.stack((each[1:].mean(axis=0), on_good)), kind == 0
        found = (rng.random((n, len(faults), 1)) > each[kind].cumsum(axis=2)[:, :, :2]).sum(axis=2)
        rows, counts = np.unique(found, axis=0, return_counts=True)
        own = quality.fit_label_model(rows, counts.astype(float))
        assert abs(own.good - good) < 0.05 and np.abs(own.accuracies() - rates).max() < 0.08
        assert ((own.posterior(found) > 0.5) == true).mean() > 0.9
        many = quality.fit_label_model(rows, counts * 1e6)
        assert np.allclose(many.rates, own.rates, atol=1e-6)
        by_rows = quality.fit_label_model(found[:2000], np.ones(2000))
        grouped = quality.fit_label_model(*(lambda a, c: (a, c.astype(float)))(*np.unique(found[:2000], axis=0, return_counts=True)))
        assert np.allclose(by_rows.rates, grouped.rates, atol=1e-6)


def test_quality_of_odd_rows(spark):
    """Extra columns of clashing names, repeated rows, a very long text, ties at the threshold."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows = [(k, " ".join(word() for _ in range(60)) if k % 3 else "%%% ### " * 40) for k in range(90)] + [(3, "%%% ### " * 40)] * 2 + [(200, " ".join(word() for _ in range(200_000)))]
    docs = spark.createDataFrame([(k, t, 9.0, "x", True) for k, t in rows], "doc_id long, text string, score double, weak_label string, kept boolean")
    own = quality.fit_quality(docs)
    got = quality.score_quality(docs, own).collect()
    assert len(got) == len(rows) and all(r.kept == (r.score >= 0.5) for r in got) and {r.kept for r in got if r.doc_id == 200} == {True}
    assert len({(r.score, r.kept) for r in got if r.doc_id == 3}) == 1
    level = quality.QualityModel(own.labels, np.zeros(quality.BUCKETS), np.zeros(len(quality.LABELLERS) * quality.BINS), 0.0)
    assert {(r.score, r.kept) for r in quality.score_quality(docs, level).collect()} == {(0.5, True)}
