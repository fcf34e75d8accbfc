"""License scans, importance resampling and spelling variants against brute force, with nulls, empty, long and repeated texts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from inkveil.llm import importance, license_scan, spelling
from inkveil.llm.license_scan import LEAST_RUN, PHRASES, TEMPLATES, Automaton, Scanner

SCHEMA = "doc_id long, text string, _id int, _text string, word string, score int, rank int, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, 4) for i, t in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


# licences


def test_statistics_are_the_longest_matches():
    rng = random.Random(1)
    for _ in range(40):
        known = [[rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        text = [rng.randrange(5) for _ in range(40)]
        automaton = Automaton.of(known)
        every = {tuple(s[a:b]): set() for s in known for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for k, s in enumerate(known):
            for a, b in itertools.combinations(range(len(s) + 1), 2):
                every[tuple(s[a:b])].add((k, b - 1))
        for at, (size, state) in enumerate(automaton.statistics(text)):
            assert size == max(n for n in range(at + 2) if n == 0 or tuple(text[at + 1 - n : at + 1]) in every)
            if size:
                assert automaton.ends[state] == every[tuple(text[at + 1 - size : at + 1])]


def test_runs_lose_no_match():
    scanner = Scanner(list(TEMPLATES), PHRASES, LEAST_RUN, 40, 0.6)
    rng = random.Random(2)
    vocabulary = sorted({w for _, t in TEMPLATES for w in words_of(t)}) + ["other", "words"]
    texts = []
    for _ in range(60):
        parts = [rng.choice(vocabulary) for _ in range(30)]
        source = words_of(rng.choice(TEMPLATES)[1])
        a = rng.randrange(len(source))
        parts[10:10] = source[a : a + rng.randrange(3, 20)]
        texts.append(" ".join(parts).encode())
    words = license_scan.words_of(texts)
    numbers = scanner.numbers(words)
    covered = {k for a, b in scanner.runs(words, numbers) for k in range(a, b)}
    for row in range(len(texts)):
        a, b = words.first[row], words.first[row + 1]
        for at, size, _ in scanner.automaton.blocks(numbers[a:b].tolist(), LEAST_RUN):
            assert set(range(a + at - size + 1, a + at + 1)) <= covered


def changed(text, every):
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_licenses(spark):
    by_label = {label: text for label, text in TEMPLATES}
    mit, apache = by_label["mit-text"], by_label["apache-2.0-text"]
    rows = [
        (1, "Some words. Released under the MIT License. More. MIT license, mit-LICENSE"), (2, None), (3, ""), (4, "--- ???"), (4, "mit"), (None, "the general public\nlicense"),
        (5, "before " + mit.upper() + " after"), (6, changed(mit, 12)), (7, changed(mit, 4)), (8, "w " * 60_000 + apache), (9, mit + " x " + apache + " " + mit),
        (10, "mit"), (11, "license apache license"), (12, "Übung MİT license mit\x00license Licensed under CC BY-NC 4.0."), (13, "a mit ☃ license"),
    ]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in rows)
    want = {}
    for i, t in rows:
        words = words_of(t)
        places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p := phrase.split())] == p]
        at = sorted(k for k, _ in places)
        want.setdefault(i, []).append((len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert all(s.first_word <= s.last_word < r.n_words and s.coverage >= license_scan.LEAST_COVER for s in r.spans)
    rows_of = {r.doc_id: r for r in got if r.doc_id != 4}
    assert "mit-notice" in rows_of[1].labels and rows_of[1].n_base == 3
    assert rows_of[5].labels == "mit-text" and rows_of[5].score == 1.0 and (rows_of[5].spans[0].first_word, rows_of[5].spans[0].last_word) == (1, len(words_of(mit)))
    assert rows_of[6].labels == "mit-text" and rows_of[6].score > 0.75
    assert "mit-text" not in rows_of[7].labels  # runs of three words are no evidence
    assert [s.label for s in rows_of[8].spans if s.label == "apache-2.0-text"] and rows_of[8].spans[0].first_word >= 60_000
    assert [s.label for s in rows_of[9].spans if s.label.endswith("text")] == ["mit-text", "apache-2.0-text", "mit-text"]
    assert "cc-by-nc-4.0-notice" in rows_of[12].labels and rows_of[12].n_base == 1
    assert rows_of[2].score == 0 and rows_of[2].labels == "" and rows_of[13].n_base == 0
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


# importance


def brute_resample(rows, target, longest, least_words, percent, n=importance.BUCKETS):
    def found(text):
        words = words_of(text)
        return [zlib.crc32(" ".join(words[a : a + k]).encode()) % n for k in range(1, longest + 1) for a in range(len(words) - k + 1)]

    here, there = [found(t) for _, t in rows], [b for t in target for b in found(t)]
    s, t = [0] * n, [0] * n
    for b in itertools.chain(*here):
        s[b] += 1
    for b in there:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n) / ((s[b] + 1) * (sum(t) + n)))) for b in range(n)]
    out = []
    for (i, text), bs in zip(rows, here, strict=True):
        weight = math.floor(sum(gain[b] for b in bs) / len(bs)) if bs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least_words])
    among = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(among) // 100
    rank = {id(r): k + 1 for k, r in enumerate(among[:drawn])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("longest", "percent"), [(1, 30), (2, 10), (3, 100), (1, 0)])
def test_resample(spark, longest, percent):
    rng = random.Random(5)
    vocabulary = [f"Word{k}" for k in range(50)] + ["Été", "straße", "İx", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(1, 40))) for k in range(120)] + [(200, None), (201, ""), (202, " \n?"), (203, text(30_000)), (None, text(30)), (None, text(30))]
    target = [text(20) for _ in range(5)] + [None, ""]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs(spark, rows), table, longest=longest, percent=percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_resample(rows, target, longest, 20, percent)))


def test_resample_of_ties_and_nothing(spark):
    table = spark.createDataFrame([(1, "word")], "item_id long, text string")
    rows = [(7, "same words " * 15)] * 200 + [(8, "too few")]
    got = importance.resample(docs(spark, rows), table).collect()
    assert sorted(r.rank for r in got if r["rank"] is not None) == list(range(1, 21))
    assert importance.resample(docs(spark, []), table).count() == 0
    got = importance.resample(docs(spark, rows[-1:]), table.limit(0)).collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(2, None)]


# spelling


def brute_one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(rows, least=7):
    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if brute_one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_deletion_keys():
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)} | {"", "é" * 5, "aàb"}
    by_key = {}
    for w in words:
        keys, lo, hi = spelling.deletion_keys(w)
        cuts = [w] + [w[:k] + w[k + 1 :] for k in lo[1:].tolist()]
        assert set(cuts[1:]) == {w[:k] + w[k + 1 :] for k in range(len(w))} and len(set(cuts[1:])) == len(cuts) - 1
        assert all(w[:k] + w[k + 1 :] == c for c, a, b in zip(cuts[1:], lo[1:], hi[1:], strict=True) for k in range(a, b + 1))
        for k, c in zip(keys.tolist(), cuts, strict=True):
            assert by_key.setdefault(k, c) == c
    assert len(set(by_key.values())) == len(by_key)


def test_spelling(spark):
    rng = random.Random(6)
    bases = ["committee", "Separate", "aaaaaaaa", "naïveté", "straßenbahn", "ÀÉÎÕÜÿç", "abababab"]
    letters = "abcdeéÿ"

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])

    rows = []
    for k in range(400):
        ws = [rng.choice(bases) for _ in range(6)] + [edited(rng.choice(bases))] + ([edited(edited(rng.choice(bases)))] if k % 3 == 0 else [])
        rows.append((k, ", ".join(ws)))
    rows += [(1000 + k, "separate " * 3000) for k in range(2)] + [(2000, None), (2001, ""), (2002, "1234"), (None, "committee comittee"), (None, "committee"), (3, "x" * 3000 + " " + "x" * 3000)]
    rows += [(4000 + k, "seperate " * 20 + "sepperate " * 2) for k in range(3)]  # a form with a form
    long = "".join(rng.choice(letters) for _ in range(2000))
    rows += [(3000, f"{long} {long} {long[:700]}z{long[701:]} {long[:700]}z{long[701:]}")]
    got = spelling.spelling_variants(docs(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_spelling(rows)
    assert {tuple(r) for r in got.collect()} == want and len({r[2] for r in want}) < len(want)
    assert any(r[1] and r[1] != r[2] for r in want)  # roots beyond forms
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
