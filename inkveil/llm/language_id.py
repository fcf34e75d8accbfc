"""Language ID by spans: script ranges narrow each word's candidates, byte trigrams score it, and Viterbi with a penalty for
each switch labels runs of words, so a text of several languages gets several spans.

The model is learned from labelled documents: for each language the counts of hashed byte trigrams within words, and the
scripts of its words. It has languages x BUCKETS numbers, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Words, give_back, slices, unit_hash

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 15

#: Labelled documents a language is fitted on, at most in expectation: beyond, a share of its documents by hash of the id.
FIT_DOCS = 2000

#: Labels from which on the fit raises an error: a column with as many holds no languages.
TOO_MANY_LABELS = 1000

#: Words times languages that one pass labels; bounds a task's memory.
CELLS = 1 << 22

#: Text bytes of one pass: about sixty bytes of memory for each.
SLICE_BYTES = 1 << 20

#: Log-odds that a switch of language between two words costs.
SWITCH_PENALTY = 8.0

#: Label of a text without a letter.
UNDETERMINED = "und"

# First and last code point of blocks and their script. Digits and signs in them count for no script.
SCRIPT_RANGES = [
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00AA, 0x00AA, "latin"), (0x00BA, 0x00BA, "latin"),
    (0x00C0, 0x00D6, "latin"), (0x00D8, 0x00F6, "latin"), (0x00F8, 0x024F, "latin"), (0x0250, 0x02AF, "latin"),
    (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0531, 0x058F, "armenian"), (0x05D0, 0x05F2, "hebrew"),
    (0x0620, 0x06D3, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"),
    (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E01, 0x0E4E, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"),
    (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3041, 0x309F, "kana"),
    (0x30A1, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"),
    (0xF900, 0xFAFF, "han"), (0xFF21, 0xFF3A, "latin"), (0xFF41, 0xFF5A, "latin"), (0xFF66, 0xFF9D, "kana"), (0x20000, 0x3134F, "han"),
]

SCRIPTS = sorted({s for _, _, s in SCRIPT_RANGES})
_FIRST = np.array([a for a, _, _ in SCRIPT_RANGES])
_LAST = np.array([b for _, b, _ in SCRIPT_RANGES])
_BIT = np.array([1 << SCRIPTS.index(s) for _, _, s in SCRIPT_RANGES], np.int64)
#: Code points below are looked up one by one: whether they are letters or marks. Above, blocks hold little else.
_SMALL = 0x3100
_LETTERS = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(_SMALL)])


def _script_bits(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    letter = _LETTERS[np.minimum(points, _SMALL - 1)] | (points >= _SMALL)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]) & letter, _BIT[at], 0)


_ASCII_BITS = _script_bits(np.arange(256)) * (np.arange(256) < 128)


def _byte_scripts(data: np.ndarray) -> np.ndarray:
    """For each byte that begins a letter the bit of its script, else 0."""
    bits = _ASCII_BITS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        pad = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        a, b, c, d = (pad[lead + i] & m for i, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
        points = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        bits[lead] = _script_bits(points)
    return bits


class LetterWords(Words):
    """Words of lower-cased texts with their trigrams and scripts.

    at, bucket: the trigram that begins at each byte from before the word to its last but one. scripts: bits by word.
    """

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        data = np.where(self.data < 0x20, 0x20, self.data).astype(np.uint32)
        tri = np.zeros(len(data), np.uint32)
        tri[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        self.bucket = (tri * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        letters = _byte_scripts(self.data)
        self.letters = np.concatenate(([0], np.cumsum(letters > 0)))
        self.scripts = np.bitwise_or.reduceat(letters, self.start) if len(self.start) else np.zeros(0, np.int64)
        if len(self.start):  # reduceat runs on to the next word: spaces between have no script
            self.n_letters = self.letters[self.end] - self.letters[self.start]
        else:
            self.n_letters = np.zeros(0, np.int64)


@dataclass
class LanguageModel:
    """languages: sorted labels. scores: languages x BUCKETS log-likelihoods, less their mean over languages.

    scripts: for each language the bits of the scripts that its words are written in.
    """

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray

    def spans(self, texts: list[bytes], penalty: float = SWITCH_PENALTY) -> tuple[LetterWords, np.ndarray]:
        """The words of lower-cased texts, and for each the index of its language; -1 without letters or candidates."""
        words, n = LetterWords(texts), len(self.languages)
        label = np.full(len(words.start), -1, np.int64)
        if not n or not len(words.start):
            return words, label
        sizes, at = np.diff(words.first), 0
        while at < len(sizes):  # texts of so many words
            stop = max(at + 1, int(np.searchsorted(words.first, words.first[at] + CELLS // n, "right")) - 1)
            self._label(words, np.arange(at, stop)[sizes[at:stop] > 0], penalty, label)
            at = stop
        return words, label

    def _label(self, words: LetterWords, rows: np.ndarray, penalty: float, label: np.ndarray) -> None:
        """Label the words of some neighbouring texts, none of them without words."""
        if not len(rows):
            return
        lo, hi = int(words.first[rows[0]]), int(words.first[rows[-1] + 1])
        start, end, base = words.start[lo:hi], words.end[lo:hi], int(words.start[lo]) - 1
        score = np.empty((hi - lo, len(self.languages)), np.float32)
        for k, own in enumerate(self.scores):
            sums = np.concatenate(([0], np.cumsum(own[words.bucket[base : end[-1]]], dtype=np.float64)))
            score[:, k] = sums[end - base] - sums[start - 1 - base]
        known = (words.scripts[lo:hi, None] & self.scripts[None, :]) > 0
        some = known.any(axis=1)
        # candidates outside the word's scripts cost more than any score; words of no learned script say nothing
        score = np.where(known, score, np.where(some[:, None], score.min() - 4 * penalty - 1, 0)).astype(np.float32)
        sizes = np.diff(words.first)[rows]
        order = np.argsort(sizes, kind="stable")
        found = np.full(hi - lo, -1, np.int64)
        self._viterbi(score, words.first[rows][order] - lo, sizes[order], penalty, found)
        label[lo:hi] = np.where(some, found, -1)

    def _viterbi(self, score: np.ndarray, first: np.ndarray, sizes: np.ndarray, penalty: float, label: np.ndarray) -> None:
        """Label the words of several texts, one step for all texts at a time; texts are in order of their sizes.

        Back pointers are kept by word: whether each language was stayed in, and else the one that was left.
        """
        steps, n = int(sizes.max()), score.shape[1]
        stay = np.ones((len(score), n), bool)
        best = np.zeros(len(score), np.uint16)
        total = score[first].astype(np.float64)
        begun = np.searchsorted(sizes, np.arange(steps), "right")  # texts from here on have a word at this step
        for t in range(1, steps):
            k = begun[t]
            at = first[k:] + t
            top = total[k:].argmax(axis=1)
            best[at] = top
            jump = np.take_along_axis(total[k:], top[:, None], 1) - penalty
            stay[at] = total[k:] >= jump
            total[k:] = np.maximum(total[k:], jump) + score[at]
        now = total.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = begun[t]
            at = first[k:] + t
            label[at] = now[k:]
            if t:
                now[k:] = np.where(stay[at, now[k:]], now[k:], best[at])

    def predict(self, texts: list[bytes], penalty: float = SWITCH_PENALTY) -> list[tuple[str, float]]:
        """Of lower-cased texts the language of most letters, and its part of the letters of words with a language.

        Of a text without words in a learned script, the language whose trigrams are likeliest, with 0.
        """
        words, label = self.spans(texts, penalty)
        n = len(self.languages)
        if not n:
            return [(UNDETERMINED, 0.0)] * len(texts)
        use = label >= 0
        votes = np.bincount(words.row[use] * n + label[use], words.n_letters[use], len(texts) * n).reshape(len(texts), n)
        top, total = votes.argmax(axis=1), votes.sum(axis=1)
        for k in np.flatnonzero(total == 0).tolist():
            a, b = words.text_start[k], words.text_start[k + 1] - 1
            top[k] = int(np.argmax([own[words.bucket[a : max(a, b - 1)]].sum() for own in self.scores]))
        part = votes[np.arange(len(texts)), top] / np.maximum(total, 1)
        return [(self.languages[t], float(p)) for t, p in zip(top, part, strict=True)]


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> LanguageModel:
    """Learn from the rows of docs with a text and a label. Counts come back by language and bucket, a bounded number.

    Raises an error for more labels than TOO_MANY_LABELS. An empty table gives a model without languages.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter("_text is not null and _lang is not null")
    # rows with equal ids and texts count once, so that they can't fill the sample
    hashed = rows.withColumn("_hash", F.xxhash64("_id", "_text"))
    counts = hashed.select("_lang", "_hash").distinct().groupBy("_lang").count().limit(TOO_MANY_LABELS + 1).collect()
    if len(counts) > TOO_MANY_LABELS:
        raise ValueError(f"{lang_col} has more than {TOO_MANY_LABELS} labels")
    languages = sorted(r["_lang"] for r in counts)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64))
    rates = {r["_lang"]: min(1.0, fit_docs / r["count"]) for r in counts}
    rate = F.create_map(*[x for lang, p in rates.items() for x in (F.lit(lang), F.lit(p))])[F.col("_lang")]
    chosen = hashed.filter(unit_hash("_id", "_text") < F.coalesce(rate, F.lit(0.0))).groupBy("_lang", "_hash").agg(F.lower(F.first("_text")).alias("_text")).drop("_hash")
    index = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(index), BUCKETS), np.int64)
        scripts = np.zeros((len(index), len(SCRIPTS)), np.int64)
        for batch in batches:
            for part, texts in slices(batch, "_text", SLICE_BYTES):
                words = LetterWords(texts)
                lang = np.array([index[x] for x in part.column(0).to_pylist()], np.int64)
                at = _inside(words)
                row = np.searchsorted(words.text_start, at, "right") - 1
                np.add.at(grams, (lang[np.minimum(row, len(lang) - 1)], words.bucket[at]), 1)
                for s in range(len(SCRIPTS)):
                    scripts[:, s] += np.bincount(lang[words.row], words.scripts >> s & 1, len(index)).astype(np.int64)
        both = np.concatenate((grams, scripts), axis=1)
        k, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(both[k, b])], ["k", "b", "n"])

    found = chosen.mapInArrow(run, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    both[found["k"].to_numpy(int), found["b"].to_numpy(int)] = found["n"].to_numpy(float)
    grams, seen = both[:, :BUCKETS] + 0.2, both[:, BUCKETS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True))
    # a script is a language's if a hundredth of its words have it
    bits = (seen > 0.01 * np.maximum(seen.sum(axis=1, keepdims=True), 1)) @ (1 << np.arange(len(SCRIPTS), dtype=np.int64))
    return LanguageModel(languages, (logs - logs.mean(axis=0)).astype(np.float32), bits.astype(np.int64))


def _inside(words: Words) -> np.ndarray:
    """Bytes at which a trigram of a word begins: from the space before it to its last byte but one."""
    size = words.end - words.start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(words.start - 1, size) + at


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: the id, lang_pred, score (0 to 1: the part of the letters that lang_pred's spans hold).

    keep_columns: all columns of docs, then _lang_pred and _score: texts move through the pass, and need no join afterwards.

    `und` with score 0 if the text is null or without a letter (Unicode's property), or the model has no languages. A text whose
    letters are all of scripts that the model hasn't seen gets the language of the likeliest trigrams, with score 0. Ids may be
    null or repeated; rows are judged one by one. An empty table gives an empty result. Other columns are not read.
    """

    # what is carried through: the id, or all columns, the text among them, which then is sent once
    carried = docs.columns if keep_columns else [id_col]
    names = [f"_{k}" for k in range(len(carried))]
    letters = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("_letters")
    text = [] if keep_columns else [F.lower(F.col(text_col)).alias("_text")]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)], letters, *text)
    of_text = names[carried.index(text_col)] if keep_columns else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, of_text, SLICE_BYTES):
                if keep_columns:
                    lower = pc.utf8_lower(part.column(names.index(of_text))).cast(pa.binary())
                    texts = [x or b"" for x in lower.to_pylist()]
                found = model.predict(texts, penalty)
                found = [x if letters else (UNDETERMINED, 0.0) for x, letters in zip(found, part.column(len(names)).to_pylist(), strict=True)]
                lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], lang, score], [*names, "lang_pred", "score"])
            give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.toDF(*carried, *(("_lang_pred", "_score") if keep_columns else ("lang_pred", "score")))


def language_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The spans: the id, first_word, last_word (from 0), lang. Words without letters of a known script join no span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text", SLICE_BYTES):
                words, label = model.spans(texts, penalty)
                use = np.flatnonzero(label >= 0)
                row, lab = words.row[use], label[use]
                turn = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lab[1:] != lab[:-1])][: len(use)])
                last = np.r_[turn[1:], len(use)].astype(int) - 1 if len(turn) else turn
                offset = words.first[row]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row[turn])), pa.array((use - offset)[turn]), pa.array((use - offset)[last]), pa.array([model.languages[k] for k in lab[turn]], pa.string())],
                    ["_id", "first_word", "last_word", "lang"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, first_word long, last_word long, lang string").withColumnRenamed("_id", id_col)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))
