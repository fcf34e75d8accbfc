"""Quality classifier from weak labels.

Labellers vote on each document by simple statistics of its text: good, bad, or no vote. Expectation-maximisation over the
counts of vote patterns, which are few whatever the corpus, estimates each labeller's accuracy and the part of good
documents, without any labels. The posterior of a document's pattern is its soft label; a linear scorer over hashed byte
trigrams and binned statistics is trained on a bounded sample of such labels and scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Words, bounded_sample, slices
from inkveil.llm.substring_dedup import word_hashes

#: Documents that the scorer is trained on, at most in expectation; chosen by hash of the id.
FIT_DOCS = 3000

#: Hash buckets of byte trigrams, and bins of a statistic.
BUCKETS, BINS = 1 << 11, 8

#: The label model's prior, the probabilities of no vote, bad, good: on good documents, on bad ones, by the labeller that a kind of bad
#: documents is named after; each for labellers that look for faults and for those that also vote for good.
ON_GOOD, ON_BAD, ON_OWN = ([0.9985, 0.0005, 0.001], [0.10, 0.0005, 0.8995]), ([0.90, 0.099, 0.001], [0.10, 0.10, 0.80]), ([0.02, 0.97, 0.01], [0.02, 0.97, 0.01])

#: The prior's part of good documents, and its weight, as a part of all rows.
GOOD_PRIOR, PRIOR_WEIGHT = 0.8, 0.05

#: Score from which on a document is kept.
THRESHOLD = 0.5

#: Steps and rate of the training.
STEPS, RATE, DECAY = 150, 0.5, 1e-4

#: A range that holds nothing: the labeller doesn't vote for good.
NEVER = (1.0, 0.0)

# For each labeller its statistic, the range of values that it calls good, and the one that it calls bad.
LABELLERS = [
    ("symbols", NEVER, (0.04, 1.0)),  # ASCII symbols, without .,;:'"-()?, among the bytes
    ("repeats", NEVER, (0.10, 1.0)),  # words equal to the one before
    ("capitals", NEVER, (0.35, 1.0)),  # A-Z among ASCII letters
    ("lone", NEVER, (0.10, 1.0)),  # words without a letter or digit
    ("marked", NEVER, (0.25, 1.0)),  # words that end in a symbol other than .,;:'"-()?
    ("distinct", (0.75, 1.0), (0.0, 0.58)),  # logarithm of the distinct words (and 1) by that of the words (and 1)
    ("word_bytes", (3.0, 14.0), (25.0, 1e9)),  # mean bytes of a word
    ("words", (20.0, 1e9), (0.0, 0.5)),  # words
]

_EDGES = np.array([[0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.2]] * 5 + [[0.3, 0.45, 0.58, 0.68, 0.75, 0.85, 0.93], [2, 3, 4, 6, 8, 12, 20], [1, 3, 10, 30, 100, 300, 1000]])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"]] = True
_SOLID = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def statistics(words: Words, texts: int) -> np.ndarray:
    """One row per text, one column per labeller; an empty text has zeros."""
    n = np.diff(words.first).astype(float)
    size = np.diff(words.text_start).astype(float) - 1

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[words.text_start[1:] - 1] - sums[words.text_start[:-1]]).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, flags, texts)

    data, hashes = words.data, word_hashes(words)
    solid = np.concatenate(([0], np.cumsum(_SOLID[data])))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    order = np.lexsort((hashes, words.row))
    h, r = hashes[order], words.row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][: len(h)]
    distinct = np.bincount(r, new, texts)
    some = np.maximum(n, 1)
    return np.stack(
        [
            per_text(_SYMBOL[data]) / np.maximum(size, 1),
            per_word(same) / some,
            per_text(_UPPER[data]) / np.maximum(per_text(_LETTER[data]), 1),
            per_word(solid[words.end] == solid[words.start]) / some,
            per_word(_SYMBOL[data[words.end - 1]]) / some,
            np.log1p(distinct) / np.log1p(some),
            per_word(words.end - words.start) / some,
            n,
        ],
        axis=1,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """2 for good, 1 for bad, 0 for no vote."""
    out = np.zeros(stats.shape, np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        out[:, k] = np.where((stats[:, k] >= bad[0]) & (stats[:, k] <= bad[1]), 1, np.where((stats[:, k] >= good[0]) & (stats[:, k] <= good[1]), 2, 0))
    return out


def patterns(found: np.ndarray) -> np.ndarray:
    """The votes of a row as one number in base 3."""
    return found @ (3 ** np.arange(found.shape[1]))


@dataclass
class LabelModel:
    """parts: of the classes among the documents: good ones, then for each labeller the bad ones of its kind.

    rates: class x labeller x vote, the probability of the vote.
    """

    parts: np.ndarray
    rates: np.ndarray

    @property
    def good(self) -> float:
        return float(self.parts[0])

    def accuracies(self) -> np.ndarray:
        """bad and good documents x labeller x vote: the probability of the vote."""
        bad = np.einsum("c,clv->lv", self.parts[1:], self.rates[1:]) / max(self.parts[1:].sum(), 1e-12)
        return np.stack((bad, self.rates[0]))

    def classes(self, found: np.ndarray) -> np.ndarray:
        """The probabilities of the classes of documents with these votes, a row each."""
        logs = np.log(self.parts) + np.log(self.rates)[:, np.arange(found.shape[1])[None, :], found].sum(axis=2).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, found: np.ndarray) -> np.ndarray:
        """The probability that documents with these votes are good."""
        return self.classes(found)[:, 0]


def even_label_model() -> LabelModel:
    """Of an empty table: no vote says anything, and half the documents are good."""
    n = len(LABELLERS)
    return LabelModel(np.r_[0.5, np.full(n, 0.5 / n)], np.full((n + 1, n, 3), 1 / 3))


def fit_label_model(found: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """EM over distinct rows of votes and their counts, with Dirichlet priors.

    Given the class, labellers vote independently; no vote is an outcome like the others. Bad documents are of as many kinds
    as there are labellers, as a document has few of the faults that are looked for. Parts and rates move freely. Priors weigh
    a part of all rows, so the model is the same for a table and for copies of it.
    """
    n, both = len(LABELLERS), [int(good != NEVER) for _, good, _ in LABELLERS]
    prior = np.array([[ON_GOOD[b] for b in both]] + [[(ON_OWN if k == own else ON_BAD)[b] for k, b in enumerate(both)] for own in range(n)])
    weights = PRIOR_WEIGHT * np.r_[GOOD_PRIOR, np.full(n, (1 - GOOD_PRIOR) / n)]
    share = counts / counts.sum()
    votes_of = np.stack([found == v for v in range(3)], axis=2).astype(float)
    model = LabelModel(weights / PRIOR_WEIGHT, prior)
    p = model.classes(found)
    for _ in range(rounds):
        mass = share[:, None] * p
        rates = np.einsum("rc,rlv->clv", mass, votes_of) + weights[:, None, None] * prior
        parts = mass.sum(axis=0) + weights
        model = LabelModel(parts / parts.sum(), rates / rates.sum(axis=2, keepdims=True))
        before, p = p, model.classes(found)
        if np.abs(p - before).max() < 1e-9:
            break
    return model


def _buckets(words: Words) -> np.ndarray:
    data = words.data.astype(np.uint32)
    tri = np.zeros(len(data), np.uint32)
    tri[:-2] = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (tri * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _bins(stats: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(_EDGES[k], stats[:, k], "right") + k * BINS for k in range(stats.shape[1])], axis=1)


@dataclass
class QualityModel:
    labels: LabelModel
    grams: np.ndarray
    bins: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the posterior of its votes and the scorer's probability that it is good."""
        words = Words(texts)
        stats = statistics(words, len(texts))
        # sums by text, so that a text's score doesn't depend on its neighbours
        size = np.diff(words.text_start)
        each = self.grams[_buckets(words)[words.text_start[0] : words.text_start[-1]]]
        ends = np.cumsum(size)
        each[ends - 1] = 0  # the space after each text, and the trigram that goes over it
        each[np.maximum(ends - 2, 0)] = 0
        sums = np.bincount(np.repeat(np.arange(len(texts)), size), each, len(texts))
        z = sums / np.maximum(size - 2, 1) + self.bins[_bins(stats)].sum(axis=1) + self.bias
        return self.labels.posterior(votes(stats)), 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parts of trigrams by bucket, and bins, for training."""
    words = Words(texts)
    at = np.searchsorted(words.text_start, np.arange(len(words.data)), "right") - 1
    inside = (at >= 0) & (at < len(texts))
    row = at[inside]
    keep = np.arange(len(words.data))[inside] < words.text_start[row + 1] - 2  # no trigram over the space after a text
    x = np.bincount(row[keep] * BUCKETS + _buckets(words)[inside][keep], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    return (x / np.maximum(x.sum(axis=1, keepdims=True), 1)).astype(np.float32), _bins(statistics(words, len(texts)))


def train_scorer(grams: np.ndarray, bin_of: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels, both classes of equal weight, by gradient steps with momentum."""
    bins = np.zeros((len(grams), len(LABELLERS) * BINS), np.float32)
    np.put_along_axis(bins, bin_of, 1, axis=1)
    scale = 1 / np.sqrt((grams**2).mean(axis=0) + 1e-8)
    x = np.c_[grams * scale / np.sqrt(BUCKETS), bins, np.ones(len(grams), np.float32)].astype(np.float32)
    weight = np.where(target >= 0.5, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    speed = np.zeros_like(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - RATE * (x.T @ (weight * (p - target)) + DECAY * w)
        w = w + speed
    return (w[:BUCKETS] * scale / np.sqrt(BUCKETS)).astype(float), w[BUCKETS:-1].astype(float), float(w[-1])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> QualityModel:
    """Label model over the votes of all rows of docs, scorer on a sample. An empty table gives a model that says 0.5.

    The sample is of fit_docs rows with a text at most, by hash of id and text; rows with equal ids and texts, null ids too, count once in it.
    Whole texts count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "_text"):
                k, n = np.unique(patterns(votes(statistics(Words(texts), len(texts)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pattern", "n"])

    rows = _rows(docs, id_col, text_col)
    counted = rows.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    if not len(counted):
        return QualityModel(even_label_model(), np.zeros(BUCKETS), np.zeros(len(LABELLERS) * BINS), 0.0)
    k = counted["pattern"].to_numpy(np.int64)
    found = k[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    labels = fit_label_model(found, counted["n"].to_numpy(float))
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "_text"):
                for k in range(0, len(texts), 200):
                    part = texts[k : k + 200]
                    grams, bin_of = _features(part)
                    soft = labels.posterior(votes(statistics(Words(part), len(part))))
                    raw = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (grams, bin_of.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*raw, pa.array(soft)], ["grams", "bins", "soft"])

    # features of whole texts: as many numbers for each document whatever its length
    chosen = bounded_sample(rows.filter("_text is not null"), fit_docs, "_id", "_text")
    sample = chosen.mapInArrow(examples, "grams binary, bins binary, soft double").toPandas().sort_values(["grams", "bins"], kind="stable")
    if not len(sample):
        return QualityModel(labels, np.zeros(BUCKETS), np.zeros(len(LABELLERS) * BINS), 0.0)
    grams, bin_of = (np.frombuffer(b"".join(sample[c]), t).reshape(len(sample), -1) for c, t in (("grams", np.float32), ("bins", np.int64)))
    return QualityModel(labels, *train_scorer(grams, bin_of, sample["soft"].to_numpy()))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the id, weak_label (posterior of the votes), score, kept (score of threshold or more).

    A null text counts as empty, which is scored as a text without words. Ids may be null or repeated. An empty table gives
    an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                weak, score = model.score(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weak), pa.array(score), pa.array(score >= threshold)], ["_id", "weak_label", "score", "kept"])

    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, weak_label double, score double, kept boolean").withColumnRenamed("_id", id_col)
