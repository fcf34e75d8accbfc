"""Toxicity: a learned lexicon, matched with misspellings and weighed by context.

The lexicon is learned from labelled documents: words that are much more frequent in toxic than in clean ones. Its terms
form a trie. A word of a text is turned into a Levenshtein automaton, as bit masks of the positions that are reached with
0 or 1 error, and walks the trie with it: terms at one edit are found without listing variants. Before that, vectorised
passes over all words keep those that begin with a term's first half or end with its second, as each word within one edit
does. Hits within quotation marks or after words of mention count less; how much is fitted, with a prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Words, bounded_sample, slices, unit_hash, write_table

#: Labelled documents of each class that the model is fitted on, at most in expectation; chosen by hash of the id.
#: The lexicon's size is bounded by theirs: each term is in LEAST_DOCS of them or more.
FIT_DOCS = 20_000

#: A term is in so many toxic documents at least, and either in this part of them or, by Chernoff's bound, there by chance with odds of e to
#: this power against.
LEAST_DOCS, LEAST_PART, LEAST_EVIDENCE = 4, 1 / 100, 20.0

#: A term is so many times as frequent in toxic documents as in clean ones.
LEAST_RATIO = 20.0

#: Letters from which on a term matches at one edit.
FUZZY_LETTERS = 5

#: Words on each side of a hit that its context has.
WINDOW = 6

#: Score from which on a document is predicted toxic.
THRESHOLD = 0.3

#: Words whose result a task remembers.
MEMORY = 200_000

# Marks that stand at the ends of words, marks of quotation, words of mention.
EDGES = ".,;:!?\"'()[]{}<>|*#%&$-_=+/\\~`"
QUOTES = ['"', "“", "”", "„", "«", "»", "‘", "’", "‹", "›"]
MENTIONS = ["word", "words", "term", "terms", "slur", "slurs", "quote", "quoted", "quoting", "said", "says", "called", "wort", "begriff", "mot", "terme", "palabra", "término"]

_QUOTES = [q.encode() for q in QUOTES]
_MENTIONS = {m.encode() for m in MENTIONS}

#: Features: sums of term weights by kind of hit, then the constant.
FEATURES = ["exact", "exact_quoted", "fuzzy", "fuzzy_quoted"]
_PRIOR = np.array([1.2, 0.3, 0.7, 0.2, -4.0])


@dataclass
class Lexicon:
    """Terms with a positive weight each. innocent: words at one edit of a term that clean documents use."""

    weights: dict[str, float]
    innocent: frozenset[str] = frozenset()
    trie: dict = field(default_factory=dict, repr=False)
    seen: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for term in self.weights:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.heads: dict[int, set[int]] = {}
        self.tails: dict[int, set[int]] = {}
        for term in self.weights:
            raw, cut = term.encode(), len(term[: len(term) // 2].encode())
            if len(term) < FUZZY_LETTERS:
                cut = len(raw)
            head, tail = raw[:cut][:8], raw[cut:][-8:]
            self.heads.setdefault(len(head), set()).add(int.from_bytes(head, "little"))
            if tail:
                self.tails.setdefault(len(tail), set()).add(int.from_bytes(tail, "big"))

    def __reduce__(self) -> tuple:
        return Lexicon, (self.weights, self.innocent)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term at the fewest edits, 0 or 1, of the largest weight, then the first; None if there is none."""
        best: tuple[int, float, str] | None = None
        n, masks = len(word), {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << n, (2 << n) - 1
        # bits: how many characters of the word are used up, without and with an error
        stack = [(self.trie, 1, 3 & full)]
        while stack:
            node, none, one = stack.pop()
            for c, below in node.items():
                if c == "":
                    errors = 0 if none & end else 1 if one & end and len(below) >= FUZZY_LETTERS else None
                    if errors is not None and (best is None or (errors, -self.weights[below], below) < best):
                        best = (errors, -self.weights[below], below)
                    continue
                m = masks.get(c, 0)
                to_none = (none & m) << 1
                to_one = (one & m) << 1 | none | none << 1 | to_none << 1
                to_one &= full
                if to_none | to_one:
                    stack.append((below, to_none, to_one))
        return None if best is None else (best[2], best[0])

    def candidates(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indices of words that begin with a head or end with a tail."""
        found = np.zeros(len(start), bool)
        size, last = end - start, len(data) - 1
        for table, backwards in ((self.heads, False), (self.tails, True)):
            value = np.zeros(len(start), np.uint64)
            for k in range(1, max(table, default=0) + 1):
                at = np.maximum(end - k, 0) if backwards else np.minimum(start + k - 1, last)
                byte = data[at].astype(np.uint64)
                value |= byte << np.uint64(8 * (k - 1))
                if k in table:
                    wanted = np.sort(np.array(sorted(table[k]), np.uint64))
                    spot = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                    found |= (wanted[spot] == value) & (size >= k)
        return np.flatnonzero(found)

    def hits(self, texts: list[bytes]) -> list[tuple[int, str, int, bool]]:
        """For lower-cased texts: the text's index, the term, its errors, whether it is quoted or mentioned."""
        words = Words(texts)
        edge = np.zeros(256, bool)
        edge[list(EDGES.encode())] = True
        start, end = words.start.copy(), words.end.copy()
        # all marks at the ends go; a word of marks alone keeps its last
        other = np.flatnonzero(~edge[words.data])
        at = np.flatnonzero(edge[words.data[start]])
        start[at] = np.minimum(other[np.searchsorted(other, start[at])], end[at] - 1)
        at = np.flatnonzero(edge[words.data[end - 1]])
        end[at] = np.maximum(other[np.searchsorted(other, end[at]) - 1], start[at]) + 1
        out, raw = [], words.data.tobytes()
        for i in self.candidates(words.data, start, end).tolist():
            word = raw[start[i] : end[i]].decode("utf-8", "replace")
            if word not in self.seen:
                if len(self.seen) > MEMORY:
                    self.seen.clear()
                self.seen[word] = self.nearest(word)
            if (found := self.seen[word]) is not None and (not found[1] or word not in self.innocent):
                lo, hi = words.first[words.row[i]], words.first[words.row[i] + 1]
                a, b = words.start[max(lo, i - WINDOW)], words.end[min(hi - 1, i + WINDOW)]
                before, after = raw[a : start[i]], raw[end[i] : b]
                out.append((int(words.row[i]), found[0], found[1], _quoted(before, after)))
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """One row per text: log(1 + sum) of the weights of its hits, by kind."""
        out = np.zeros((len(texts), len(FEATURES)))
        for row, term, errors, quoted in self.hits(texts):
            out[row, 2 * errors + quoted] += self.weights[term]
        return np.log1p(out)


def _quoted(before: bytes, after: bytes) -> bool:
    """Whether a mark of quotation is open before and another closes after, or a word of mention stands just before."""
    opened = sum(before.count(q) for q in _QUOTES)
    closed = any(q in after for q in _QUOTES)
    return opened % 2 == 1 and closed or any(w.strip(EDGES.encode()) in _MENTIONS for w in before.split()[-2:])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    coefficients: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.lexicon.features(texts) @ self.coefficients[:-1] + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words_of(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.filter(F.array_distinct(trimmed), lambda w: F.length(w) > 0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> ToxicityModel:
    """Learn from docs that labels (the id and 0 or 1) has; rows without a text or label are left out, equal texts count once,
    an id with contradictory labels counts as toxic.

    The labels are sampled before the join, to about fit_docs of each class: few enough to broadcast, so that no text but the
    sample's moves; of ids with many texts 2 fit_docs rows at most. Without toxic or without clean documents the lexicon is empty, and all scores are the same.
    """
    marks = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic")).filter("_id is not null and _toxic is not null")
    counts = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    rate = F.when(F.col("_toxic"), min(1.0, fit_docs / counts.get(True, 1))).otherwise(min(1.0, fit_docs / counts.get(False, 1)))
    # an id with both labels counts as toxic
    marks = marks.filter(unit_hash("_id") < rate).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text")).filter("_text is not null")
    # an id may have many texts
    rows = write_table(bounded_sample(rows.join(F.broadcast(marks), "_id"), 2 * fit_docs, "_id", "_text"), "labelled")
    once = rows.groupBy(F.xxhash64("_text").alias("_h")).agg(F.min("_id").alias("_id")).select("_id")
    rows = write_table(rows.join(F.broadcast(once), "_id", "left_semi"), "labelled").select("_toxic", "_text")
    sizes = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(Lexicon({}), np.array([0.0, 0, 0, 0, _PRIOR[-1]]))
    seen = rows.select("_toxic", F.explode(_words_of(F.col("_text"))).alias("w"))
    seen = seen.groupBy("w").agg(F.count_if("_toxic").alias("t"), F.count_if(~F.col("_toxic")).alias("c"))
    ratio = (F.col("t") / n_toxic) / ((F.col("c") + 0.5) / n_clean)
    part, share = F.col("t") / (F.col("t") + F.col("c")), n_toxic / (n_toxic + n_clean)
    rest = F.when(F.col("c") > 0, F.col("c") * F.log((1 - part) / (1 - share))).otherwise(0.0)
    evidence = F.col("t") * F.log(part / share) + rest
    strong = seen.filter((F.col("t") >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & ((F.col("t") >= n_toxic * LEAST_PART) | (evidence >= LEAST_EVIDENCE))).withColumn("weight", F.log(ratio))
    terms = strong.orderBy(F.desc(F.col("t") * F.col("weight")), "w").collect()
    weights = {r["w"]: r["weight"] for r in terms}
    lexicon = Lexicon(weights)
    lexicon = Lexicon(weights, _innocent(rows, lexicon))
    return ToxicityModel(lexicon, _fit_coefficients(rows, lexicon))


def _innocent(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words at one edit of a term that clean documents use and toxic ones not clearly more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                words = Words(texts)
                raw, out = words.data.tobytes(), []
                labels = part.column(0).to_pylist()
                pairs = set()
                for i in lexicon.candidates(words.data, words.start, words.end).tolist():
                    w = raw[words.start[i] : words.end[i]].decode("utf-8", "replace").strip(EDGES)
                    pairs.add((int(words.row[i]), w))
                nearest = {w: lexicon.nearest(w) for w in {w for _, w in pairs}}
                for row, w in pairs:
                    if (found := nearest[w]) is not None and found[1]:
                        out.append((w, labels[row]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.bool_())], ["w", "toxic"])

    found = rows.select("_toxic", "_text").mapInArrow(run, "w string, toxic boolean").groupBy("w").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    kept = found.filter("c > 0 and c * 2 >= t").select("w").collect()
    return frozenset(r["w"] for r in kept)


def _fit_coefficients(rows: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Logistic regression by Newton's method around the prior; as many rows as the fit has, counted by equal features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                x = lexicon.features(texts).round(3)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["toxic", *FEATURES])

    schema = "toxic boolean, " + ", ".join(f"{f} double" for f in FEATURES)
    table = rows.select("_toxic", "_text").mapInArrow(run, schema).groupBy("toxic", *FEATURES).count().toPandas()
    x = np.c_[table[FEATURES].to_numpy(float), np.ones(len(table))]
    y, n = table["toxic"].to_numpy(float), table["count"].to_numpy(float)
    w, ridge = _PRIOR.copy(), np.array([1.0, 1, 1, 1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * (w - _PRIOR))
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the id, score (0 to 1), predicted (1 from threshold on, else 0).

    A null or empty text has the score of a text without hits. Ids may be null or repeated. An empty table gives an empty
    result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                score = model.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def toxic_hits(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The hits: the id, term, errors (0 or 1), quoted. Texts without hits have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = model.lexicon.hits(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([x[0] for x in found], pa.int64())), *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.bool_())))],
                    ["_id", "term", "errors", "quoted"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, term string, errors int, quoted boolean").withColumnRenamed("_id", id_col)
