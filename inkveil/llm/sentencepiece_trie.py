"""SentencePiece encoding and decoding by a forward pass over words that shares prefixes; of a BPE model, as op9's, the result
is the tokenizer's own merges, not the best sum of scores.

A text is cut into marked words: a word starts at a run of the space mark, as no piece holds a mark after another character
(checked when a model is loaded). The distinct words of a run of texts are sorted, which walks their trie depth-first: from
one word to the next only the characters beyond the common prefix get new forward entries, the others are reused.

Forward entries depend on the kind of model. Of a unigram model an entry is the best sum of piece scores and its last piece.
A BPE model's pieces come from ranked merges, and the best sum of their scores is another segmentation than the tokenizer's;
there an entry is the last piece of the prefix's own merges, found as the only one that may follow the entry where it
begins: two pieces may be neighbours if merging their joined text gives back the two. Ids are so equal to the tokenizer's.

Each task works on its own texts: no shuffle. Files of tokenizers are read on the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import slices

MARK = "▁"

#: Default place of a model file.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters of the words whose pieces a task remembers in each of two generations: when the younger is full it becomes the
#: older one, and words used again move to the younger.
MEMORY = 2_000_000

#: Pairs of pieces that a task remembers.
PAIRS = 800_000

_WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _automaton(ids: dict[str, int]) -> tuple[list[dict[str, int]], list[int], list[tuple[tuple[int, int], ...]]]:
    """Pieces as a trie of states: each state's next ones, the state of its longest proper suffix, the pieces (length, id)
    that end there from the longest to the shortest."""
    step: list[dict[str, int]] = [{}]
    fail, ends = [0], [()]
    for piece, i in ids.items():
        at = 0
        for c in piece:
            if c not in step[at]:
                step[at][c] = len(step)
                step.append({})
                fail.append(0)
                ends.append(())
            at = step[at][c]
        ends[at] = ((len(piece), i),)
    level = list(step[0].values())
    while level:
        below = []
        for at in level:
            ends[at] += ends[fail[at]]
            for c, to in step[at].items():
                back = fail[at]
                while back and c not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(c, 0)
                below.append(to)
        level = below
    return step, fail, ends


def _common_starts(words: list[str], width: int = 24) -> list[int]:
    """For each of sorted words how many characters it begins with as the one before does."""
    if not words:
        return []
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.array([w[:width] for w in words], f"U{width}").view(np.uint32).reshape(len(words), width)
    differ = points[1:] != points[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    out = [0, *np.minimum(same, np.minimum(size[1:], size[:-1])).tolist()]
    for k in np.flatnonzero(same == width).tolist():
        depth, most = out[k + 1], int(min(size[k], size[k + 1]))
        while depth < most and words[k][depth] == words[k + 1][depth]:
            depth += 1
        out[k + 1] = depth
    return out


class PieceModel:
    """Pieces and scores of a model with identity normalisation, a leading space mark and byte fallback.

    kind: "bpe" or "unigram"; by default "bpe" if the scores are whole numbers.
    """

    def __init__(self, pieces: list[str], scores: list[float], control: set[int] = frozenset(), kind: str | None = None):
        self.pieces, self.scores, self.control = pieces, scores, control
        self.kind = kind or ("bpe" if all(float(s).is_integer() for s in scores) else "unigram")
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := _BYTE.fullmatch(p))}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte fallback")
        fallback = set(self.bytes.values())
        self.ids = {p: i for i, p in enumerate(pieces) if i not in control and i not in fallback}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.values = [b"" if i in control else value.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        # words and their ids as 32-bit little-endian numbers; None stands for a space mark in a text itself
        self.young: dict[str | None, bytes] = {}
        self.old: dict[str | None, bytes] = {}
        self.size = 0
        self.may_follow: dict[int, bool] = {}
        self.next, self.fail, self.ends = _automaton(self.ids)
        # the two parts that the last merge of a BPE piece joins
        self.parts: dict[int, tuple[int, int]] = {}
        if self.kind == "bpe":
            for p, i in self.ids.items():
                if len(p) > 1 and len(found := self.merge(p, p)) == 2:
                    self.parts[i] = (self.ids[found[0]], self.ids[found[1]])

    def __reduce__(self) -> tuple:
        # a Python worker keeps one copy for all its tasks
        key = hashlib.md5(repr((self.pieces, self.scores, sorted(self.control), self.kind)).encode()).hexdigest()
        return _kept_model, (key, self.pieces, self.scores, self.control, self.kind)

    @classmethod
    def load(cls, path: str = MODEL_PATH, kind: str | None = None) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], control, kind)

    def merge(self, text: str, stop: str = "") -> list[str]:
        """The pieces by ranked merges: the best-ranked pair first, the leftmost of equals. stop: a piece not to merge to."""
        parts, scores, ids = list(text), self.scores, self.ids
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(both) if (both := parts[k] + parts[k + 1]) != stop else None
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether merges of the joined text of two pieces give back the two.

        Merges run by rank, so they do unless a piece on the border joins its neighbour before both are complete: from the
        whole pieces back, the later-ranked one is undone and the new pair on the border looked at.
        """
        pieces, scores, parts, ids = self.pieces, self.scores, self.parts, self.ids
        limit = float("-inf")  # the score of the merge that was undone last
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and (scores[joined] > limit or scores[joined] == limit and undone_right):
                return False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            # undo the merge that came later: the lower score, of equals the right one
            undone_right = x is None or y is not None and scores[b] <= scores[a]
            if undone_right:
                limit, b = scores[b], y[0]
            else:
                limit, a = scores[a], x[1]

    def _entries(self, word: str, depth: int, last: list[int], begin: list[int], total: list[float], state: list[int]) -> None:
        """Entries of the prefixes beyond depth.

        BPE: of the pieces that end there, the longest that may follow its predecessor. Unigram: the best sum of scores.
        """
        step, fail, ends, scores = self.next, self.fail, self.ends, self.scores
        pairs, neighbours, bpe = self.may_follow, self._neighbours, self.kind == "bpe"
        at = state[depth]
        for i in range(depth, len(word)):
            c = word[i]
            while (to := step[at].get(c)) is None and at:
                at = fail[at]
            at = to or 0
            piece, start = -1, i
            if bpe:
                for size, p in ends[at]:
                    j = i + 1 - size
                    if not j or (a := last[j]) < 0:
                        piece, start = p, j
                        break
                    fits = pairs.get(a << 32 | p)
                    if fits is None:
                        fits = pairs[a << 32 | p] = neighbours(a, p)
                    if fits:
                        piece, start = p, j
                        break
            else:
                best = total[i] - 1e6
                for size, p in ends[at]:
                    if total[i + 1 - size] + scores[p] > best:
                        piece, start, best = p, i + 1 - size, total[i + 1 - size] + scores[p]
                total.append(best)
            last.append(piece)
            begin.append(start)
            state.append(at)

    def encode_words(self, words: list[str]) -> None:
        """Remember the pieces of new words. Sorted, they are the leaves of their trie from left to right."""
        if len(self.may_follow) > PAIRS:
            self.may_follow.clear()
        # entries by depth: the last piece (-1: bytes of one character), where it begins, the sum of scores, the automaton's state
        last, begin, total, state = [0], [0], [0.0], [0]
        words = sorted(words)
        for word, depth in zip(words, _common_starts(words), strict=True):
            del last[depth + 1 :], begin[depth + 1 :], total[depth + 1 :], state[depth + 1 :]
            self._entries(word, depth, last, begin, total, state)
            found, i = [], len(word)
            while i:
                if last[i] >= 0:
                    found.append(last[i])
                else:
                    found.extend(self.bytes[b] for b in reversed(word[begin[i] : i].encode()))
                i = begin[i]
            self.young[word] = array("i", found[::-1]).tobytes()

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers. An empty text has none. A space mark in a text itself is encoded by its bytes."""
        units = []
        for text in texts:
            marked = MARK + text.replace(" ", MARK) if MARK not in text else None
            units.append(_WORDS.findall(marked) if text and marked else self._with_marks(text) if text else [])
        if self.size > MEMORY:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[None] = array("i", [self.bytes[b] for b in MARK.encode()]).tobytes()
        young, old = self.young, self.old
        wanted = set().union(*units) - young.keys()
        self.size += sum(map(len, wanted))
        again = wanted & old.keys()
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        self.encode_words(list(wanted - again))
        return [b"".join(map(young.__getitem__, found)) for found in units]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as lists."""
        return [np.frombuffer(raw, np.int32).tolist() for raw in self.encode_raw(texts)]

    def _with_marks(self, text: str) -> list[str | None]:
        """Words of a text that holds the mark itself: it stands alone as None, whose pieces are its bytes."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(None)
            out.extend(_WORDS.findall((MARK if not k else "") + part.replace(" ", MARK)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD. The leading space goes."""
        text = b"".join(map(self.values.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_models: dict[str, PieceModel] = {}


def _kept_model(key: str, *parts) -> PieceModel:
    if key not in _models:
        _models[key] = PieceModel(*parts)
    return _models[key]


@lru_cache(4)
def load_model(path: str = MODEL_PATH) -> PieceModel:
    return PieceModel.load(path)


def _texts(part: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in part]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows, rows.schema["_id"].dataType.simpleString()


def encode_pieces(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and ids (array of int). A null or empty text has an empty array.

    Ids of rows may be null or repeated; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                raw = model.encode_raw(_texts(texts))
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_id", "ids"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode_pieces(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and text. A null array gives a null text; ids outside the model raise an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def piece_digests(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: the id, n_pieces, ids_md5 (of the ids as 32-bit little-endian numbers), round_trip.

    round_trip: whether decoding gives back the text (null counts as empty). Other cases as in encode_pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, "_text"):
                texts = _texts(raw)
                found = model.encode_raw(texts)
                n = pa.array([len(x) // 4 for x in found], pa.int64())
                md5 = pa.array([hashlib.md5(x).hexdigest() for x in found], pa.string())
                same = [model.decode(array("i", x)) == t for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), n, md5, pa.array(same, pa.bool_())], ["_id", "n_pieces", "ids_md5", "round_trip"])

    rows, kind = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"_id {kind}, n_pieces long, ids_md5 string, round_trip boolean").withColumnRenamed("_id", id_col)
