"""Substring dedup by collinear chaining: find fuzzy passages that documents share.

1. Seeds: of each WINDOW consecutive word 5-grams the one of least hash (a minimizer), so any run of WINDOW + 4 equal words has one.
2. Join: a seed's occurrences link to its first and its last one, as pairs of documents, smaller id first. Up to three
   occurrences these are all pairs; beyond, rows stay in proportion to the occurrences.
3. A passage of seeds with more than three occurrences may so fall apart over many partners. There, each pair of neighbouring
   seeds with different partners is a key of its own, and each window of least_words words as well: all documents with a whole window link to the first
   and the last one that have it whole, so no equal passage is lost, whatever quotes parts of it.
4. Chain: for each pair of documents, seeds on one diagonal join into segments, and a Fenwick tree over the second text's
   positions finds the best ordered chains with gap costs.
5. Align: chains get the hashes of their words from both texts in tiles of 256 words; gaps are compared along the
   diagonal or by edit distance, ends are extended until the score drops. Long and equal enough passages remain.

Texts are shuffled once, those with chains or such windows. A task holds the chains of one pair of documents at a time, which
their lengths bound. Keys that hold more than 1/HOT of all rows are joined apart, with the few rows of the other side broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Words, groups, join_hot, slices, write_table

#: Words of a seed, and seeds of a window that chooses one.
SEED_WORDS, WINDOW = 5, 10

#: Occurrences up to which the links to the first and last are all pairs.
FEW = 3

#: Words a passage has at least, and the part of them that are equal.
LEAST_WORDS, LEAST_EQUAL = 50, 0.8

#: Words between two seeds of a chain at most, and the cost of each.
LARGEST_GAP, GAP_COST = 64, 0.05

#: Text bytes of one pass.
SLICE_BYTES = 1 << 20

#: Bytes of a word up to which it is hashed together with others.
LONG_WORD = 64

#: Masks of the first bytes of eight, by their number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Words of a tile.
TILE = 256

#: Words by which ends are extended at most in one go; a word that differs costs this much, an equal one gains 1, and this drop ends it.
REACH, MISMATCH, DROP = 64, 4.0, 24.0

#: x0, y0, x1, y1: where a chain begins and ends in both texts; chain: the places x, then y, then the words n of its segments.
_CHAINS = "doc long, partner long, x0 int, y0 int, x1 int, y1 int, chain binary"
_SUSPECTS = "doc long, keys array<struct<key: long, pos: int, gap: int, end: byte>>, first array<int>, last array<int>"
_TILES = "doc long, tile int, words binary, windows array<struct<pos: int, key: long, end: byte>>"
_PASSAGES = "doc_id long, first_word long, last_word long, partner_id long, partner_first_word long, partner_last_word long, n_equal long, identity double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes eight at a time; of words over LONG_WORD bytes by xxHash."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    size = words.end - words.start
    eights = np.concatenate((words.data, np.zeros(24 - len(words.data) % 8, np.uint8))).view("<u8")

    def load(at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on, from the two aligned eights that hold them."""
        k, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return eights[k] >> bits | eights[k + 1] << np.uint64(1) << (np.uint64(63) - bits)

    # of the last bytes of a word those after it count as zero
    out = _mix((load(words.start) & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) << np.uint64(56)))
    for at in range(8, LONG_WORD, 8):
        rest = np.flatnonzero(size > at)
        if not len(rest):
            break
        more = load(words.start[rest] + at) & _FIRST_BYTES[np.minimum(size[rest] - at, 8)]
        out[rest] = _mix(out[rest] * np.uint64(0x100000001B3) + more)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(words.data[words.start[k] : words.end[k]].tobytes())
    return out


def seeds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimizers of texts: the text's index, the position of the first word, the hash."""
    words = Words(texts)
    hashes = word_hashes(words)
    n = len(hashes) - SEED_WORDS + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    grams = np.zeros(n, np.uint64)
    for j in range(SEED_WORDS):
        grams = grams * np.uint64(0x100000001B3) + hashes[j : j + n]
    grams = _mix(grams)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    at = np.arange(len(windows))
    inside = words.row[at] == words.row[at + WINDOW + SEED_WORDS - 2]
    picked = np.unique(at[inside] + windows[inside].argmin(axis=1))
    row = words.row[picked]
    return row, picked - words.first[row], grams[picked].view(np.int64)


def marks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each occurrence whether it is the first (1) and the last (2) of its keys; order sorts them by the keys, then by place."""
    turn = np.zeros(len(order) + 1, bool)
    turn[[0, -1]] = True
    for k in keys:
        k = k[order]
        turn[1:-1] |= k[1:] != k[:-1]
    out = np.zeros(len(order), np.int8)
    out[order] = turn[:-1] + 2 * turn[1:]
    return out


def _seed_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                row, at, hashes = seeds(texts)
                gap, end = pa.array(np.zeros(len(at), np.int32)), pa.array(marks(np.lexsort((hashes, row)), row, hashes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), gap, pa.array(hashes), end], ["doc", "pos", "gap", "key", "end"])

    return docs.mapInArrow(run, "doc long, pos int, gap int, key long, end byte")


# links


def _linked(found: DataFrame, tag: str) -> DataFrame:
    """Occurrences (doc, pos, gap, key) of keys that several documents have, with their number n, the first one a, the last b.

    end: marks() of each occurrence within its document. With them all that is summed up are numbers, which Spark does without sorting.
    """
    doc, place = F.col("doc"), F.shiftleft(F.col("pos").cast("long"), 32) + F.col("gap")
    first, last = F.when(F.col("end").bitwiseAND(1) > 0, doc), F.when(F.col("end").bitwiseAND(2) > 0, doc)
    ends = found.groupBy("key").agg(
        F.count("*").alias("n"), F.min(doc).alias("a"), F.min_by(place, first).alias("a_place"), F.max(doc).alias("b"), F.max_by(place, last).alias("b_place")
    ).filter("a <> b")
    at = lambda e: F.struct(F.col(e).alias("doc"), F.shiftright(f"{e}_place", 32).cast("int").alias("pos"), F.col(f"{e}_place").bitwiseAND((1 << 32) - 1).cast("int").alias("gap")).alias(e)  # noqa: E731, E501
    ends = write_table(ends.select("key", "n", at("a"), at("b")), f"{tag}-ends")
    # a row for each key, so a task's part of them is small
    return write_table(join_hot(found.drop("end"), ends.hint("shuffle_hash"), ["key"], ends.select("key", "n")), tag)


def _pairs(linked: DataFrame) -> DataFrame:
    """Each occurrence with its key's first and last one, if they are of other documents: doc < partner, and the places of both."""
    to_a = F.when(F.col("doc") != F.col("a.doc"), F.col("a"))
    to_b = F.when((F.col("doc") != F.col("b.doc")) & ~((F.col("doc") == F.col("a.doc")) & (F.col("pos") == F.col("a.pos"))), F.col("b"))
    both = linked.select(F.struct("doc", "pos", "gap").alias("p"), F.explode(F.array(to_a, to_b)).alias("q")).filter("q is not null")
    both = both.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return both.select(
        F.col("p.doc").alias("doc"), F.col("q.doc").alias("partner"), F.col("p.pos").alias("x"), F.col("q.pos").alias("y"), F.col("p.gap").alias("gx"), F.col("q.gap").alias("gy")
    )


def suspects(pos: np.ndarray, seed: np.ndarray, many: np.ndarray, ends: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's shared seeds, by position: keys of neighbours that have many occurrences both and other first or last
    documents (rows of ends) than each other (key, position, gap), and the starts (first, last) of the windows whose links the seeds alone may lose.

    Both documents with an equal window have the same seeds in its inner part. Two of them with few occurrences link the
    documents, so a window is of interest if its inner part has no gap between shared seeds, and one such seed at most.
    """
    keys, places, gaps = [], [], []
    for step in (1, 2):
        use = many[:-step] & many[step:]
        if not use.any():
            continue
        use = np.flatnonzero(use & (pos[step:] - pos[:-step] <= 2 * WINDOW) & (ends[:-step] != ends[step:]).any(axis=1))
        if not len(use):
            continue
        keys.append(_mix(_mix(seed[use].view(np.uint64)) + seed[use + step].view(np.uint64) * np.uint64(2 * step + 1)).view(np.int64))
        places.append(pos[use])
        gaps.append(pos[use + step] - pos[use])
    keys, places, gaps = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((keys, np.int64), (places, pos.dtype), (gaps, pos.dtype)))
    cut = np.flatnonzero(pos[1:] - pos[:-1] > WINDOW) + 1
    start, stop = pos[np.concatenate(([0], cut))], pos[np.concatenate((cut, [len(pos)])) - 1]
    # the inner part of a window at s: from s + WINDOW - 1 to s + inner
    inner = least_words - SEED_WORDS - WINDOW + 1
    lo, hi = np.maximum(start - 2 * (WINDOW - 1), 0), stop - inner + WINDOW - 1
    use = lo <= hi
    if not use.any():
        return keys, places, gaps, *(np.zeros(0, np.int64),) * 2
    size = hi[use] - lo[use] + 1
    at = np.arange(size.sum()) + np.repeat(lo[use] - np.cumsum(size) + size, size)
    few = pos[~many]
    if len(few):
        at = at[np.searchsorted(few, at + inner, "right") - np.searchsorted(few, at + WINDOW - 1) <= 1]
    at = np.unique(at)
    cut = np.flatnonzero(at[1:] - at[:-1] > 1) + 1
    first, last = (at[np.concatenate(([0], cut))], at[np.concatenate((cut, [len(at)])) - 1]) if len(at) else (at, at)
    return keys, places, gaps, first, last


def _suspect_rows(linked: DataFrame, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            def lists(parts: list[np.ndarray], kind: pa.DataType) -> tuple[np.ndarray, pa.Array]:
                return np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts) if parts else [], kind)

            ends, key = lists([r[1] for r in rows], pa.int64())
            pos, gap = (lists([r[k] for r in rows], pa.int32())[1] for k in (2, 3))
            row, raw = np.repeat(np.arange(len(rows)), np.diff(ends)), key.to_numpy()
            end = pa.array(marks(np.lexsort((gap.to_numpy(), pos.to_numpy(), raw, row)), row, raw))
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([key, pos, gap, end], ["key", "pos", "gap", "end"]))
            ranges = [pa.ListArray.from_arrays(pa.array(e), v) for e, v in (lists([r[k] for r in rows], pa.int32()) for k in (4, 5))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), keys, *ranges], ["doc", "keys", "first", "last"])

        for g in groups(batches, 1):
            found = suspects(g["pos"], g["key"], g["n"] > FEW, np.stack((g["from"], g["to"]), axis=1), least_words)
            if len(found[0]) or len(found[3]):
                rows.append((int(g["doc"][0]), *found))
                held += len(found[0]) + len(found[3])
            if held >= 200_000:
                yield batch()
                rows.clear()
                held = 0
        yield batch()

    rows = linked.select("doc", "pos", "key", "n", F.col("a.doc").alias("from"), F.col("b.doc").alias("to")).repartition("doc").sortWithinPartitions("doc", "pos")
    return rows.mapInArrow(run, _SUSPECTS)


# chaining


def segments(x: np.ndarray, y: np.ndarray, words: int = SEED_WORDS, reach: int = 4 * WINDOW) -> list[tuple[int, int, int]]:
    """Matches (x, y) of so many words as runs (x, y, words) on one diagonal without gaps over reach, by x."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    d = y - x
    cut = np.flatnonzero((d[1:] != d[:-1]) | (x[1:] - x[:-1] > reach))
    if not len(cut):
        return [(int(x[0]), int(y[0]), int(x[-1] - x[0]) + words)]
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(x) - 1]))
    return sorted(zip(x[first].tolist(), y[first].tolist(), (x[last] - x[first] + words).tolist(), strict=True))


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The best collinear chains of segments (x, y, words): each uses its segments alone, best first.

    A chain's score is its words less GAP_COST for each word between segments in either text. A segment follows another if
    it begins no earlier than the other's end in both texts; the best one to follow comes from a Fenwick tree over the
    partner's positions that holds for each prefix the largest score plus cost already paid. Gaps over LARGEST_GAP cut.
    """
    if len(parts) == 1:
        return [parts]
    ends = sorted({y + n for _, y, n in parts})
    rank = {e: k + 1 for k, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    starts = np.searchsorted(ends, [y for _, y, _ in parts], "right").tolist()
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    score, before, done = [0.0] * len(parts), [-1] * len(parts), 0
    for i, (x, y, n) in enumerate(parts):
        while done < len(by_end) and (j := by_end[done]) < i and parts[j][0] + parts[j][2] <= x:
            a, b, m = parts[j]
            value, k = (score[j] + GAP_COST * (a + m + b + m), j), rank[b + m]
            while k < len(tree):
                if tree[k] < value:
                    tree[k] = value
                k += k & -k
            done += 1
        best, k = (-np.inf, -1), starts[i]
        while k:
            best = max(best, tree[k])
            k -= k & -k
        gained = best[0] - GAP_COST * (x + y)
        score[i] = n + max(0.0, gained)
        before[i] = best[1] if gained > 0 else -1
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain: list[tuple[int, int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and max(chain[-1][0] - parts[i][0], chain[-1][1] - parts[i][1]) - parts[i][2] > LARGEST_GAP:
                out.append(chain[::-1])
                chain = []
            chain.append(parts[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chain_rows(matches: DataFrame, words: int = SEED_WORDS) -> DataFrame:
    """Chains of matches of so many words. Matches longer than a seed are whole windows: each run of them is a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc", "partner", "x0", "y0", "x1", "y1", "chain"])

        for group in groups(batches, 2):
            x, y, gx, gy = (group[c].astype(np.int64) for c in ("x", "y", "gx", "gy"))
            if (wide := gx > 0).any():  # a key of two seeds
                both = np.unique(np.concatenate((x, (x + gx)[wide])) << 32 | np.concatenate((y, (y + gy)[wide])))
                x, y = both >> 32, both & 0xFFFFFFFF
            if words > SEED_WORDS:
                found = [[part] for part in segments(x, y, words, words)]
            else:
                found = chains(segments(x, y)) if len(x) > 1 else []
            for chain in found:
                (x0, y0, _), (x1, y1, n) = chain[0], chain[-1]
                if x1 + n - x0 > SEED_WORDS:
                    rows.append((group["doc"][0], group["partner"][0], x0, y0, x1 + n, y1 + n, np.array(chain, np.int32).T.tobytes()))
            if len(rows) >= 5000:
                yield batch()
                rows.clear()
        yield batch()

    return matches.repartition("doc", "partner").sortWithinPartitions("doc", "partner").mapInArrow(run, _CHAINS)


# alignment


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """By Myers' bit vectors: differences between neighbours in a column of the table are the bits of two integers."""
    if not len(a):
        return len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    most, top, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = most, 0
    for y in b.tolist():
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & most, up & across
        out += bool(more & top) - bool(less & top)
        more, less, same = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(same | more)) & most, more & same & most
    return out


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two runs of words go on alike: words, and how many of them are equal. Stops where the score drops."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    unlike = np.flatnonzero(a[:n] != b[:n]).tolist()
    # the score is largest where equal words end
    best, size, equal, score, at = -np.inf, 0, 0, 0.0, 0
    for k, stop in enumerate((*unlike, n)):
        score += stop - at
        if stop > at and score > best:
            best, size, equal = score, stop, stop - k
        at = stop + 1
        score -= MISMATCH
        if at > n or max(best, -MISMATCH) - score > DROP:
            break
    return (size, equal) if best > 0 else (0, 0)


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least_words: int, least_equal: float) -> list[tuple[int, int, int, int, int]]:
    """The passages of words a and b along a chain: first and past-last word in a, the same in b, equal words.

    The equal runs of the chain's segments join where the gap between them costs DROP at most; the ends are extended. Of
    joined runs that are not equal enough, those that are long enough by themselves remain. Where none is found so, as in short passages with
    changed words near their ends, the most equal stretch of least_words along the chain counts, if it is equal enough.
    """
    joined: list[list[tuple[int, int, int]]] = []
    equal: list[int] = []
    for sx, sy, n in chain:
        unlike = a[sx : sx + n] != b[sy : sy + n]
        turn = np.flatnonzero(unlike).tolist()
        for i, j in zip((0, *(k + 1 for k in turn)), (*turn, len(unlike)), strict=True):
            if j - i < SEED_WORDS:
                continue
            x, y, size = sx + i, sy + i, j - i
            if joined:
                px, py, m = joined[-1][-1]
                same, gap = _gap(a[px + m : x], b[py + m : y])
                if (gap - same) * MISMATCH - same <= DROP:
                    joined[-1].append((x, y, size))
                    equal[-1] += same + size
                    continue
            joined.append([(x, y, size)])
            equal.append(size)
    out = []
    for parts, same in zip(joined, equal, strict=True):
        (x, y, _), (px, py, m) = parts[0], parts[-1]
        before, equal_before = _extend(a[:x][::-1], b[:y][::-1])
        after, equal_after = _extend(a[px + m :], b[py + m :])
        found = (x - before, px + m + after, y - before, py + m + after, equal_before + same + equal_after)
        size = max(found[1] - found[0], found[3] - found[2])
        if min(found[1] - found[0], found[3] - found[2]) >= least_words and found[4] >= least_equal * size:
            out.append(found)
        else:
            out += [(x, x + n, y, y + n, n) for x, y, n in parts if n >= least_words]
    return out or _best_stretch(a, b, chain, least_words, least_equal)


def _best_stretch(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least_words: int, least_equal: float) -> list[tuple[int, int, int, int, int]]:
    """The most equal stretch of least_words words in both texts along a chain and up to so many words before and after it, if it is equal enough."""
    (sx, sy, _), (ex, ey, en) = chain[0], chain[-1]
    back, ahead = min(least_words, sx, sy), min(least_words, len(a) - ex - en, len(b) - ey - en)
    if min(ex - sx, ey - sy) + en + back + ahead < least_words:
        return []
    # the path's steps: words that it takes from both texts, and whether they are equal
    same, dx, dy = [], [], []

    def diagonal(x: int, y: int, n: int) -> None:
        same.append(a[x : x + n] == b[y : y + n])
        dx.append(np.ones(n, np.int64))
        dy.append(np.ones(n, np.int64))

    diagonal(sx - back, sy - back, back)
    for k, (x, y, n) in enumerate(chain):
        diagonal(x, y, n)
        if k + 1 < len(chain):
            gx, gy = chain[k + 1][0] - x - n, chain[k + 1][1] - y - n
            if gx == gy:
                diagonal(x + n, y + n, gx)
            else:
                size = max(gx, gy)
                same.append(np.arange(size) < _gap(a[x + n : x + n + gx], b[y + n : y + n + gy])[0])
                dx.append((np.arange(size) < gx).astype(np.int64))
                dy.append((np.arange(size) < gy).astype(np.int64))
    diagonal(ex + en, ey + en, ahead)
    if sum(map(np.count_nonzero, same)) / least_words < least_equal:
        return []
    equal, x, y = (np.concatenate(([0], np.cumsum(np.concatenate(v)))) for v in (same, dx, dy))
    start = np.arange(len(x))
    stop = np.maximum(np.searchsorted(x, x + least_words), np.searchsorted(y, y + least_words))
    start, stop = start[stop < len(x)], stop[stop < len(x)]
    part = (equal[stop] - equal[start]) / np.maximum(x[stop] - x[start], y[stop] - y[start])
    k = int(part.argmax())
    if part[k] < least_equal:
        return []
    i, j = start[k], stop[k]
    x, y = x + sx - back, y + sy - back
    return [(int(x[i]), int(x[j]), int(y[i]), int(y[j]), int(equal[j] - equal[i]))]


def _gap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Equal words of a gap, along the diagonal or by edit distance, and its size."""
    size = max(len(a), len(b))
    if len(a) == len(b):
        return int((a == b).sum()), size
    if abs(len(a) - len(b)) * MISMATCH > DROP + size:
        return 0, size
    return max(0, size - edit_distance(a, b)), size


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words, joined from runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, width = np.zeros(n, np.uint64), 0, hashes, 1
    while True:
        if size & width:
            out = _mix(out * np.uint64(0x100000001B3) + run[at : at + n])
            at += width
        if 2 * width > size:
            return out
        run = _mix(run[:-width] * np.uint64(0x9E3779B97F4A7C15) + run[width:])
        width *= 2


def thinned(at: np.ndarray, keys: np.ndarray, least_words: int) -> np.ndarray:
    """Starts of windows without those that repeat one of their text, as far as the rest covers the same words."""
    order = np.lexsort((at, keys))
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return at
    drop = []
    for start, stop in zip(*(np.flatnonzero(np.diff(np.r_[0, same, 0]) == d) for d in (1, -1)), strict=True):
        places = at[order[start : stop + 1]].tolist()  # of one key, ascending
        kept = places[0]
        for here, after in zip(places[1:], places[2:], strict=False):
            if after - kept <= least_words:
                drop.append(here)
            else:
                kept = here
    return np.setdiff1d(at, drop)


def _tiles(docs: DataFrame, wanted: DataFrame, found: DataFrame, least_words: int) -> DataFrame:
    """Tiles of the wanted (doc, tile) and of the suspect windows: the word hashes, 32 bits each, and the windows that begin there.

    The last tile of a text is shorter, one beyond it is empty.
    """
    asked = wanted.groupBy("doc").agg(F.collect_list("tile").alias("tiles"))
    asked = asked.join(found.select("doc", "first", "last").filter(F.size("first") > 0), "doc", "full")
    rows = docs.join(asked, "doc").select("doc", "text", "tiles", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE_BYTES):
                words = Words(texts)
                hashes = word_hashes(words)
                doc, tile, raw, ends, pos, key, end = [], [], [], [0], [], [], []
                for k, (d, tiles, first, last) in enumerate(zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True)):
                    own = hashes[words.first[k] : words.first[k + 1]]
                    at, whole = np.zeros(0, np.int64), window_hashes(own, least_words) if first else None
                    if first:
                        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                        at = at[at < len(whole)]
                        at = thinned(at, whole[at], least_words)
                        end.append(marks(np.argsort(whole[at], kind="stable"), whole[at]))
                        covered = np.concatenate([np.arange(a // TILE, (b + least_words + REACH) // TILE + 1) for a, b in zip(np.maximum(np.array(first) - REACH, 0), last, strict=True)])
                        tiles = np.union1d(covered, tiles or []).astype(int).tolist()
                    short = own.astype(np.uint32)
                    for t in tiles:
                        mine = at[np.searchsorted(at, t * TILE) : np.searchsorted(at, (t + 1) * TILE)]
                        doc.append(d)
                        tile.append(t)
                        raw.append(short[t * TILE : (t + 1) * TILE].tobytes())
                        pos.append(mine)
                        key.append(whole[mine] if len(mine) else np.zeros(0, np.uint64))
                        ends.append(ends[-1] + len(mine))
                pos, key = np.concatenate([np.zeros(0, np.int64), *pos]), np.concatenate([np.zeros(0, np.uint64), *key])
                end = pa.array(np.concatenate([np.zeros(0, np.int8), *end]))
                windows = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(key.view(np.int64)), end], ["pos", "key", "end"])
                windows = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), windows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tile, pa.int32()), pa.array(raw, pa.binary()), windows], ["doc", "tile", "words", "windows"])

    return rows.mapInArrow(run, _TILES)


def _one_text_each(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the one with the greatest text."""
    repeated = write_table(rows.groupBy("doc").count().filter("count > 1").select("doc"), "repeated")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "doc", "left_semi").groupBy("doc").agg(F.max("text").alias("text"))
    return rows.join(repeated, "doc", "left_anti").unionByName(one)


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_equal: float = LEAST_EQUAL) -> DataFrame:
    """Passages of at least least_words words that a document shares with another, equal in least_equal of them or more.

    One row per passage and partner: doc_id, first_word, last_word (from 0), partner_id, partner_first_word,
    partner_last_word, n_equal, identity; each pair of documents in both directions. Each document with a passage equal to one
    of another has a row for it, with the first or last document that has it whole; of many documents with the same passage
    each has rows with these two, not with all. Words stand between ASCII spaces and are compared in lower case.

    Fuzzy passages are found if two of their seeds are linked. least_words is at least 3 * WINDOW + 2. Documents with a null id or
    text, or too few words, have no row. Of rows that repeat an id the one with the greatest text counts. Passages repeated
    within one document only aren't shared. An empty table gives an empty result. Other columns are not read.
    """
    if least_words < 3 * WINDOW + 2:
        raise ValueError(f"least_words must be {3 * WINDOW + 2} or more")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(F.col(text_col)).alias("text")).filter("doc is not null and text is not null")
    rows = _one_text_each(rows)
    linked = _linked(write_table(_seed_rows(rows), "seeds"), "shared-seeds")
    found = write_table(_suspect_rows(linked, least_words), "suspects")
    neighbours = _linked(found.select("doc", F.inline("keys")).select("doc", "pos", "gap", "key", "end"), "neighbours")
    chained = write_table(_chain_rows(_pairs(linked).unionByName(_pairs(neighbours))), "chains")

    # both sides of each chain as tiles, with room to extend the ends
    def reach(side: str) -> Column:
        lo, hi = F.greatest(F.lit(0), F.col(f"{side}0") - REACH), F.col(f"{side}1") + REACH
        return F.sequence(F.floor(lo / TILE).cast("int"), F.floor(hi / TILE).cast("int"))

    x, y = reach("x"), reach("y")
    wanted = chained.select("doc", F.explode(x).alias("tile")).union(chained.select("partner", F.explode(y))).distinct()
    tiles = write_table(_tiles(rows, wanted, found, least_words), "tiles")
    windows = tiles.select("doc", F.inline("windows")).select("doc", "pos", F.lit(0).alias("gap"), "key", "end")
    of_windows = write_table(_chain_rows(_pairs(_linked(windows, "windows")), least_words), "window-chains")
    chained = chained.withColumn("kind", F.lit(0)).unionByName(of_windows.withColumn("kind", F.lit(1)))
    keys = ["doc", "partner", "kind", "x0", "y0"]
    sides = chained.select(*keys, F.lit(0).alias("side"), F.col("doc").alias("of"), F.explode(x).alias("tile"), "chain").unionByName(
        chained.select(*keys, F.lit(1).alias("side"), F.col("partner").alias("of"), F.explode(y).alias("tile"), F.lit(None).cast("binary").alias("chain"))
    )
    tiles = tiles.select(F.col("doc").alias("of"), "tile", "words")
    both = join_hot(sides, tiles, ["of", "tile"]).select("doc", "partner", "kind", "x0", "y0", "side", "tile", "chain", "words")
    both = both.repartition("doc", "partner").sortWithinPartitions("doc", "partner", "kind", "x0", "y0", "side", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["doc_id", "first_word", "last_word", "partner_id", "partner_first_word", "partner_last_word", "n_equal", "identity"]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 7 else pa.float64()) for k in range(8)], names)

        pair, known = None, set()
        for g in groups(batches, 5):
            mine = len(g["side"]) - np.count_nonzero(g["side"])  # the tiles of the first text come first
            a, b = (np.frombuffer(b"".join(g["words"][s]), np.uint32) for s in (slice(mine), slice(mine, None)))
            dx, dy = int(g["tile"][0]) * TILE, int(g["tile"][mine]) * TILE
            if pair != (pair := (g["doc"][0], g["partner"][0])):
                known.clear()
            chain = np.frombuffer(g["chain"][0], np.int32).reshape(3, -1) - np.array([[dx], [dy], [0]])
            for x0, x1, y0, y1, equal in align(a, b, list(zip(*chain.tolist(), strict=True)), least_words, least_equal):
                one, two = (pair[0], x0 + dx, x1 + dx - 1), (pair[1], y0 + dy, y1 + dy - 1)
                if (one, two) not in known:
                    known.add((one, two))
                    part = equal / max(x1 - x0, y1 - y0)
                    out += [(*one, *two, equal, part), (*two, *one, equal, part)]
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        yield batch()

    return both.mapInArrow(run, _PASSAGES)
