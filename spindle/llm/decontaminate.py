"""Benchmark decontamination by the q-gram lemma.

A document matches an item if some ``WINDOW`` bytes of the item occur in it
with at most ``EDITS`` edits (items shorter than that: the whole item, with a
proportional budget).  Such an occurrence shares at least
WINDOW - Q + 1 - Q * EDITS q-grams with the window, on diagonals that lie no
more than EDITS apart.  So, over bytes of texts with ASCII lower case and all
separators as spaces:

* places of the text whose q-gram occurs in any item are found in a bit table
  and kept where the lemma's number of them lies within a window's length;
* kept places are joined with the items' postings; (item, diagonal) pairs are
  counted in overlapping bands of ``2 * BAND`` diagonals, and a region stays
  if the lemma's number lies within a window's length of the item;
* every region is verified by an alignment within its band.

The items' index is made and broadcast in blocks of at most ``BLOCK_BYTES`` of
item text, one after the other and one pass over the documents a block, so its
size is bounded whatever the benchmark holds.

Defined results: null and empty texts match nothing; items that are null or
shorter than ``SHORTEST`` bytes are no evidence and match nothing.  Rows are
judged one by one, so repeated rows are reported alike.  A match is reported
once per row and item_id, at its first place: the bytes of the first windows
that match and touch, by alignment.  Inside stretches of a text that repeat a
period of up to Q bytes only the two ends are searched: what matches inside
matches there too, and a match there is continued through the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.store import Workspace
from spindle.llm.textnum import LOWER, SEPARATOR, chunks, ranges

Q = 8
WINDOW = 64
EDITS = 5
BAND = 8
REACH = WINDOW + 2 * EDITS
SHORTEST = 32
BLOCK_BYTES = 8 << 20
#: Pairs of a place and a posting that are held at once, besides the overlap of slices.
SLICE = 1 << 21
_TABLE_BITS = 22
_PLAIN = LOWER.copy()
_PLAIN[SEPARATOR] = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def budget(n: int) -> tuple[int, int, int]:
    """(window, edits, least q-grams) for an item of n bytes."""
    window = min(n, WINDOW)
    edits = EDITS * window // WINDOW
    return window, edits, max(1, window - Q + 1 - Q * edits)


def _grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for r in range(Q):
        part = data[r : r + (len(data) - r) // 8 * 8].view("<u8")
        out[r::8] = part[: len(out[r::8])]
    return out


class Index:
    """Q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.texts = [_PLAIN[np.frombuffer(t, np.uint8)] for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        grams = [_grams(t) for t in self.texts]
        every = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(every, kind="stable")
        self.gram, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item, self.place = item[order], place[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.gram * _MULT) >> np.uint64(64 - _TABLE_BITS)] = True
        limits = [budget(len(t)) for t in self.texts]
        self.window, self.edits, self.least = (np.array(x, np.int64) for x in zip(*limits, strict=True)) if limits else (np.zeros(0, np.int64),) * 3
        self.fewest = int(self.least.min()) if limits else 0
        self.reach = int((self.window + 2 * self.edits).max()) if limits else 0


def distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edits of the pattern against any part of the text, its end): Myers' bit vectors."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _stretches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the stretches of a period of 1 to Q bytes, within one
    text, that are longer than four times what a window can reach."""
    out = []
    for p in range(1, Q + 1):
        if len(data) <= p:
            break
        same = np.concatenate([[False], data[p:] == data[:-p], [False]])
        # bytes of different texts are not compared
        for k in range(1, p + 1):
            last = offs[1:-1] - k
            same[last[(last >= 0) & (last < len(data) - p)] + 1] = False
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2] + p  # the stretch is data[begin:end]
        long = end - begin > 4 * REACH
        out.append((begin[long], end[long], np.full(int(long.sum()), p)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def find(index: Index, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item number, start, end) of the matches in a chunk of texts: the
    first place of each item in a text, byte offsets within the text.  A text's
    matches hang on the text and the item alone, not on what else is in the chunk
    or the index.  Places and postings are paired in slices of about ``SLICE``
    pairs, which overlap by what a window can reach; the windows to align are
    gathered from all slices first."""
    if not len(data) or not len(index.gram):
        return []
    data = _PLAIN[data]
    gram = _grams(data)
    at = np.flatnonzero(index.table[(gram * _MULT) >> np.uint64(64 - _TABLE_BITS)])
    t = index.fewest
    if len(at) < t:
        return []
    dense = np.flatnonzero(at[t - 1 :] - at[: len(at) - t + 1] <= index.reach)
    step = np.zeros(len(at) + 1, np.int32)
    np.add.at(step, dense, 1)
    np.add.at(step, dense + t, -1)
    at = at[np.cumsum(step[:-1]) > 0]
    k = np.searchsorted(index.gram, gram[at])
    k = np.minimum(k, len(index.gram) - 1)
    known = index.gram[k] == gram[at]
    at, k = at[known], k[known]
    row = np.searchsorted(offs, at, side="right") - 1
    whole = at + Q <= offs[row + 1]
    at, k, row = at[whole], k[whole], row[whole]
    if not len(at):
        return []
    # what matches deep inside a stretch also matches, shifted by periods, near its beginning
    begins, ends, periods = _stretches(data, offs)
    if len(begins):
        deep = np.zeros(len(data) + 1, np.int32)
        np.add.at(deep, begins + 2 * REACH, 1)
        np.add.at(deep, ends - 2 * REACH, -1)
        keep = np.cumsum(deep)[at] == 0
        at, k, row = at[keep], k[keep], row[keep]
    n_of = index.first[k + 1] - index.first[k]
    pairs = np.concatenate([[0], np.cumsum(n_of)])
    a, regions = 0, [np.zeros((5, 0), np.int64)]
    while a < len(at):
        b = min(len(at), max(a + 1, int(np.searchsorted(pairs, pairs[a] + SLICE, side="right")) - 1))
        # the slice holds all places that a window begun in it can reach, and what these can reach
        begin = int(np.searchsorted(at, at[a] - index.reach - Q))
        stop = int(np.searchsorted(at, at[b - 1] + 2 * (index.reach + Q), side="right"))
        regions.append(_regions(index, offs, at[begin:stop], k[begin:stop], row[begin:stop], n_of[begin:stop]))
        a = b
    spans = _verify(index, data, offs, np.concatenate(regions, axis=1))
    out = []
    for (r, i), found in sorted(spans.items()):
        base = int(offs[r])
        found = [_shifted(x, y, base, begins, ends, periods) for x, y in found] if len(begins) else found
        found.sort()
        first, last = found[0]
        for begin, end in found[1:]:
            if begin > last:
                break
            last = max(last, end)
        out.append((r, i, first, last))
    return out


def _shifted(begin: int, end: int, base: int, begins: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> tuple[int, int]:
    """A match, with all its copies in the stretch that it lies in."""
    for k in np.flatnonzero((begins <= base + begin) & (base + end <= ends)):
        p = int(periods[k])
        return begin - (base + begin - int(begins[k])) // p * p, end + (int(ends[k]) - base - end) // p * p
    return begin, end


def _regions(index: Index, offs: np.ndarray, at: np.ndarray, k: np.ndarray, row: np.ndarray, n_of: np.ndarray) -> np.ndarray:
    """Rows, items, bands, and first and last windows to align, of some places of the text."""
    none = np.zeros((5, 0), np.int64)
    post = ranges(index.first[k], n_of)
    at, row = np.repeat(at, n_of), np.repeat(row, n_of)
    item, place = index.item[post], index.place[post]
    # the lemma's number of places for the item itself, in its own reach
    order = np.argsort(row * len(index.ids) + item, kind="stable")
    at, row, item, place = at[order], row[order], item[order], place[order]
    other = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    new = np.concatenate([[True], other | (at[1:] != at[:-1])])
    u = np.flatnonzero(new)
    end = np.arange(len(u)) + index.least[item[u]] - 1
    run = np.flatnonzero(end < len(u))
    end = end[run]
    near = (row[u[end]] == row[u[run]]) & (item[u[end]] == item[u[run]]) & (at[u[end]] - at[u[run]] <= index.window[item[u[run]]] + 2 * index.edits[item[u[run]]])
    step = np.zeros(len(u) + 1, np.int32)
    np.add.at(step, run[near], 1)
    np.add.at(step, end[near] + 1, -1)
    keep = (np.cumsum(step[:-1]) > 0)[np.cumsum(new) - 1]
    at, row, item, place = at[keep], row[keep], item[keep], place[keep]
    if not len(row):
        return none
    diagonal = at - offs[row] - place
    # a diagonal lies in two overlapping bands
    band = np.concatenate([diagonal // BAND, diagonal // BAND - 1])
    row, item, place = (np.concatenate([x, x]) for x in (row, item, place))
    order = np.lexsort((place, band, item, row))
    row, item, band, place = row[order], item[order], band[order], place[order]
    group = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    once = np.concatenate([[True], group | (place[1:] != place[:-1])])
    row, item, band, place = row[once], item[once], band[once], place[once]
    group = np.concatenate([[0], np.cumsum((row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))])
    # runs of the lemma's number of q-grams within a window of the item
    run = np.arange(len(row))
    end = run + index.least[item] - 1
    run, end = run[end < len(row)], end[end < len(row)]
    window = index.window[item[run]]
    good = (group[end] == group[run]) & (place[end] - place[run] <= window - Q)
    run, end, window = run[good], end[good], window[good]
    # all windows of the item that hold a run
    low, high = np.maximum(0, place[end] + Q - window), np.minimum(place[run], index.size[item[run]] - window)
    held = low <= high
    run, low, high = run[held], low[held], high[held]
    if not len(run):
        return none
    new = np.flatnonzero(np.concatenate([[True], (group[run[1:]] != group[run[:-1]]) | (low[1:] > high[:-1] + 1)]))
    at = run[new]
    return np.stack([row[at], item[at], band[at], low[new], high[np.append(new[1:], len(run)) - 1]])


def _verify(index: Index, data: np.ndarray, offs: np.ndarray, regions: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The places of items in rows, by alignment of the windows of ``regions``."""
    row, item, band, lows, highs = regions[:, np.lexsort(regions[::-1])]
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if not len(row):
        return spans
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
    for x, y in zip(new, [*new[1:], len(row)], strict=True):
        i, r = int(item[x]), int(row[x])
        window, edits = int(index.window[i]), int(index.edits[i])
        base, size = int(offs[r]), int(offs[r + 1] - offs[r])
        text = index.texts[i]
        found = spans.setdefault((r, i), [])
        low, high = int(band[x]) * BAND, (int(band[x]) + 2) * BAND
        mark = np.zeros(len(text) + 2, np.int32)
        np.add.at(mark, lows[x:y], 1)
        np.add.at(mark, highs[x:y] + 1, -1)
        after, seen = -1, np.flatnonzero(np.cumsum(mark) > 0).tolist()
        for s in seen:
            # what a band before this one, or half a window ago, has shown is not aligned again; the last window gives the end
            if s != seen[-1] and (s < after or any(b <= s + high and s + low + window <= e + edits for b, e in found)):
                continue
            begin, stop = max(0, s + low - edits), min(size, s + window + high + edits)
            if stop <= begin:
                continue
            pattern, part = text[s : s + window].tobytes(), data[base + begin : base + stop].tobytes()
            d, last = distance(pattern, part)
            if d <= edits:
                _, length = distance(pattern[::-1], part[:last][::-1])
                found.append((begin + last - length, begin + last))
                after = s + window // 2
        if not found:
            del spans[r, i]
    return spans


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size over all usable items, one after the other; the
    items of one item_id are in one block, repeated rows count once."""
    usable = benchmark.where(F.col("item_id").isNotNull() & (F.octet_length("text") >= SHORTEST)).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (BLOCK_BYTES // 2)) or 1
    for k in range(n):
        held, total = [], 0
        for r in usable.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toLocalIterator():
            if total >= BLOCK_BYTES and r["item_id"] != held[-1][0]:
                yield Index(held)
                held, total = [], 0
            held.append((r["item_id"], r["text"].encode()))
            total += len(held[-1][1])
        if held:
            yield Index(held)


def _passes(docs: DataFrame, benchmark: DataFrame, apply) -> Iterator[DataFrame]:
    """``apply(docs, broadcast index)`` of every block.  Of one block the plan is
    given as it is; of several each result is written before the next index is
    made, so that driver and executors hold one at a time."""
    found = blocks(benchmark)
    index, work = next(found, None), None
    while index is not None:
        following = next(found, None)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = apply(docs, shared)
        if following is not None or work is not None:
            work = work or Workspace(docs.sparkSession, "leaks")
            out = work.write(out, "block")
            shared.unpersist()
        docs = yield out
        index = following


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (byte offsets of the first place) for every row
    of ``docs`` and every item that matches; items with one item_id are one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, start bigint, end bigint"

    def scan(docs, shared):
        def run(batches):
            index = shared.value
            for b in batches:
                for i, _, data, offs in chunks(b.column(1)):
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for r, x, start, end in find(index, data, offs):
                        key = (i + r, index.ids[x])
                        best[key] = min(best.get(key, (start, end)), (start, end))
                    if best:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([r for r, _ in best])), pa.array([x for _, x in best], pa.int64()), *[pa.array([v[j] for v in best.values()], pa.int64()) for j in (0, 1)]],
                            ["doc_id", "item_id", "start", "end"],
                        )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out, passes = None, _passes(docs, benchmark, scan)
    try:
        part = next(passes)
        while True:
            out = part if out is None else out.union(part)
            part = passes.send(docs)
    except StopIteration:
        return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    at = docs.columns.index("text")

    def keep(docs, shared):
        def run(batches):
            index = shared.value
            for b in batches:
                good = np.ones(b.num_rows, bool)
                for i, _, data, offs in chunks(b.column(at)):
                    for r, *_ in find(index, data, offs):
                        good[i + r] = False
                yield b.filter(pa.array(good))

        return docs.mapInArrow(run, docs.schema)

    passes = _passes(docs, benchmark, keep)
    try:
        docs = next(passes)
        while True:
            docs = passes.send(docs)
    except StopIteration:
        return docs
