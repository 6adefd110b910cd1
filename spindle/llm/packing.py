"""Best-fit packing of documents into token sequences by bin completion.

Documents longer than a sequence are cut into full pieces after a first piece
that may be shorter.  Piece lengths are integers up to the sequence length, so
the whole packing problem is the table "pieces of each length": a bounded size
whatever the corpus.  The driver solves it:

* bins are completed around the longest piece left.  The undominated fillings
  of the room that it leaves are enumerated fullest first, longer pieces first
  (a filling is dominated if some of its pieces, or none, could be exchanged
  for one longer piece that is still there and fits);
* a filling is used for as many bins as the counts allow, or as a later choice
  for one bin;
* best-fit decreasing gives the first incumbent.  A branch whose waste so far
  would need as many bins as the incumbent is pruned; a packing with
  ceil(tokens / length) bins is proved best and ends the search;
* branches are taken in order of how often they leave the first choice.  The
  search is complete but for one bound, ``STEPS`` partial fillings looked at:
  after that many the incumbent is used.

Pieces then get their places by rank among the pieces of their length; ranks
come from (task, rank in the task) of the written piece table, so no length,
however common, is gathered in one task.

Defined results: a null or empty text is its end id alone, one piece.  Rows
repeated with one doc_id are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.store import Workspace
from spindle.llm.subword import encoder, text_batches

STEPS = 200_000
#: Steps that a new bin counts for: a table of the sums that the lengths left can reach.
_BIN = 100


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, bins) by best-fit decreasing, over counts of lengths."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                rooms.setdefault(size - n, {})[(n,)] = left
                k = size // n
                whole, rest = divmod(left, k)
                del rooms[size - n][(n,)]
                if not rooms[size - n]:
                    del rooms[size - n]
                if whole:
                    at = rooms.setdefault(size - n * k, {})
                    at[(n,) * k] = at.get((n,) * k, 0) + whole
                if rest:
                    at = rooms.setdefault(size - n * rest, {})
                    at[(n,) * rest] = at.get((n,) * rest, 0) + 1
                break
            bins = rooms[room]
            items, have = next(iter(bins.items()))
            use = min(have, left)
            bins[items] -= use
            if not bins[items]:
                del bins[items]
            if not bins:
                del rooms[room]
            at = rooms.setdefault(room - n, {})
            at[items + (n,)] = at.get(items + (n,), 0) + use
            left -= use
    return [(items, k) for bins in rooms.values() for items, k in bins.items()]


def fillings(counts: dict[int, int], room: int, most_waste: int | None = None, steps: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` with at most ``most_waste`` left, fullest
    first, of equal ones those with longer pieces first.  ``steps``: how many
    partial fillings may be looked at, counted down."""
    steps = [1 << 62] if steps is None else steps
    steps[0] -= _BIN
    lengths = sorted((n for n, k in counts.items() if k and n <= room), reverse=True)
    whole = (1 << room + 1) - 1
    there = sum(1 << n for n in lengths)
    # bit s of reach[i]: some pieces of lengths[i:] have the sum s
    reach = [1]
    for n in reversed(lengths):
        bits, left, step = reach[-1], min(counts[n], room // n), 1
        while left and bits != whole:
            bits = (bits | bits << min(step, left) * n) & whole
            left -= min(step, left)
            step *= 2
        reach.append(bits)
    reach.reverse()

    def exact(i: int, left: int, waste: int, chosen: tuple[int, ...], spare: int, several: int, seen: int) -> Iterator[tuple[int, ...]]:
        """``spare``: lengths still there; ``several`` and ``seen``: sums of two
        or more, and of any, of the chosen pieces (bit sets)."""
        steps[0] -= 1
        if not left:
            one = sum(1 << n for n in set(chosen))
            # none of the pieces, one or several go for one that is longer by at most the waste
            if not (spare & (2 << waste) - 2 or any(spare & (several | one) << gap for gap in range(1, waste + 1))):
                yield chosen
            return
        for j in range(i, len(lengths)):
            if not reach[j] >> left & 1 or steps[0] <= 0:
                return
            n = lengths[j]
            options, most = [], min(counts[n], left // n)
            s, t = several, seen
            for k in range(1, most + 1):
                s, t = s | (t ^ 1) << n, t | t << n
                now = spare ^ (1 << n) if k == counts[n] else spare
                if s & now:
                    break  # pieces that a longer one could replace: whatever follows is shorter
                if reach[j + 1] >> left - k * n & 1:
                    options.append((k, now, s, t))
            for k, now, s, t in reversed(options):
                yield from exact(j + 1, left - k * n, waste, chosen + (n,) * k, now, s, t)

    for waste in range(min(room, room if most_waste is None else most_waste) + 1):
        if reach[0] >> room - waste & 1:
            yield from exact(0, room - waste, waste, (), there, 0, 1)


def solve(counts: dict[int, int], size: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, bins with them) that hold all pieces in few bins."""
    counts = {n: k for n, k in counts.items() if k}
    if not counts:
        return []
    total = sum(n * k for n, k in counts.items())
    least = -(-total // size)
    best = best_fit_decreasing(counts, size)
    bins = sum(k for _, k in best)
    deviations, cut, budget = 0, True, [steps]
    while cut and bins > least and budget[0] > 0:
        cut = False
        # (pieces left, bins made as a linked list, their number, their waste, deviations left)
        path: list[tuple[dict[int, int], tuple | None, int, int, int]] = [(counts, None, 0, 0, deviations)]
        while path and bins > least and budget[0] > 0:
            left, made, used, waste, spare = path.pop()
            allowed = (bins - 1) * size - total - waste
            if allowed < 0:
                continue
            if not left:
                best, bins = [], used
                while made:
                    best.append(made[0])
                    made = made[1]
                continue
            top = max(left)
            others = dict(left)
            others[top] -= 1
            options, once = [], []
            for items in fillings(others, size - top, allowed, budget):
                need = Counter((top, *items))
                times = min(left[n] // k for n, k in need.items())
                room = size - top - sum(items)
                if room:
                    times = max(1, min(times, allowed // room))
                options.append((need, items, times, room))
                if times > 1:
                    once.append((need, items, 1, room))
                if len(options) > spare:
                    cut = True  # there may be more
                    break
            children = []
            for k, (need, items, times, room) in enumerate(options + once):
                if k > spare:
                    cut = True
                    break
                rest = {n: c - times * need.get(n, 0) for n, c in left.items()}
                children.append(({n: c for n, c in rest.items() if c}, (((top, *items), times), made), used + times, waste + times * room, spare - k))
            path += reversed(children)
        deviations += 1
    return best


def pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str, end_id: int, size: int = 1024) -> tuple[Workspace, DataFrame]:
    """The written piece table: doc_id, piece, start, length, ids, ids_crc32, task, rank."""
    work = Workspace(spark, "packing")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        enc, task = encoder(tokenizer, kind), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        seen = np.zeros(size + 1, np.int64)
        for b in batches:
            for i, texts in text_batches(b.column(1).to_pylist()):
                rows, piece, start, ids, crc = [], [], [], [], []
                for k, x in enumerate(enc.encode(texts)):
                    x = np.concatenate([x.astype("<u4"), end])
                    first = len(x) % size or size
                    for p, at in enumerate([0, *range(first, len(x), size)]):
                        part = x[at : at + (size if p else first)].tobytes()
                        rows.append(i + k)
                        piece.append(p)
                        start.append(at)
                        ids.append(part)
                        crc.append(zlib.crc32(part))
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                order = np.argsort(length, kind="stable")
                _, first_of, n_of = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids)) - np.repeat(first_of, n_of)
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length), pa.array(ids, pa.binary()),
                     pa.array(crc, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "rank"],
                )

    out = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {doc_type}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, task int, rank bigint")
    return work, work.write(out, "pieces")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str, end_id: int, size: int = 1024) -> DataFrame:
    """All pieces with their ids (little-endian unsigned 32-bit), sequence_id and offset."""
    _, table = pieces(spark, docs, tokenizer, kind, end_id, size)
    counts = table.groupBy("task", "length").agg(F.count("*").alias("_n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, sequence, taken = [], 0, dict.fromkeys(totals, 0)
    for items, times in solve(totals, size):
        at = 0
        for n in items:
            slots.append((n, taken[n], taken[n] + times, sequence, at))
            taken[n] += times
            at += n
        sequence += times
    # a row per piece of a pattern; patterns use up a length each, so their number is bounded by the sequence length
    places = spark.createDataFrame(slots, "length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("task")) - F.col("_n")).drop("_n")
    ranked = table.join(before, ["task", "length"]).withColumn("_rank", F.col("rank") + F.col("_before"))
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(places.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside).select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )
