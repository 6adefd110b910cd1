"""Balanced partitions of a batch's rows by length, and micro-batches.

One training batch is one group: it is bounded by what the trainer holds, and
only ids and lengths enter its task.  ``MOST_ROWS`` states that bound and is
checked; batches are independent and run in parallel.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000


def differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: the two states of widest spread are merged, heaviest part to lightest.

    With ``equal_size`` every state starts from k items (len(lengths) is a
    multiple of k), so all parts get as many items.  Ties go to the lower index.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size and len(order) % k:
        raise ValueError(f"{len(order)} rows do not make {k} equal parts")
    heap = []
    for at in range(0, len(order), k if equal_size else 1):
        items = order[at : at + (k if equal_size else 1)]
        state = sorted([(lengths[i], [i]) for i in items] + [(0, [])] * (k - len(items)), key=lambda p: -p[0])
        heap.append((state[-1][0] - state[0][0], at, state))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, at, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)], key=lambda p: -p[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], at, merged))
    return [sorted(items) for _, items in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Rows in their order, each to the lightest part (ties: the first; with ``equal_size`` the one with fewest rows)."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows do not make {k} equal parts")
    heap = [(0, 0, j) for j in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        rows, load, j = heapq.heappop(heap)
        parts[j].append(i)
        heapq.heappush(heap, (rows + 1 if equal_size else rows, load + n, j))
    return parts


def _per_batch(rows: DataFrame, batch: str, assign: Callable[[list[int]], list[int]], name: str) -> DataFrame:
    """(batch, row_id, length) to (batch, row_id, length, ``name``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_ROWS:
            raise ValueError(f"a batch of {len(pdf)} rows is over the {MOST_ROWS} of this operator")
        pdf = pdf.sort_values("row_id", kind="stable").reset_index(drop=True)
        pdf[name] = assign(pdf["length"].tolist())
        return pdf

    chosen = rows.select(F.col(batch).cast("bigint").alias(batch), F.col("row_id").cast("bigint").alias("row_id"), F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length"))
    return chosen.groupBy(batch).applyInPandas(run, f"{batch} bigint, row_id bigint, length bigint, {name} int")


def _places(parts: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for j, items in enumerate(parts):
        for i in items:
            out[i] = j
    return out


def partition(rows: DataFrame, batch: str, k: int, method: str = "differencing", equal_size: bool = False) -> DataFrame:
    """Rows (batch, row_id, length) with their ``part`` from 0 to k - 1; lengths of null are 0."""
    split = {"differencing": differencing, "greedy": greedy}[method]
    return _per_batch(rows, batch, lambda n: _places(split(n, k, equal_size), len(n)), "part")


def workload(length: int) -> int:
    """The linear and the quadratic share of a sequence's work."""
    return 24576 * length + length * length


def micro_batches(rows: DataFrame, batch: str, most_tokens: int) -> DataFrame:
    """Rows with their ``micro_batch``: as few as the tokens allow, even by workload.

    Numbered so that light ones come first and last and the heaviest in the middle.
    """

    def assign(lengths: list[int]) -> list[int]:
        if lengths and max(lengths) > most_tokens:
            raise ValueError(f"a row of {max(lengths)} tokens does not fit {most_tokens}")
        k = max(1, min(len(lengths), -(-sum(lengths) // most_tokens)))
        work = [workload(n) for n in lengths]
        parts = sorted(differencing(work, k), key=lambda p: (-sum(work[i] for i in p), p))
        line: deque[list[int]] = deque()
        for at, p in enumerate(parts):  # from the heaviest outwards
            (line.append if at % 2 else line.appendleft)(p)
        return _places(list(line), len(lengths))

    return _per_batch(rows, batch, assign, "micro_batch")


def grouped_partition(rows: DataFrame, batch: str, group: str, k: int) -> DataFrame:
    """As ``partition``, but contiguous rows of one group stay together: runs of
    equal groups are the items, their summed lengths the weights."""
    runs = rows.select(F.col(batch).cast("bigint").alias(batch), F.col("row_id").cast("bigint").alias("row_id"), group, F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_ROWS:
            raise ValueError(f"a batch of {len(pdf)} rows is over the {MOST_ROWS} of this operator")
        pdf = pdf.sort_values("row_id", kind="stable").reset_index(drop=True)
        at = (pdf[group] != pdf[group].shift()).cumsum() - 1
        loads = pdf["length"].groupby(at).sum().tolist()
        pdf["part"] = at.map(dict(enumerate(_places(differencing(loads, k), len(loads)))))
        return pdf[[batch, "row_id", "length", "part"]]

    return runs.groupBy(batch).applyInPandas(run, f"{batch} bigint, row_id bigint, length bigint, part int")


def balanced(rows: DataFrame, batch: str, k: int, mode: str = "plain", mini_batch: int | None = None, group: str | None = None) -> DataFrame:
    """Rows with their ``part`` and ``place`` (the batch's new order: part by
    part).  ``plain``: the whole batch in k equal parts; ``mini``: each run of
    ``mini_batch`` rows by itself, so that rows stay in their mini-batch; ``group``: whole groups."""
    if mode == "group":
        out = grouped_partition(rows, batch, group, k)
        order = ["part", "row_id"]
    elif mode == "mini":
        keyed = rows.withColumn("_batch", F.col(batch) * (1 << 32) + F.floor(F.col("row_id") / mini_batch))
        out = partition(keyed.drop(batch), "_batch", k, equal_size=True)
        out = out.withColumn(batch, F.shiftright("_batch", 32)).withColumn("_mini", F.col("_batch").bitwiseAND(F.lit((1 << 32) - 1))).drop("_batch")
        order = ["part", "_mini", "row_id"]
    elif mode == "plain":
        out = partition(rows, batch, k, equal_size=True)
        order = ["part", "row_id"]
    else:
        raise ValueError(f"unknown mode: {mode}")
    place = F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1  # one training batch
    return out.withColumn("place", place).drop("_mini")
