"""Rows of a shuffle packed as arrays per bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from spindle.llm.textnum import splitmix


def put(labels: np.ndarray, bucket: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(label, least id, ids as 4- or 8-byte offsets, columns...) per bucket."""
    if not len(bucket):
        return []
    bucket = bucket.astype(np.uint16 if len(labels) < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, columns = bucket[order], ids[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    out = []
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        part, base = ids[a:b], int(ids[a:b].min())
        rel = part - base
        rel = rel.astype("<u4") if int(rel.max()) < 1 << 32 else rel.astype("<i8")
        out.append((int(labels[bucket[a]]), base, rel.tobytes(), *[c[a:b].tobytes() for c in columns]))
    return out


def get_ids(base: int, raw: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw.size == 4 * n else "<i8").astype(np.int64) + base


def rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def open_(table: pa.Table, *kinds: str) -> tuple[np.ndarray, ...]:
    """All ids and columns of the packed rows of one bucket."""
    out = []
    cols = [table.column(i).combine_chunks() for i in range(1, table.num_columns)]
    for r in range(table.num_rows):
        raws = [c[r].as_buffer() for c in cols[1:]]
        values = [np.frombuffer(x, k) for x, k in zip(raws[1:], kinds, strict=True)]
        out.append((get_ids(cols[0][r].as_py(), raws[0], len(values[0])), *values))
    if not out:
        return (np.zeros(0, np.int64), *[np.zeros(0, k) for k in kinds])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def folder_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (splitmix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
