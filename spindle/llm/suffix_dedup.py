"""Repeated byte windows across documents, by depth-limited radix sorting.

A byte is removed if it is covered by a ``depth``-byte string that also starts
in a document with a smaller doc_id.  Suffixes are ordered only through their
first ``depth`` bytes, by most-significant-digit passes of eight bytes: groups
of equal digits are split by the next digit only while they hold several
documents, and equal groups at full depth are equal bytes: exactly the
repeated windows.

What keeps the work small, and never decides what is equal:

* every window of ``depth`` bytes is filed under the ``KEY``-byte string in it
  with the smallest hash (leftmost), so equal windows are filed alike wherever
  they stand, and neighbouring windows share a place ("stretch");
* pass 1 finds the hashes of such strings that stand in two documents; text
  under all others has no partner and never leaves its task;
* pass 2 sends the other stretches, as bytes, to buckets by their string.  In a
  bucket the digits of the string come first; then whole stretches are sorted,
  so that a stretch of many copies is one; then the windows of what is left.

Rows in the shuffles are packed arrays per bucket, ``_EACH`` buckets a shuffle
partition, one of which is in memory at a time.  A frequent string is one small
record per document; nothing is paired.  Texts are moved twice, compressed, to
``folder``s of documents.  Tables between passes are written to the shared folder.

Defined results: null text is empty; texts shorter than ``depth`` lose
nothing.  A row without doc_id keeps its text and removes nothing elsewhere.
Rows with one doc_id are one document and do not remove from each other.
doc_ids are integers; others raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.packed import folder_of
from spindle.llm.store import Workspace, even_labels, release, shuffle_partitions
from spindle.llm.textnum import chunks, ranges, rolling_hashes

DEPTH = 50
KEY = 20
_FLUSH = 400_000
_FLUSH_BYTES = 16 << 20
_EACH = 2


def stretches(data: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(row, start, end, place, hash of the string there) of the stretches of
    windows filed under one place: window starts run from start to end - depth."""
    key = min(KEY, max(9, depth // 2))
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = rolling_hashes(data, key)
    wide = depth - key + 1
    if len(h) < wide:
        return none
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < wide:
        step = min(span, wide - span)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(a)])
        low = np.minimum(a, b)
        span += step
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    inside = row[: len(at)] == row[depth - 1 : depth - 1 + len(at)]
    window, at = np.flatnonzero(inside), at[inside]
    if not len(window):
        return none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[window[1:]] != row[window[:-1]])]))
    start = window[new]
    end = window[np.concatenate([new[1:], [len(window)]]) - 1] + depth
    place = at[new].astype(np.int64)
    return row[start].astype(np.int64), start, end, place, h[place]


def _least(x: np.ndarray) -> tuple[int, bytes]:
    """Integers as their least and the offsets from it."""
    base = int(x.min())
    return base, _ints(x - base, "<i8")


def _whole(base: int, raw: pa.Buffer) -> np.ndarray:
    return _unints(raw, "<i8") + base


def _groups(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, places) of each key."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return [(int(key[order[a]]), order[a:b]) for a, b in zip(cut, [*cut[1:], len(key)], strict=True)]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _columns(table: pa.Table) -> list[list]:
    """Rows of a small packed table, binary values as buffers."""
    out = []
    for c in table.columns:
        c = c.combine_chunks()
        out.append([x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist())
    return list(zip(*out, strict=True))


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _press(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _ints(x: np.ndarray, kind: str) -> bytes:
    """Integers, compressed byte plane by byte plane: most high bytes are alike."""
    x = x.astype(kind)
    return _press(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unints(raw, kind: str) -> np.ndarray:
    planes = np.frombuffer(_expand(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).reshape(-1)


def _packed(column: pa.Array) -> pa.Array:
    """Binary values compressed one by one: texts are moved and written so."""
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if x is None else press(x) for x in column.to_pylist()], pa.binary())


def _plain(column: pa.Array) -> pa.Array:
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else expand(x) for x in column.to_pylist()], pa.large_binary())


def _digits(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian digit."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + (n + 8 - r + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view(">u8")
        out[r::8] = part[: len(out[r::8])]
    return out


def _digit(digits: np.ndarray, at: np.ndarray, wide: np.ndarray | int) -> np.ndarray:
    """The digits at some places, of which only the first ``wide`` bytes count."""
    bits = np.uint64(8) * (np.uint64(8) - np.minimum(np.maximum(wide, 0), 8).astype(np.uint64)) if isinstance(wide, np.ndarray) else np.uint64(8 * (8 - min(max(wide, 0), 8)))
    x = digits[at]
    if isinstance(bits, np.ndarray):
        return np.where(bits == 64, np.uint64(0), x >> np.minimum(bits, np.uint64(63)))
    return x >> bits if bits < 64 else np.zeros_like(x)


def _split(group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups split by a digit: (order, first place of each new group in it, new group of each element)."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
    out = np.empty(len(group), np.int64)
    out[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), out


def equal_windows(digits: np.ndarray, start: np.ndarray, ids: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, least id) of the suffixes whose first ``depth`` bytes also begin
    suffixes of other ids of their group: passes from the first digit on, over mixed groups alone."""
    which = np.arange(len(start))
    least = np.zeros(0, np.int64)
    for at in range(0, depth, 8):
        if not len(which):
            break
        order, first, group = _split(group, _digit(digits, start[which] + at, depth - at))
        low, high = np.minimum.reduceat(ids[which][order], first), np.maximum.reduceat(ids[which][order], first)
        mixed = (low < high)[group]
        which, least, group = which[mixed], low[group][mixed], group[mixed]
    return which, least


def equal_stretches(digits: np.ndarray, start: np.ndarray, shape: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The class of each stretch: of one group, one shape (place of its string) and the same bytes."""
    _, first, out = _split(group, shape.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        count = np.bincount(out, minlength=len(first))
        open_ = np.flatnonzero((count[out] > 1) & (size > at))
        if not len(open_):
            break
        _, first, finer = _split(out[open_], _digit(digits, start[open_] + at, size[open_] - at))
        out = out.copy()
        out[open_] = len(out) + finer
        out = np.unique(out, return_inverse=True)[1]
        first = np.zeros(int(out.max()) + 1)
    return out


def repeats(data: np.ndarray, start: np.ndarray, size: np.ndarray, shape: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first byte, bytes) of the runs of a bucket's stretches that a
    smaller id holds too.  ``shape``: bytes of a stretch before its string."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(start):
        return none
    digits, key = _digits(data), min(KEY, max(9, depth // 2))
    which, _ = equal_windows(digits, start + shape, ids, np.zeros(len(start), np.int64), key)
    if not len(which):
        return none
    # the string's groups once more, for the elements that are left
    group = np.zeros(len(which), np.int64)
    for at in range(0, key, 8):
        group = _split(group, _digit(digits, start[which] + shape[which] + at, key - at))[2]
    same = equal_stretches(digits, start[which], shape[which], size[which], group)
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[which])
    settled = ids[which] > least[same]
    out = [(which[settled], np.zeros(int(settled.sum()), np.int64), size[which][settled])]
    # one stretch of each class with its least id, where the group has others
    mine = np.flatnonzero(~settled)
    _, one = np.unique(same[mine], return_index=True)
    one = mine[one]
    alone = np.bincount(group[one])[group[one]] == 1
    one = one[~alone]
    if len(one):
        n_of = size[which[one]] - depth + 1
        owner = np.repeat(np.arange(len(one)), n_of)
        at = ranges(np.zeros(len(one), np.int64), n_of)
        stretch = which[one][owner]
        hit, low = equal_windows(digits, start[stretch] + at, ids[stretch], group[one][owner], depth)
        gone = low < ids[stretch][hit]
        hit = np.sort(hit[gone])
        if len(hit):
            # windows in a row are one run; all stretches of the class with its least id get it
            new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)])
            first = hit[new]
            last = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1]
            run_class, run_at, run_size = same[one][owner[first]], at[first], at[last] - at[first] + depth
            order = np.argsort(same[mine], kind="stable")
            low_, high_ = np.searchsorted(same[mine][order], run_class, "left"), np.searchsorted(same[mine][order], run_class, "right")
            times = high_ - low_
            out.append((which[mine[order[ranges(low_, times)]]], np.repeat(run_at, times), np.repeat(run_size, times)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def dedup(docs: DataFrame, depth: int = DEPTH, as_text: bool = False) -> DataFrame:
    """doc_id, kept (remaining bytes; ``as_text``: as a string, a character
    that lost a byte goes), n_bytes, n_removed, n_spans and, as the struct
    ``row``, all input columns but text, per row of ``docs``."""
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    labels = np.array(even_labels(spark, shuffle_partitions(spark), _EACH))
    n = len(labels)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    if doc_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id is {doc_type}, not an integer")
    source = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text"))

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    filed_fields = [("bucket", pa.int32()), ("base", pa.int64()), ("ids", pa.binary()), ("strings", pa.binary())]

    def file_strings(batches):
        held, size = [], 0

        def out():
            ids, h = (np.concatenate(x) for x in zip(*held, strict=True))
            return _batch([(int(labels[b]), *_least(ids[at]), h[at].astype("<u4").tobytes()) for b, at in _groups(bucket_of(h))], filed_fields)

        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column(0)))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in chunks(b.column(1)):
                row, _, _, _, h = stretches(data, offs, depth)
                held.append((ids[i:j][row], h))
                size += len(row)
                if size >= _FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    shared_fields = [("folder", pa.int32()), ("bucket", pa.int32()), ("strings", pa.binary())]

    def shared(table):
        """For each folder: the strings (low 32 bits of their hashes) of its documents that stand in two documents."""
        parts = []
        for _, base, ids, strings in _columns(table):
            h = np.frombuffer(strings, "<u4")
            parts.append((_whole(base, ids), h))
        if not parts:
            return pa.Table.from_batches([_batch([], shared_fields)])
        ids, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        ids, h = ids[order], h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        mixed = (np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first))[np.cumsum(new) - 1]
        ids, h = ids[mixed], h[mixed]
        label = table.column(0)[0].as_py()
        rows = [(int(labels[f]), label, np.unique(h[at]).tobytes()) for f, at in _groups(folder_of(ids, n))]
        return pa.Table.from_batches([_batch(rows, shared_fields)])

    filed = source.mapInArrow(file_strings, "bucket int, base bigint, ids binary, strings binary")
    known = work.write(filed.groupBy("bucket").applyInArrow(shared, "folder int, bucket int, strings binary"), "shared", "none")
    release(spark)

    def to_folders(batches):
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(labels[folder_of(ids, n)], pa.int32()), b.column(0), _packed(b.column(1)), *b.columns[2:]], ["folder", *b.schema.names])

    whole_rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("binary").alias("_text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    row_type = whole_rows.schema["_row"].dataType.simpleString()
    text_schema = f"folder int, _id bigint, _text binary, _row {row_type}"
    foldered = whole_rows.mapInArrow(to_folders, text_schema)
    pack_schema = "bucket int, id_base bigint, ids binary, rows binary, starts binary, sizes binary, shapes binary, bytes binary"
    pack_fields = [("bucket", pa.int32()), ("id_base", pa.int64()), *[(c, pa.binary()) for c in ("ids", "rows", "starts", "sizes", "shapes", "bytes")]]

    def open_stretches(left, right):
        """The texts of a folder with their numbers in it, and the stretches that may have a partner, packed by bucket."""
        number = {int(x): i for i, x in enumerate(labels)}
        keys = [np.uint64(number[b] << 32) | np.frombuffer(s, "<u4").astype(np.uint64) for _, b, s in _columns(right)]
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        label = left.column(0)[0].as_py()
        held, size, packs, seen = [], 0, [], 0

        def out():
            row, ids, start, length, shape, bucket, raw, raw_at = [], [], [], [], [], [], [], 0
            for r, i, s, e, p, b, data in held:
                row.append(r), ids.append(i), start.append(s), length.append(e), shape.append(p), bucket.append(b)
                raw.append(data)
            row, ids, start, length, shape, bucket = (np.concatenate(x) for x in (row, ids, start, length, shape, bucket))
            data = np.concatenate(raw)
            at0 = np.cumsum(length) - length
            for b, at in _groups(bucket):
                packs.append((int(labels[b]), *_least(ids[at]), *[_ints(x[at], "<u4") for x in (row, start)], *[_ints(x[at], "<u2") for x in (length, shape)], _press(data[ranges(at0[at], length[at])].tobytes())))

        for b in left.combine_chunks().to_batches():
            valid = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in chunks(_plain(b.column(2))) if len(keys) else ():
                row, start, end, place, h = stretches(data, offs, depth)
                if not len(row):
                    continue
                mine = bucket_of(h).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                some = (keys[at] == mine) & valid[i:j][row]
                row, start, end, place, h = row[some], start[some], end[some], place[some], h[some]
                held.append((row + i + seen, ids[i:j][row], start - offs[row], end - start, place - start, bucket_of(h), data[ranges(start, end - start)]))
                size += len(held[-1][-1])
                if size >= _FLUSH_BYTES:
                    out()
                    held, size = [], 0
            seen += b.num_rows
        if size:
            out()
        text = left.append_column("_k", pa.array(np.arange(left.num_rows), pa.int64()))
        packed = pa.Table.from_batches([_batch(packs, pack_fields)])
        for name, kind in pack_fields:
            text = text.append_column(name, pa.nulls(left.num_rows, kind))
        filler = pa.table({"folder": pa.array([label] * len(packs), pa.int32()), **{c: pa.nulls(len(packs), text.schema.field(c).type) for c in ("_id", "_text", "_row", "_k")}})
        for name, _ in pack_fields:
            filler = filler.append_column(name, packed.column(name))
        return pa.concat_tables([text, filler.cast(text.schema)])

    state_schema = f"{text_schema}, _k bigint, {pack_schema}"
    state = work.write(foldered.groupBy("folder").cogroup(known.groupBy("folder")).applyInArrow(_left_only(open_stretches, state_schema), state_schema), "state")
    release(spark)
    work.drop(known)
    gone_fields = [("folder", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())]

    def sort_bucket(table):
        parts, folders = [], []
        for folder, _, base, ids, row, start, length, shape, raw in _columns(table):
            size = _unints(length, "<u2").astype(np.int64)
            parts.append((_whole(base, ids), _unints(row, "<u4"), _unints(start, "<u4").astype(np.int64), size, _unints(shape, "<u2").astype(np.int64), np.frombuffer(_expand(raw), np.uint8)))
            folders.append(np.full(len(size), folder, np.int64))
        ids, row, start, size, shape, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        folder = np.concatenate(folders)
        which, at, length = repeats(data, np.cumsum(size) - size, size, shape, ids, depth)
        rows = [(f, *[x[m].astype("<u4").tobytes() for x in (row[which], start[which] + at, length)]) for f, m in _groups(folder[which])]
        return pa.Table.from_batches([_batch(rows, gone_fields)])

    packs = state.where("bucket is not null").select("folder", *[n for n, _ in pack_fields])
    gone = work.write(packs.groupBy("bucket").applyInArrow(sort_bucket, "folder int, rows binary, starts binary, sizes binary"), "gone", "none")
    release(spark)

    out_schema = f"doc_id {doc_type}, kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint, row {row_type}"

    def remove(left, right):
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        spans = [tuple(np.frombuffer(x, "<u4").astype(np.int64) for x in r[1:]) for r in _columns(right)]
        row, start, size = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable")
        row, start, size = row[order], start[order], size[order]
        number = left.column(4).combine_chunks().to_numpy()
        place = np.argsort(number, kind="stable")
        left = left.take(pa.array(place))
        first = 0
        for b in left.combine_chunks().to_batches():
            for i, j, data, offs in chunks(_plain(b.column(2))):
                a, z = np.searchsorted(row, [first + i, first + j])
                base = offs[row[a:z] - first - i] + start[a:z]
                covered = _cover(len(data), base, base + size[a:z])
                new = covered.copy()
                new[1:] &= ~covered[:-1]
                cut = offs[:-1][offs[:-1] < len(covered)]
                new[cut] = covered[cut]
                n_spans += np.diff(np.concatenate([[0], np.cumsum(new)])[offs]).tolist()
                lost = np.concatenate([[0], np.cumsum(covered)])[offs]
                n_removed += np.diff(lost).tolist()
                n_bytes += np.diff(offs).tolist()
                rest = data[~covered].tobytes()
                ends_of = offs - lost
                parts = [rest[x:y] for x, y in zip(ends_of[:-1], ends_of[1:], strict=True)]
                kept += [x.decode("utf-8", "ignore") for x in parts] if as_text else parts
            first += b.num_rows
        return pa.table({"doc_id": left.column("_id"), "kept": pa.array(kept, pa.string() if as_text else pa.binary()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "row": left.column("_row")})

    final_schema = out_schema.replace(f"doc_id {doc_type}", "doc_id bigint", 1)
    texts = state.where("bucket is null").select("folder", "_id", "_text", "_row", "_k")
    return texts.groupBy("folder").cogroup(gone.groupBy("folder")).applyInArrow(_left_only(remove, final_schema), final_schema).withColumn("doc_id", F.col("doc_id").cast(doc_type))


def _left_only(f, schema: str):
    """A folder without documents gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def apply(left, right):
        if not left.num_rows:
            return kinds.empty_table()
        return f(left, right)

    return apply
