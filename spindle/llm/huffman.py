"""Token ids in binary files: canonical length-limited Huffman coding.

Code lengths (at most ``MAX_BITS``) come from the counts of all ids, by the
package-merge method; codes are canonical, so a table of lengths is the whole
code.  Ids are written in ascending doc_id order in independent blocks of
``BLOCK`` ids; a document may span blocks.
Every ``STEP`` ids a block notes its bit offset, so decoding runs from all
checkpoints of all blocks at once, one table look-up per id.

File format: a Parquet directory ``segments`` and one ``code`` (id, n_bits).  A
segment holds whole documents, about a million characters or one longer
document: range, segment, doc_ids, n_tokens (of each document), block_ids (ids
in each block), block_bytes (its payload's bytes), checkpoints (32-bit bit
offsets within the block), payload (the blocks, each on a byte boundary).
Ranges are contiguous ranges of doc_id; (range, segment) is ascending doc_id.

Defined results: a null or empty text is its end id alone.  Rows repeated with
one doc_id are written one after the other, in order of their texts, and keep
their own rows.  An empty table gives an empty file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.store import Workspace, shuffle_partitions
from spindle.llm.subword import encoder, text_batches

MAX_BITS = 16
BLOCK = 1 << 16
STEP = 256


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``most`` (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n, levels = len(order), []
    row, leaf = weight, np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < n
    levels.append(leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the lengths, counted up in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next ``most`` bits."""
    ids, bits = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.uint8)
    at = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            k = 1 << (most - int(lengths[i]))
            ids[at : at + k], bits[at : at + k] = i, lengths[i]
            at += k
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(payload, bits, bit offset of every STEP-th id) of one block."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    bits = int(end[-1]) if len(end) else 0
    words = np.zeros(bits // 32 + 2, np.uint64)
    if len(ids):
        value = codes[ids].astype(np.uint64) << (64 - size - (begin & 31)).astype(np.uint64)
        word = begin >> 5
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        high, low = value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)
        words[word[first]] += np.add.reduceat(high, first)
        words[word[first] + 1] += np.add.reduceat(low, first)
    return words.astype(">u4").tobytes()[: (bits + 7) // 8], bits, begin[::STEP].astype("<u4")


def unpack(payload: bytes, block_ids: list[int], block_bytes: list[int], checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of one segment, decoded from all checkpoints of all blocks side by side."""
    if not block_ids:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    per = -(-np.array(block_ids) // STEP)
    begin = np.concatenate([[0], np.cumsum(block_bytes)[:-1]]) * 8
    at = checkpoints.astype(np.int64) + np.repeat(begin, per)
    left = np.full(len(at), STEP)
    left[np.cumsum(per) - 1] = np.array(block_ids) - (per - 1) * STEP
    out = np.zeros((STEP, len(at)), np.uint32)
    ids, bits = table
    last = len(window) - 1
    for k in range(int(left.max())):
        x = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[k] = ids[x]
        at += bits[x]
    return out.T[np.arange(STEP) < left[:, None]]


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str, end_id: int, path: str | None = None) -> str:
    """Tokenise ``docs`` (doc_id, text) and write the file; returns its path, without ``path`` a folder that the session deletes at its end."""
    work = Workspace(spark, "huffman")
    path = path or f"{work.base}/file"
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def tokens(batches):
        enc, at, segment = encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for i, texts in text_batches(b.column(1).to_pylist()):
                parts = [x.tobytes() + end for x in enc.encode(texts)]
                sizes = [len(x) // enc.dtype.itemsize for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([segment], pa.int64()), pa.array([b.column(0).slice(i, len(parts)).to_pylist()], pa.list_(b.column(0).type)),
                     pa.array([sizes], pa.list_(pa.int64())), _binary([b"".join(parts)])],
                    ["range", "segment", "doc_ids", "n_tokens", "ids"],
                )
                segment += 1

    head = f"range int, segment bigint, doc_ids array<{doc_type}>, n_tokens array<bigint>"
    encoded = work.write(ordered.mapInArrow(tokens, f"{head}, ids binary"), "tokens")
    wide = encoder(tokenizer, kind).dtype
    vocabulary = max(encoder(tokenizer, kind).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), wide), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    # at most one row per id of the vocabulary comes to the driver
    table = encoded.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    if table.num_rows:
        counts[table.column(0).to_numpy()] = table.column(1).to_numpy()
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((canonical(lengths), lengths))
    spark.createDataFrame([(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()], "id int, n_bits int").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches):
        codes, bits_of = shared.value
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column(4)[r].as_buffer(), wide)
                done = [(min(BLOCK, len(ids) - i), *pack(ids[i : i + BLOCK], codes, bits_of)) for i in range(0, len(ids), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).slice(r, 1) for k in range(4)], pa.array([[x[0] for x in done]], pa.list_(pa.int32())), pa.array([[len(x[1]) for x in done]], pa.list_(pa.int64())),
                     _binary([b"".join(x[3].tobytes() for x in done)]), _binary([b"".join(x[1] for x in done)])],
                    ["range", "segment", "doc_ids", "n_tokens", "block_ids", "block_bytes", "checkpoints", "payload"],
                )

    encoded.mapInArrow(encode, f"{head}, block_ids array<int>, block_bytes array<bigint>, checkpoints binary, payload binary").write.option("compression", "none").parquet(f"{path}/segments")
    work.drop(encoded)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, decoded from the file."""
    return _read(spark, path, lambda x: x.tobytes(), "ids", pa.binary(), "binary")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with the crc32 of the decoded ids in place of the ids."""
    return _read(spark, path, lambda x: zlib.crc32(x.tobytes()), "ids_crc32", pa.int64(), "bigint")


def _read(spark: SparkSession, path: str, of, name: str, arrow: pa.DataType, kind: str) -> DataFrame:
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max([r.id for r in code], default=0) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.n_bits
    table = spark.sparkContext.broadcast(decode_table(lengths))
    segments = spark.read.parquet(f"{path}/segments")
    sizes = segments.select("range", "segment", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("_n"))
    # one total per range comes to the driver: as many rows as the writing stage had tasks
    totals = sizes.groupBy("range").agg(F.sum("_n").alias("n")).orderBy("range").collect()
    ends = np.cumsum([r["n"] for r in totals])
    begin = spark.createDataFrame([(r["range"], int(ends[i] - r["n"])) for i, r in enumerate(totals)], "range int, _begin bigint")
    before = (
        sizes.withColumn("_within", F.sum("_n").over(Window.partitionBy("range").orderBy("segment")) - F.col("_n"))
        .join(F.broadcast(begin), "range")
        .select("range", "segment", (F.col("_within") + F.col("_begin")).alias("_before"))
    )
    doc_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                marks = np.frombuffer(col["checkpoints"][r].as_buffer(), "<u4")
                ids = unpack(col["payload"][r].as_py(), col["block_ids"][r].as_py(), col["block_bytes"][r].as_py(), marks, table.value)
                n = np.array(col["n_tokens"][r].as_py(), np.int64)
                ends = np.cumsum(n)
                if len(n) and ends[-1] != len(ids):
                    raise ValueError("a segment does not hold the ids that it lists")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), col["range"][r].as_py(), np.int32)), pa.array(np.full(len(n), col["segment"][r].as_py())), col["doc_ids"][r].values, pa.array(ends - n), pa.array(n), pa.array([of(x) for x in np.split(ids, ends[:-1])], arrow)],
                    ["range", "segment", "doc_id", "start", "n_tokens", name],
                )

    found = segments.mapInArrow(decode, f"range int, segment bigint, doc_id {doc_type}, start bigint, n_tokens bigint, {name} {kind}")
    return found.join(before, ["range", "segment"]).select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", name)
