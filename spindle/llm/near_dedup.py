"""Near-duplicate classes by Order MinHash.

The items of a text are its five-word shingles, each labelled with its
occurrence number.  Every one of ``SAMPLES`` hash functions takes the ``ORDER``
labelled shingles with the smallest values and keeps them in text order; texts
that agree in one such tuple share a bucket.  Two texts are linked if the
banded alignment of their shingle sequences matches m of n1 and n2 shingles
with m / (n1 + n2 - m) >= 0.8.  At that similarity a pair misses all buckets
with a probability of about 5e-6.

* Equal texts are one text from the start (grouped by MD5).
* In a bucket, one-permutation sketches (128 bytes a text) are compared, and a
  spanning forest of the pairs with an estimate of 0.6 or more is written:
  as many rows as texts, never all pairs, and over five standard errors below
  the threshold.  A bucket of more than ``HOT`` texts is dealt to tiles of two
  blocks each, so that every two of its texts meet in some task and no task
  holds more than 2 * HOT of them.
* Components of these rows are read together and verified exactly: an inverted
  index gives every pair's common shingles, pairs that can reach 0.8 are
  aligned, and the links of a spanning forest are written.  A component of
  more than ``TILE`` texts is read in tiles of two blocks each.

Defined results: a text without a word is in a class of its own; a text of
one to four words is one shingle.  doc_id is a key: a doc_id that stands for
several texts joins them in one class only if they are near duplicates.  A row
without doc_id has no class.  doc_ids are integers; others raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.components import components
from spindle.llm.store import Workspace, shuffle_partitions
from spindle.llm.textnum import chunks, span_hashes, splitmix, word_spans

SHINGLE = 5
SIMILARITY = 0.8
SAMPLES = 12
ORDER = 2
BINS = 128
ESTIMATE = 0.6
TILE = 2048
HOT = 512
_MULT = splitmix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = splitmix(np.arange(101, 101 + SAMPLES, dtype=np.uint64))
_PART = splitmix(np.arange(201, 201 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_EMPTY = 255


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word windows; fewer words than a window are one window."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(min(size, len(words))):
        out += words[k : k + n] * _PART[k]
    return splitmix(out)


def labelled(items: np.ndarray) -> np.ndarray:
    """Items told apart by how often they occurred before in the text."""
    order = np.argsort(items, kind="stable")
    s = items[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return items
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    times = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    out = items.copy()
    out[order] = np.where(times > 0, splitmix(s + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), s)
    return out


def order_minhash(items: np.ndarray) -> np.ndarray:
    """One key per sample: the smallest items in text order."""
    values = (items[None, :] ^ _XOR[:, None]) * _MULT[:, None]
    if len(items) > ORDER:
        at = np.sort(np.argpartition(values, ORDER - 1, axis=1)[:, :ORDER], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(items)), (SAMPLES, len(items)))
    key = np.arange(SAMPLES, dtype=np.uint64)
    for k in range(at.shape[1]):
        key = splitmix(key ^ items[at[:, k]])
    return key


def sketch(items: np.ndarray) -> np.ndarray:
    """One byte of the smallest value in each of BINS bins of one hash."""
    least = np.full(BINS, 1 << 32, np.uint64)
    np.minimum.at(least, (items % np.uint64(BINS)).astype(np.int64), items >> np.uint64(32))
    return np.where(least == 1 << 32, _EMPTY, least % np.uint64(_EMPTY)).astype(np.uint8)


def _text_items(column: pa.Array):
    """The labelled shingles of each text, in order."""
    for i, j, data, offs in chunks(column):
        start, end, first = word_spans(data, offs)
        h = span_hashes(data, start, end)
        for k in range(j - i):
            yield labelled(shingles(h[first[k] : first[k + 1]]))


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Matches of the best alignment of two sequences of distinct items within
    the band that any alignment with ``least`` matches keeps to (bit-parallel)."""
    band = len(a) + len(b) - 2 * least
    if band < 0:
        return 0
    place = {x: i for i, x in enumerate(a.tolist())}
    full = (1 << len(a)) - 1
    row = full
    for j, x in enumerate(b.tolist()):
        i = place.get(x)
        if i is not None and -band <= i - j <= band:
            hit = row & (1 << i)
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def linked(a: np.ndarray, b: np.ndarray, common: int, similarity: float = SIMILARITY) -> bool:
    """The alignment reaches the similarity; ``common``: items in both."""
    need = int(np.ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9))
    return common >= need and aligned(a, b, need) >= need


def forest(texts: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of linked texts."""
    sizes = np.array([len(x) for x in texts])
    items, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    waiting = np.ones(len(texts), bool)
    waiting[sizes == 0] = False
    out = []
    for seed in range(len(texts)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        stack = [seed]
        while stack and waiting.any():
            u = stack.pop()
            low, high = np.searchsorted(items, texts[u], "left"), np.searchsorted(items, texts[u], "right")
            at = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(int((high - low).sum()))
            common = np.bincount(owner[at], minlength=len(texts))
            able = waiting & (common * (1 + similarity) >= similarity * (sizes + sizes[u]) - 1e-6)
            for v in np.flatnonzero(able):
                if linked(texts[u], texts[v], int(common[v]), similarity):
                    waiting[v] = False
                    stack.append(int(v))
                    out.append((u, int(v)))
    return out


def sketch_forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sketches with an estimate of ESTIMATE or more."""
    waiting, out = np.arange(len(sketches)), []
    while len(waiting):
        stack, waiting = [int(waiting[0])], waiting[1:]
        while stack and len(waiting):
            u = stack.pop()
            both = sketches[waiting]
            same = ((both == sketches[u]) & (both != _EMPTY)).sum(axis=1)
            used = ((both != _EMPTY) | (sketches[u] != _EMPTY)).sum(axis=1)
            near = same >= ESTIMATE * used
            found = waiting[near].tolist()
            out += [(u, v) for v in found]
            stack += found
            waiting = waiting[~near]
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of ``docs``."""
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    parts = shuffle_partitions(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id is {id_type}, not an integer")

    def sign(batches):
        for b in batches:
            keys, sketches = [], []
            for items in _text_items(b.column(2)):
                keys.append(order_minhash(items).view(np.int64).tolist() if len(items) else [])
                sketches.append(sketch(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "sketch", "keys"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("same"), F.col("text"))
    signed = work.write(source.mapInArrow(sign, "doc_id bigint, same binary, sketch binary, keys array<bigint>"), "signed")
    firsts = signed.where("doc_id is not null and size(keys) > 0").groupBy("same").agg(F.min(F.struct("doc_id", "sketch", "keys")).alias("f"))
    firsts = work.write(firsts.select("same", "f.doc_id", "f.sketch", "f.keys"), "firsts")
    filed = firsts.select(F.explode("keys").alias("key"), "doc_id").distinct()
    shared = filed.groupBy("key").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count("*").alias("_n")).where("_a < _b").select("key", "_n")
    tiles_of = "transform(sequence(0, _blocks - 1), j -> struct(least(_mine, j) as i, greatest(_mine, j) as j))"
    dealt = filed.join(shared, "key").withColumn("_blocks", F.expr(f"if(_n <= {HOT}, 1, int(ceil(_n / {HOT})))")).withColumn("_mine", F.expr("int(pmod(xxhash64(doc_id), _blocks))"))
    members = dealt.select(F.explode(F.expr(tiles_of)).alias("tile"), "key", "doc_id").select(F.xxhash64("key", "tile.i", "tile.j").alias("key"), "doc_id").join(firsts.select("doc_id", "sketch"), "doc_id")

    def buckets(batches):
        key, ids, rows = None, [], []

        def out():
            pairs = sketch_forest(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, BINS)) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in pairs], pa.int64()), pa.array([ids[b] for _, b in pairs], pa.int64())], ["u", "v"])

        for b in batches:
            for k, i, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if len(ids) > 1:
                        yield out()
                    key, ids, rows = k, [], []
                ids.append(i)
                rows.append(s)
        if len(ids) > 1:
            yield out()

    ordered = members.select("key", "doc_id", "sketch").repartition(parts, "key").sortWithinPartitions("key", "doc_id")
    groups = work.write(components(ordered.mapInArrow(buckets, "u bigint, v bigint"), work), "groups")

    sizes = groups.groupBy("label").agg(F.count("*").alias("_n"))
    blocks = (
        groups.join(sizes, "label")
        .withColumn("_blocks", F.expr(f"if(_n <= {TILE}, 1, int(ceil(_n / {TILE // 2})))"))
        .withColumn("_mine", F.expr("int(pmod(xxhash64(node), _blocks))"))
        .select("label", "node", F.explode(F.expr("transform(sequence(0, _blocks - 1), j -> struct(least(_mine, j) as i, greatest(_mine, j) as j))")).alias("tile"))
    )
    texts = source.select("doc_id", "text")
    tiles = blocks.join(texts, F.col("node") == F.col("doc_id")).select("label", "tile", "doc_id", "text")

    def verify(table):
        ids = table.column("doc_id").to_numpy()
        items = [x for c in table.column("text").chunks for x in _text_items(c)]
        order = np.argsort(ids, kind="stable")
        pairs = forest([items[k] for k in order], similarity)
        ids = ids[order]
        return pa.table({"u": pa.array([int(ids[a]) for a, _ in pairs], pa.int64()), "v": pa.array([int(ids[b]) for _, b in pairs], pa.int64())})

    links = tiles.groupBy("label", "tile").applyInArrow(verify, "u bigint, v bigint")
    classes = work.write(components(links, work), "classes")
    first_of = firsts.select("same", F.col("doc_id").alias("_first"))
    return (
        signed.select("doc_id", "same")
        .join(first_of, "same", "left")
        .join(classes.select(F.col("node").alias("_first"), "label"), "_first", "left")
        .select(F.col("doc_id").cast(id_type).alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "_first", "doc_id")).cast(id_type).alias("class_id"))
    )
