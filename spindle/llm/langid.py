"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and the
n-grams (n = 1 to 3 code points) are hashed into a fixed number of buckets.
The log-probability matrix (languages x buckets, a fixed size per language) is
broadcast; workers score whole texts in numpy, a chunk of rows at a time.

Fit: counts of a bounded sample of labelled training rows (``MAX_FIT_ROWS``,
taken by a hash of doc_id), summed by Spark before the matrix comes to the
driver.

Defined results: null text, and text without a letter: ``und`` with score 0.
No usable training row: ``und`` with score 0 for every text.  A null label is
never learned from.  Repeated rows are scored alike; ties go to the language
that is first in code point order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIT_ROWS = 20_000
BUCKETS = 1 << 16
MAX_LANGUAGES = 500
_LETTER = regex.compile(r"\p{L}")
_RUNS = regex.compile(r"[^\p{L}]+")
_ASCII_GAP = np.array([not chr(i).isalpha() for i in range(128)])


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each between spaces, and offsets."""
    parts = []
    for t in texts:
        t = t.lower()
        if t.isascii():
            parts.append(f"  {t} ")
        else:
            parts.append(f"  {_RUNS.sub(' ', t)} ")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    gap = np.zeros(len(cp), bool)
    low = cp < 128
    gap[low] = _ASCII_GAP[cp[low]]
    cp[gap] = 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    ends = np.cumsum(sizes)
    keep[ends - sizes] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return cp[keep], np.concatenate([[0], kept[ends]])


def _buckets(cp: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place; BUCKETS (of no weight) where a text ends first or it is a lone space."""
    m = len(cp) - n + 1
    h = np.full(len(cp), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h[:m] = (h[:m] ^ cp[k : k + m]) * np.uint32(0x85EBCA6B)
        h[:m] ^= h[:m] >> np.uint32(13)
    out = (h * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype(np.int32)
    if n == 1:
        out[cp == 32] = BUCKETS
    for k in range(1, n):
        at = offs[1:] - k
        out[at[at >= offs[:-1]]] = BUCKETS
    return out


def _batches(column: pa.Array, most: int = 1 << 19):
    """(index of each text, texts) with a letter, a bounded number of characters at a time."""
    at, held, size = [], [], 0
    for i, x in enumerate(column):
        t = x.as_py()
        if t is None or not _LETTER.search(t):
            continue
        at.append(i)
        held.append(t)
        size += len(t)
        if size >= most:
            yield at, held
            at, held, size = [], [], 0
    if held:
        yield at, held


def fit(docs: DataFrame, label: str = "lang", max_fit_rows: int = MAX_FIT_ROWS) -> dict:
    """Learn from the rows of ``docs`` with a text and a label."""
    docs = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).alias("_lang"))
    n = docs.count()
    if n > max_fit_rows:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * 0.95 * max_fit_rows / n))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, texts in _batches(b.column(0)):
                cp, offs = _code_points(texts)
                row = np.repeat(np.arange(len(texts)), np.diff(offs))
                names = sorted({langs[i] for i in at})
                which = np.array([names.index(langs[i]) for i in at])[row]
                for k in (1, 2, 3):
                    both = np.bincount(which * (BUCKETS + 1) + _buckets(cp, offs, k), minlength=len(names) * (BUCKETS + 1))
                    for i, x in enumerate(both.reshape(len(names), -1)):
                        total[names[i]] = total.get(names[i], 0) + x
        for name, x in total.items():
            at = np.flatnonzero(x[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], ["lang", "bucket", "n"])

    found = docs.select("text", "_lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in docs.select("_lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix has no size bound")
    counts = np.zeros((len(names), BUCKETS))
    table = found.toArrow()
    if table.num_rows:
        which = np.array([names.index(x) for x in table.column(0).dictionary_encode().combine_chunks().dictionary.to_pylist()])
        lang = which[table.column(0).dictionary_encode().combine_chunks().indices.to_numpy()]
        counts[lang, table.column(1).to_numpy()] = table.column(2).to_numpy()
    rows = {r[0]: r[1] for r in docs.groupBy("_lang").count().collect()}
    prior = np.log(np.array([rows[x] for x in names], float) / max(1, sum(rows.values()))) if names else np.zeros(0)
    logp = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)) if names else counts
    return {"names": names, "prior": prior, "logp": np.concatenate([logp, np.zeros((len(names), 1))], axis=1).astype(np.float32)}


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id), lang_pred and score of each row."""
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches):
        m = shared.value
        names = np.array([*m["names"], "und"], dtype=object)
        for b in batches:
            pred, sure = np.full(b.num_rows, len(m["names"])), np.zeros(b.num_rows)
            for at, texts in _batches(b.column(b.num_columns - 1)) if m["names"] else ():
                cp, offs = _code_points(texts)
                total = np.zeros((len(m["names"]), len(texts)))
                for n in (1, 2, 3):
                    h = _buckets(cp, offs, n)
                    for k, row in enumerate(m["logp"]):
                        total[k] += np.add.reduceat(row[h], offs[:-1], dtype=np.float64)
                total += m["prior"][:, None]
                best = total.argmax(axis=0)
                pred[at], sure[at] = best, 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names[pred], pa.string()), pa.array(sure)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(score, schema)


def remainder(doc_id: str | Column = "doc_id", by: int = 4) -> Column:
    """crc32 of doc_id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % by
