"""Batch-container operators over rows with a ``row_id``, and ordered set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeat(rows: DataFrame, n: int, interleave: bool = True) -> DataFrame:
    """Each row n times; row_id counts AABB or ABAB."""
    size = rows.agg(F.count("*").alias("_size"))
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_copy"))
    if interleave:
        return out.withColumn("row_id", F.col("row_id") * n + F.col("_copy")).drop("_copy")
    return out.join(F.broadcast(size)).withColumn("row_id", F.col("_copy") * F.col("_size") + F.col("row_id")).drop("_copy", "_size")


def repeat_by(rows: DataFrame, count: str) -> DataFrame:
    """Each row as often as its count; 0 drops it."""
    return rows.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("copy"))


def slice_rows(rows: DataFrame, start: int | None, stop: int | None, step: int = 1) -> DataFrame:
    """As a Python slice: negative ends count from the last row, a negative step
    goes backwards (``place`` is the order of the slice).  The row count is read if an end needs it."""
    if step == 0:
        raise ValueError("a step of 0")
    if step < 0 or any(x is not None and x < 0 for x in (start, stop)):
        size = rows.count()
        start, stop, step = slice(start, stop, step).indices(size)
    else:
        start = start or 0
    at = F.col("row_id")
    if step > 0:
        inside = (at >= start) & (at < stop) if stop is not None else at >= start
    else:
        inside = (at <= start) & (at > stop)
    return rows.where(inside & ((at - start) % step == 0)).withColumn("place", F.floor((at - start) / step).cast("bigint"))


def split_rows(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("part", F.floor(F.col("row_id") / size))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both by row_id; shared columns must agree."""
    both = [c for c in b.columns if c in a.columns and c != "row_id"]
    right = b.select("row_id", *[F.col(c).alias(f"_b_{c}") for c in both], *[c for c in b.columns if c not in a.columns])
    out = a.join(right, "row_id")
    for c in both:
        out = out.where(F.coalesce(F.assert_true(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(f"{c} differs")).isNull(), F.lit(True))).drop(f"_b_{c}")
    return out


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, by an explicit order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def chunk(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """``part`` of each of ``size`` rows in equal contiguous parts; a size that does not divide raises."""
    if size % parts:
        raise ValueError(f"{size} rows do not make {parts} equal parts")
    return rows.withColumn("part", F.floor(F.col("row_id") / (size // parts)))


def drop_remainder(rows: DataFrame, parts: int) -> DataFrame:
    """The leading rows that divide evenly."""
    size = rows.agg(F.count("*").alias("_size"))
    return rows.join(F.broadcast(size)).where(F.col("row_id") < F.col("_size") - F.col("_size") % parts).drop("_size")


def pad_to_multiple(rows: DataFrame, divisor: int) -> DataFrame:
    """Leading rows once more (and again, if there are few) until the count divides; ``is_pad`` marks them."""
    size = rows.agg(F.count("*").alias("_size"))
    whole = rows.join(F.broadcast(size)).withColumn("is_pad", F.lit(False))
    missing = (divisor - F.col("_size") % divisor) % divisor
    leading = whole.where((F.col("row_id") < missing) & (F.col("row_id") < divisor))
    copies = leading.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((missing - 1 - F.col("row_id")) / F.col("_size")))).alias("_copy"))
    pads = copies.withColumn("row_id", F.col("_size") + F.col("_copy") * F.col("_size") + F.col("row_id")).withColumn("is_pad", F.lit(True))
    return whole.drop("_size").unionByName(pads.drop("_size", "_copy"))


def fold(rows: DataFrame, group: int, columns: list[str]) -> DataFrame:
    """Each run of ``group`` rows as one, its columns as arrays in order; the count divides."""
    packed = F.array_sort(F.collect_list(F.struct("row_id", *columns)))
    out = rows.groupBy(F.floor(F.col("row_id") / group).alias("row_id")).agg(packed.alias("_r"))
    sized = out.where(F.assert_true(F.size("_r") == group, F.lit("rows do not divide")).isNull())
    return sized.select("row_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def unfold(rows: DataFrame, group: int, columns: list[str]) -> DataFrame:
    """The rows that ``fold`` packed."""
    parts = rows.select("row_id", F.posexplode(F.arrays_zip(*columns)).alias("_at", "_x"))
    return parts.select((F.col("row_id") * group + F.col("_at")).alias("row_id"), *[F.col(f"_x.{c}").alias(c) for c in columns])


def offset_limit(rows: DataFrame, keep: str, offset: int, limit: int, order: str = "row_id") -> DataFrame:
    """The offset counts all rows, the limit those that are kept (a top-n)."""
    return rows.where((F.col("row_id") >= offset) & F.expr(keep)).orderBy(order).limit(limit)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement in the order of a seeded hash of their key: repeatable at any partitioning."""
    share = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_share", share).orderBy("_share", key).limit(n).drop("_share")


def replay_sample(rows: DataFrame, key: str, task: str, positive: str, n: int, ratio: float, seed: int) -> DataFrame:
    """n rows of a pool: round(n * ratio) positive ones, the rest negative, tasks in turn; one side fills what the other lacks.

    Ranks are within (task, side), cut at n before the shuffle; the choice is a top-n by rank.
    """
    share = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    side = F.expr(positive)
    ranked = rows.withColumn("_side", side).withColumn("_share", share).withColumn("_rank", F.row_number().over(Window.partitionBy(task, "_side").orderBy("_share", key))).where(F.col("_rank") <= n)
    want = round(n * ratio)
    sizes = rows.agg(F.count_if(side).alias("_p"), F.count_if(~side).alias("_q")).select(
        F.least("_p", F.greatest(F.lit(want), F.lit(n) - F.col("_q"))).alias("_up"), F.least("_q", F.greatest(F.lit(n - want), F.lit(n) - F.col("_p"))).alias("_down")
    )
    sides = []
    for s, bound in ((True, "_up"), (False, "_down")):
        best = ranked.where(F.col("_side") == s).orderBy("_rank", task, "_share", key).limit(n)
        at = F.row_number().over(Window.orderBy("_rank", task, "_share", key))  # at most n rows
        sides.append(best.withColumn("_at", at).join(F.broadcast(sizes)).where(F.col("_at") <= F.col(bound)))
    return sides[0].unionByName(sides[1]).drop("_side", "_share", "_rank", "_at", "_up", "_down")


def select(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns and row_id; None: all."""
    return rows if columns is None else rows.select("row_id", *[c for c in columns if c != "row_id"])


def pop(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest), both with row_id; a column that is not there raises."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise KeyError(missing[0])
    return rows.select("row_id", *columns), rows.drop(*columns)


def rename(rows: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    return rows.withColumnsRenamed(dict(zip(old, new, strict=True)))


def select_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows at the places of ``ids`` (place, row_id): in that order, as often as they are named."""
    return ids.select("place", "row_id").join(rows, "row_id").drop("row_id").withColumnRenamed("place", "row_id")


def select_where(rows: DataFrame, mask: str) -> DataFrame:
    """The rows with a true mask column, numbered anew within blocks of 65,536 ids."""
    return renumbered(rows.where(F.coalesce(F.col(mask).cast("boolean"), F.lit(False))).drop(mask))


def renumbered(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """``order`` counted anew from 0; one row per block of 65,536 ids meets in one task."""
    block = rows.withColumn("_block", F.shiftright(order, 16))
    sizes = block.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1
    return block.withColumn("_at", at).join(before, "_block").withColumn("row_id", (F.col("_at") + F.col("_before")).cast("bigint")).drop("_block", "_at", "_before")


def concat(parts: list[DataFrame], sizes: list[int] | None = None) -> DataFrame:
    """All rows of the parts in order; the columns have to agree."""
    if len({tuple(sorted(p.columns)) for p in parts}) > 1:
        raise ValueError("parts with other columns")
    sizes = sizes or [p.count() for p in parts]
    out, before = None, 0
    for p, n in zip(parts, sizes, strict=True):
        moved = p.withColumn("row_id", F.col("row_id") + F.lit(before).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        before += n
    return out


def reorder(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Row ``row_id`` of ``order`` gets the number ``place``; the order has to be a permutation to keep all rows."""
    return select_ids(rows, order)


def restore(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Undoes ``reorder``: the inverse permutation."""
    return select_ids(rows, order.select(F.col("row_id").alias("place"), F.col("place").alias("row_id")))


def unpad(rows: DataFrame) -> DataFrame:
    """Without the rows that ``pad_to_multiple`` added."""
    return rows.where(~F.col("is_pad")).drop("is_pad")


def pad_with(rows: DataFrame, n: int, first: bool = False) -> DataFrame:
    """n copies of the last (or first) row at the end."""
    edge = F.min("row_id") if first else F.max("row_id")
    ends = rows.agg(edge.alias("_edge"), F.max("row_id").alias("_last"))
    copies = rows.join(F.broadcast(ends), F.col("row_id") == F.col("_edge")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_c") if n else F.lit(0).alias("_c"))
    copies = copies.where("_c > 0").withColumn("row_id", F.col("_last") + F.col("_c"))
    return rows.unionByName(copies.drop("_edge", "_last", "_c"))


def unfold_chunks(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """Each array of L values as ``parts`` rows of L / parts; other columns are repeated."""
    size = F.size(column)
    fits = F.when(size % parts == 0, F.floor(size / parts).cast("int")).otherwise(F.raise_error(F.lit("lengths do not divide")).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(column, i * F.col("_size") + 1, F.col("_size")))
    out = rows.withColumn("_size", fits).select(*[c for c in rows.columns if c != column], F.posexplode(chunks).alias("_at", column))
    return out.withColumn("row_id", F.col("row_id") * parts + F.col("_at")).drop("_at")


def mini_batches(rows: DataFrame, size: int, epochs: int, total: int, seed: int | None = None) -> DataFrame:
    """``epoch`` and ``batch`` of every row in every epoch, shuffled by a seeded hash or in order; the size has to divide."""
    if total % size:
        raise ValueError(f"{total} rows do not make batches of {size}")
    out = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    if seed is None:
        return out.withColumn("batch", F.floor(F.col("row_id") / size))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", F.col("row_id").cast("string")).cast("binary"))
    at = F.row_number().over(Window.partitionBy("epoch").orderBy("_key", "row_id")) - 1  # a training batch's rows
    return out.withColumn("_key", key).withColumn("batch", F.floor(at / size)).drop("_key")


def check_lengths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; arrays of other lengths in one row raise."""
    sizes = [F.size(c) for c in columns]
    same = F.lit(True)
    for x in sizes[1:]:
        same = same & x.eqNullSafe(sizes[0])
    return rows.where(F.coalesce(F.assert_true(same, F.lit("arrays of other lengths")).isNull(), F.lit(True)))


def intersect_ids(parts: list[DataFrame], key: str) -> DataFrame:
    """Ids that all parts hold."""
    out = parts[0].select(key).distinct()
    for p in parts[1:]:
        out = out.join(p.select(key), key, "left_semi")
    return out


def union_ids(parts: list[DataFrame], key: str) -> DataFrame:
    """Ids that any part holds, each once."""
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.union(p.select(key))
    return out.distinct()


def limit_then_keep(rows: DataFrame, keep: str, limit: int, start: int = 0, n: int | None = None) -> DataFrame:
    """The first ``limit`` rows, of them those to keep, of these n from the place ``start`` on (a top-n)."""
    head = rows.orderBy("row_id").limit(limit).where(F.expr(keep))
    return head.orderBy("row_id").offset(start).limit((1 << 31) - 1 - start if n is None else n)


def short_prompts(rows: DataFrame, text: str, most: int, tokenizer: str | None = None) -> DataFrame:
    """Rows whose text has at most ``most`` tokens: of a tokenizers file, or words; a null text is too long."""
    if tokenizer is None:
        n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
        return rows.where(F.col(text).isNotNull() & (n <= most))
    import pandas as pd

    loaded = {}

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if "t" not in loaded:
            loaded["t"] = Tokenizer.from_file(tokenizer)
        return pd.Series([len(x.ids) for x in loaded["t"].encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return rows.where(F.col(text).isNotNull() & (count(text) <= most))


def mixed(sources: dict[str, tuple[DataFrame, int | None]], key: str, seed: int) -> DataFrame:
    """A sample of each source (None: all of it), shuffled together: ``place`` from 0 in the order of a seeded hash."""
    out = None
    for name, (rows, n) in sources.items():
        part = (sample(rows, key, n, seed) if n is not None else rows).withColumn("source_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    share = F.md5(F.concat_ws(":", F.lit(str(seed)), "source_name", F.col(key).cast("string")).cast("binary"))
    return out.withColumn("shuffle_key", share)


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, each with a chance in proportion to its weight:
    (draw, the row's columns).  Draws are seeded hashes; running weights are kept
    per bucket of keys, whose totals (4,096 at most) meet in one task."""
    cut = F.pmod(F.xxhash64(key), F.lit(4096))
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    held = rows.withColumn("_b", cut).withColumn("_w", F.coalesce(w, F.lit(0.0))).where("_w > 0")
    sums = held.groupBy("_b").agg(F.sum("_w").alias("_s"))
    edges = sums.select("_b", "_s", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_from"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), unit.alias("_u"))
    # first the bucket (a range join with at most 4,096 rows), then the row within it
    in_bucket = draws.join(F.broadcast(edges), (F.col("_u") * F.col("_all") >= F.col("_from")) & (F.col("_u") * F.col("_all") < F.col("_from") + F.col("_s")))
    in_bucket = in_bucket.select("draw", "_b", (F.col("_u") * F.col("_all") - F.col("_from")).alias("_at"))
    run = Window.partitionBy("_b").orderBy(key)
    ranged = held.withColumn("_to", F.sum("_w").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = in_bucket.join(ranged.select("_b", key, "_to"), "_b").where(F.col("_at") < F.col("_to")).groupBy("draw").agg(F.min_by(key, "_to").alias(key))
    return hit.join(rows, key)


def resampling_weights(scores: str, method: str, power: float = 1.0) -> "F.Column":
    """``pow``: the size of the score to a power; ``max_min``: 1 for the largest and the least score, else 0;
    ``max_random``: 0.4 for the largest, 0.1 for the others."""
    top, low = F.max(scores).over(Window.partitionBy()), F.min(scores).over(Window.partitionBy())
    x = F.col(scores)
    if method == "pow":
        return F.pow(F.abs(x), F.lit(power))
    if method == "max_min":
        return F.when((x == top) | (x == low), 1.0).otherwise(0.0)
    if method == "max_random":
        return F.when(x == top, 0.4).otherwise(0.1)
    raise ValueError(f"unknown method: {method}")


def grown(rows: DataFrame, generate, keep: str) -> DataFrame:
    """The rows and what ``generate`` makes of them, as far as it is kept; new rows follow the old ones."""
    fresh = generate(rows).where(F.expr(keep))
    last = rows.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("_last"))
    return rows.unionByName(renumbered(fresh).join(F.broadcast(last)).withColumn("row_id", F.col("row_id") + F.col("_last") + 1).drop("_last"))
