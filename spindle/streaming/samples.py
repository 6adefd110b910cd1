"""Sample queues: bounded and dropping its oldest, assembled to batches, and resumable output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindle.operators.metrics import interpolated


def bounded_queue(actions: DataFrame, capacity: int) -> DataFrame:
    """A stream or table of (queue, at, action: put or get, sample) to one row an
    action, (queue, at, action, sample, ok, size, produced, consumed, dropped): a put
    into a full queue drops the oldest sample, is enqueued all the same and answers
    false; a get takes the oldest, or null.  State is one list of at most
    ``capacity`` samples a queue.  Within a batch actions are taken in the order of ``at``."""
    out = "queue string, at bigint, action string, sample string, ok boolean, size int, produced bigint, consumed bigint, dropped bigint"
    state_type = "held array<string>, produced bigint, consumed bigint, dropped bigint"

    def step(held: list, counts: list, pdf: pd.DataFrame) -> list[tuple]:
        done = []
        for r in pdf.sort_values("at", kind="stable").itertuples(index=False):
            ok, sample = True, r.sample
            if r.action == "put":
                if len(held) >= capacity:
                    held.pop(0)
                    counts[2] += 1
                    ok = False
                held.append(sample)
                counts[0] += 1
            else:
                sample = held.pop(0) if held else None
                ok = sample is not None
                counts[1] += ok
            done.append((r.queue, r.at, r.action, sample, ok, len(held), *counts))
        return done

    names = [c.split()[0] for c in out.split(", ")]
    if actions.isStreaming:

        def stateful(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held, *counts = state.get if state.exists else ([], 0, 0, 0)
            held, pdf = list(held), pd.concat(list(batches))
            done = step(held, counts, pdf)
            state.update((held, *counts))
            yield pd.DataFrame(done, columns=names)

        return actions.groupBy("queue").applyInPandasWithState(stateful, out, state_type, "append", GroupStateTimeout.NoTimeout)
    return actions.groupBy("queue").applyInPandas(lambda pdf: pd.DataFrame(step([], [0, 0, 0], pdf), columns=names), out)


def staleness(events: DataFrame, required: int, threshold: float, sync_every: int) -> DataFrame:
    """Samples outstanding after each event (at, kind: start, finish or sync,
    active, queued) and whether production pauses: starts are counted since the last
    sync, which sets the count to active plus queued; production pauses once the
    count or the queue reaches required * (threshold + 1) * sync_every."""
    most = int(required * (threshold + 1) * sync_every)
    run = F.count_if(F.col("kind") == "sync").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one run's events
    marked = events.withColumn("_run", run)
    w = Window.partitionBy("_run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.first(F.when(F.col("kind") == "sync", F.col("active") + F.col("queued")).otherwise(0)).over(w)
    out = marked.withColumn("outstanding", base + F.count_if(F.col("kind") == "start").over(w))
    return out.withColumn("paused", (F.col("outstanding") >= most) | (F.col("queued") >= most)).drop("_run")


def assembled(samples: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` samples in order of row_id with their version spans and times; a batch that is not full waits."""
    span = F.col("end_version") - F.col("start_version")
    per = samples.withColumn("_span", span).groupBy(F.floor(F.col("row_id") / size).alias("batch")).agg(
        F.count("*").alias("n"), F.count_if(F.col("_span") > 0).alias("partial"), F.max("_span").alias("widest"), F.avg("seconds").alias("mean_seconds"), *interpolated("seconds")
    )
    return per.where(F.col("n") == size)


def resumable(stream: DataFrame, key: str, path: str, checkpoint: str, late: str = "10 minutes", time: str = "ts"):
    """A started query that appends each key once as JSON lines; the checkpoint resumes it after a stop."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def with_config(stream: DataFrame, read_config: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A started query that joins every micro-batch with the configuration as it is then: changes count from the next batch on."""

    def each(batch: DataFrame, at: int) -> None:
        sink(batch.join(F.broadcast(read_config().limit(100_000)), key, "left"), at)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(calls: DataFrame, rate: float, burst: float) -> DataFrame:
    """When each call (key, at in seconds, cost) is let through by a token bucket
    of a rate and a burst: max over calls so far of arrival plus the time that the
    costs since then take.  A bucket is one key's running window."""
    behind = Window.partitionBy("key").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum("cost").over(behind)
    # the bucket at call j holds what is left of the burst; start_j = max(at_i + (spent_j - spent_(i-1) - burst) / rate, at_j)
    lead = F.max(F.col("at") - (F.col("_spent") - F.col("cost")) / rate).over(behind)
    marked = calls.withColumn("_spent", spent)
    return marked.withColumn("starts", F.greatest(F.col("at"), lead + (F.col("_spent") - burst) / rate)).drop("_spent")
