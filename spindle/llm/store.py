"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it back, never by a local
checkpoint: the files outlive the executor that wrote them.  The folder is the
one named in ``spark.checkpoint.dir``; only a local session without one (tests)
gets a folder of its own, a cluster without one is refused.
"""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources.scratch import hold, shared_dir


class Workspace:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = hold(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._spindle_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete(self.spark, df._spindle_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_labels(spark: SparkSession, n: int, each: int = 1) -> list[int]:
    """n * each integers that Spark's hash partitioning deals to n partitions
    ``each`` apiece, so that buckets grouped by their labels load all tasks alike."""
    wide = n * each * 40
    rows = spark.range(wide, numPartitions=1).selectExpr("int(id) as i", f"pmod(hash(int(id)), {n}) as p").groupBy("p").agg(F.slice(F.sort_array(F.collect_list("i")), 1, each).alias("i")).collect()
    used = [i for r in rows for i in r["i"]]
    taken = set(used)
    spare = (i for i in range(wide, 2 * wide) if i not in taken)
    return sorted(used) + [next(spare) for _ in range(n * each - len(used))]


def release(spark: SparkSession) -> None:
    """Let the driver clean the shuffle files of finished jobs now, not when it
    happens to collect its garbage, so that passes do not pile up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
