"""Tables written to the folder that the driver and all executors share.

Lineage is cut by writing a table and reading it back: the files outlive the
executor that wrote them.  The folder is the one named in
``spark.checkpoint.dir``; a local session without one (tests) gets a folder of
its own, a cluster without one is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_held: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spindle-"))


def hold(path: str) -> str:
    """A folder of this session: it is deleted when the driver ends, as lazy results read it until then."""
    if not _held:
        atexit.register(_discard)
    _held.append(path)
    return path


def _discard() -> None:
    context = SparkContext._active_spark_context
    while _held:
        path = _held.pop()
        try:
            if context is not None:
                p = context._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
            elif path.startswith(("file:/", "/")):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        except Exception:  # noqa: BLE001 - the session may be gone: nothing is left to do
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to a new folder and read back."""
    spark = df.sparkSession
    path = hold(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
