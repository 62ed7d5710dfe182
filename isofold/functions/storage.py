"""Tables in the folder that the cluster shares: how loops cut their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and Spark is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_isofold_core_dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = spark.sparkContext._isofold_core_dir = "file://" + tempfile.mkdtemp(prefix="isofold-")
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; what is there at exit is deleted."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN.append((spark, path))
    return path


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read back: a loop's next round starts from files, whatever executors are lost."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    for t in tables:
        if path := getattr(t, "_settled_at", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _OWN:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return
