"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; one of our own only where it is unset."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and a lost executor loses nothing.

    The files live as long as the driver: later lazily evaluated plans still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}-{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def read_shared(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """Parquet at path, read by at least so many tasks where its row groups allow it.

    Spark's own splits follow the cores and go up to spark.sql.files.maxPartitionBytes, and a shuffle to more than 200 tasks sorts a reader's whole
    share. The number belongs to a session, and the caller's is left alone: only this scan is of another, with the caller's settings. The
    union with no rows, which the optimiser drops, makes it a table of the caller's session.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    least = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.files.minPartitionNum", str(max(tasks, least)))
    return spark.read.parquet(path).filter("false").unionByName(own.read.parquet(path))


def release(*tables: DataFrame) -> None:
    """Remove settled tables that no plan reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.settled_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; a folder that stays is no loss
        pass
