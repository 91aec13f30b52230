"""Trees of files, rosters, chunk stores and metrics as DataFrames, and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.operators import chunks as C

ROSTER = "node string, addr string, fingerprint string, epoch long, kind string, sig string"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, content_hash, content) of the files below root, staging files left out. Columns not asked for are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = S.relative(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("/" + root.split(":", 1)[-1].strip("/")))
    return found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash"), "content").filter(~P.is_staging(F.col("path")))


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_roster(spark: SparkSession, path: str, verify: Callable[[DataFrame], Column]) -> tuple[DataFrame, int]:
    """Entries that verify accepts, and how many were dropped; a missing file is an empty roster."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], ROSTER), 0
    entries = spark.read.schema(ROSTER).json(path)
    good = entries.filter(verify(entries))
    return good, entries.count() - good.count()


def write_roster(entries: DataFrame, path: str) -> None:
    """Write beside the target, then put it in its place: readers see the old or the new roster."""
    spark = entries.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    entries.coalesce(1).write.json(staging)
    new, fs = _path(spark, staging)
    old, _ = _path(spark, path)
    fs.delete(old, True)
    fs.rename(new, old)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Add verified chunks that the store lacks, in folders by the first two digits of the hash."""
    spark = chunks.sparkSession
    at, fs = _path(spark, path)
    new = C.store(read_chunks(spark, path), chunks) if fs.exists(at) else C.store(chunks.limit(0), chunks)
    new.select("hash", "len", "body").withColumn("ab", F.substring("hash", 1, 2)).write.mode("append").partitionBy("ab").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("ab")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound chunks, and those whose bytes do not match their hash."""
    judged = C.verify_store(read_chunks(spark, path))
    return judged.filter("NOT corrupt").drop("corrupt"), judged.filter("corrupt").drop("corrupt")


def evict_corrupt(spark: SparkSession, path: str) -> int:
    """Remove chunks whose bytes do not match their hash, and say how many there were.

    Only folders that hold one are written anew, beside their old place first.
    """
    _, corrupt = read_store(spark, path)
    folders = [r["ab"] for r in corrupt.select(F.substring("hash", 1, 2).alias("ab")).distinct().collect()]
    gone = corrupt.count()
    for ab in folders:  # at most 256 of them
        staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
        kept = spark.read.parquet(f"{path}/ab={ab}")
        C.verify_store(kept).filter("NOT corrupt").drop("corrupt").write.parquet(staging)
        new, fs = _path(spark, staging)
        old, _ = _path(spark, f"{path}/ab={ab}")
        fs.delete(old, True)
        fs.rename(new, old)
    return gone


def key_values(spark: SparkSession, path: str) -> DataFrame:
    at, fs = _path(spark, path)
    return spark.read.schema("key string, value string").parquet(path) if fs.exists(at) else spark.createDataFrame([], "key string, value string")


def set_key_value(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Upsert in a small table: its rows are read before the folder is replaced."""
    kept = [tuple(r) for r in key_values(spark, path).filter(F.col("key") != key).collect()]
    spark.createDataFrame([*kept, (key, value)], "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)
