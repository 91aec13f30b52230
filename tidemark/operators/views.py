"""What operators look at: status, configuration differences, conflicts, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import predicates as P

VERSION = "0.2"
# Settings that take effect without a restart.
HOT = ("log_level", "ingress_rate", "egress_rate", "schedule", "free_space_guard")


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings (name, value) that differ, with what each needs to take effect."""
    met = a.select("name", F.col("value").alias("old")).join(b.select("name", F.col("value").alias("new")), "name", "full")
    return met.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("needs", F.when(F.col("name").isin(*HOT), "reload").otherwise("restart"))


def status(index: DataFrame, log: DataFrame) -> DataFrame:
    """One row: live files, deleted ones, copies, bytes and operations."""
    files = index.agg(F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("deleted"), F.count_if(P.is_copy(F.col("path")) & ~F.col("tombstone")).alias("copies"), F.sum(F.when(~F.col("tombstone"), F.col("size"))).alias("bytes"))
    return files.crossJoin(log.agg(F.count(F.lit(1)).alias("ops")))


def conflicts(index: DataFrame) -> DataFrame:
    return index.filter(P.is_copy(F.col("path")) & ~F.col("tombstone"))


def path_for_hash(index: DataFrame) -> DataFrame:
    """For each content a live path that has it: the first by name."""
    return index.filter("NOT tombstone AND content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("path").alias("path"))


def quarantine_split(results: DataFrame) -> DataFrame:
    """Results with their route: ok, retry, or quarantine, where they are kept and never retried."""
    return results.withColumn("route", P.error_class(F.col("error")))


def counters(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("apply", "ignore", "concurrent")))


def transfers(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Progress of each file that is being fetched: chunks and bytes wanted and still missing. wanted: (file, hash, len)."""
    held = have.select("hash").distinct().withColumn("here", F.lit(True))
    met = wanted.join(held, "hash", "left").withColumn("gone", F.col("here").isNull())
    return met.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("gone").alias("missing"), F.sum("len").alias("bytes"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("len"))), F.lit(0)).alias("missing_bytes"))


def version(spark: SparkSession) -> DataFrame:
    """Versions of this library and of Spark. One row."""
    return spark.createDataFrame([(VERSION, spark.version)], "library string, spark string")


def health(figures: DataFrame) -> DataFrame:
    """One JSON object for each node of (node, name, value), names in order."""
    listed = F.array_sort(F.collect_list(F.struct("name", "value")))
    return figures.groupBy("node").agg(F.to_json(F.map_from_entries(listed)).alias("health"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """Text exposition lines of (name, value)."""
    return metrics.select(F.concat(F.lit("tidemark_"), F.col("name"), F.lit(" "), F.col("value").cast("string")).alias("line"))
