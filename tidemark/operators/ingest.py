"""From observations to operations: scans, event normalisation, debounce, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.functions import scalars as S


def scan_diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """A write for every replicable file on disk (all count as regular where disk has no kind), a deletion for every live row that is not there."""
    replicable = P.is_replicable(F.col("kind")) if "kind" in disk.columns else F.lit(True)
    seen = disk.filter(~P.is_staging(F.col("path")) & replicable)
    writes = seen.select("path", F.lit("write").alias("kind"), "content_hash")
    gone = index.filter("NOT tombstone").join(seen.select("path"), "path", "left_anti")
    return writes.unionByName(gone.select("path", F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("content_hash")))


def normalize_events(feed: DataFrame, root: str) -> DataFrame:
    """Feed events (kind, old, new; full paths) as local events: renames across the share's edge become deletions or writes."""
    old, new = S.relative(F.col("old"), F.lit(root)), S.relative(F.col("new"), F.lit(root))
    named = feed.withColumn("old_rel", old).withColumn("new_rel", new)
    inside_old, inside_new = F.col("old_rel").isNotNull(), F.col("new_rel").isNotNull()
    is_rename = F.col("kind") == "rename"
    kind = F.when(is_rename & inside_old & inside_new, "rename").when(is_rename & inside_old, "delete").when(is_rename, "write").otherwise(F.col("kind"))
    path = F.when(is_rename & inside_old & ~inside_new, F.col("old_rel")).otherwise(F.col("new_rel"))
    out = named.withColumns({"path": path, "path_old": F.when(is_rename & inside_old & inside_new, F.col("old_rel")), "kind": kind})
    return out.filter(F.col("path").isNotNull() & ~P.is_staging(F.col("path"))).drop("old", "new", "old_rel", "new_rel")


def debounce(events: DataFrame, quiet: int, until: int) -> DataFrame:
    """Writes after which a path was quiet for `quiet` (units of t) before anything else came, or before `until`."""
    after = F.lead("t").over(Window.partitionBy("path").orderBy("t", "event_id"))
    timed = events.withColumn("next_t", after)
    ripe = F.coalesce(F.col("next_t"), F.lit(until)) - F.col("t") >= quiet
    return timed.filter((F.col("kind") == "write") & ripe).drop("next_t")


def recheck_deletes(events: DataFrame, disk: DataFrame) -> DataFrame:
    """Without deletions of paths that exist by now."""
    present = disk.select("path").distinct().withColumn("present", F.lit(True))
    return events.join(present, "path", "left").filter(~((F.col("kind") == "delete") & F.coalesce("present", F.lit(False)))).drop("present")


def within_limits(events: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected events by size and safety of the path."""
    good = P.within_cap(F.col("size"), cap) & P.is_safe_path(F.col("path"))
    return events.filter(good), events.filter(~good)


def suppress(events: DataFrame, registered: DataFrame, ttl: int) -> DataFrame:
    """Events that no registration accounts for.

    A path holds one registration (path, kind, content_hash, at), and a newer one takes its place. An event of the same kind, less
    than ttl after it, is swallowed and uses it up: a write has the same hash, a deletion any. Other events pass and
    leave it. So an event is swallowed if it is the first to match the path's latest registration: windows over a path's history,
    no fold. At one time registrations come before events.
    """
    marks = registered.select("path", "kind", "content_hash", F.col("at").alias("t"), F.lit(0).alias("is_event"), F.lit(None).cast("long").alias("event_id"))
    seen = events.select("path", "kind", "content_hash", "t", F.lit(1).alias("is_event"), "event_id")
    ordered = Window.partitionBy("path").orderBy("t", "is_event", "kind", F.coalesce("content_hash", F.lit("")), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    is_mark = F.col("is_event") == 0
    mark = F.last(F.when(is_mark, F.struct("kind", "content_hash", "t")), ignorenulls=True).over(ordered)
    told = marks.unionByName(seen).withColumn("mark", mark).withColumn("ordinal", F.sum(is_mark.cast("long")).over(ordered))
    alike = (F.col("kind") == F.col("mark.kind")) & ((F.col("kind") == "delete") | F.col("content_hash").eqNullSafe(F.col("mark.content_hash")))
    matching = told.filter((F.col("is_event") == 1) & alike & (F.col("t") - F.col("mark.t") < ttl))
    used = matching.groupBy("path", "ordinal").agg(F.min(F.struct("t", "event_id")).alias("first")).select(F.col("first.event_id").alias("event_id"))
    return events.join(used, "event_id", "left_anti")
