"""Streaming queries: each runs over all that is there and ends; the result is read back from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import vv as V
from tidemark.operators import oplog as L
from tidemark.operators import resolve as R
from tidemark.plans import fixtures as X
from tidemark.plans import registry as Q
from tidemark.sources.shared import release, settle, shared_dir
from tidemark.streaming import pipelines as S


def folder(spark: SparkSession) -> str:
    """A new folder below the one that executors share."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}"


def _logged(spark: SparkSession, sf: str, parts: int = 3, log: DataFrame | None = None) -> tuple[str, StructType, int]:
    """The op log as files, with every fifth operation delivered twice and in any order; its place and schema, and the files of a batch.

    There are `parts` batches at any size; a batch has as many files as its rows ask for, each written by one task.
    """
    at = folder(spark)
    log = X.ops(spark, sf) if log is None else log
    files = -(-max(parts, X.portions(spark, sf)) // parts)
    times = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    log.withColumn("_time", F.explode(times)).drop("_time").repartition(parts * files, "event_id").write.parquet(f"{at}/log")
    return at, log.schema, files


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    at, schema, files = _logged(spark, sf)
    ops = S.dedup(S.read_ops(spark, f"{at}/log", schema, files))
    ops.select("op_id", "path").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("op_id string, path string").parquet(f"{at}/out")


def stream_current_state(spark: SparkSession, sf: str) -> DataFrame:
    at, schema, files = _logged(spark, sf)
    S.materialize(S.read_ops(spark, f"{at}/log", schema, files), f"{at}/state", f"{at}/cp").awaitTermination()
    return S.materialized(spark, f"{at}/state").select("path", "tombstone", "content_hash", V.text(F.col("vv")).alias("vv"))


def bootstrap_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot up to a frontier, then the live stream beyond it, give the state of all operations."""
    at, schema, files = _logged(spark, sf)
    early = X.ops(spark, sf).filter("origin_seq <= 500")
    S.fold_batch(early, -1, f"{at}/state")
    live = S.after_frontier(S.read_ops(spark, f"{at}/log", schema, files), L.frontier(early))
    S.materialize(live, f"{at}/state", f"{at}/cp").awaitTermination()
    return S.materialized(spark, f"{at}/state").select("path", "tombstone", "content_hash", V.text(F.col("vv")).alias("vv"))


def stream_renames(spark: SparkSession, sf: str) -> DataFrame:
    """Renames through the stream: a write at the new path and a deletion at the old one, in whatever batch they come."""
    at, schema, files = _logged(spark, sf, 5, X.renames(spark, sf))
    S.materialize(S.read_ops(spark, f"{at}/log", schema, files), f"{at}/state", f"{at}/cp").awaitTermination()
    return S.materialized(spark, f"{at}/state").select("path", "tombstone", "content_hash", V.text(F.col("vv")).alias("vv"))


def _in_turn(spark: SparkSession, rows: DataFrame, at: str, run, slices: int = 3) -> None:
    """Rows (with t) as files in order of time, one slice after the other; run starts a query over what is there by then."""
    rows = settle(rows, "rows")
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    for i in range(slices):
        own = F.least(F.floor((F.col("t") - low) * slices / (high - low + 1)), F.lit(slices - 1)) == i
        rows.filter(own).write.mode("append").parquet(f"{at}/in")
        run(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    release(rows)


def stream_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Suppression over three runs that go on from each other's state."""
    at = folder(spark)
    events, marks = Q.suppressible(spark, sf)
    both = events.withColumn("is_event", F.lit(True)).unionByName(marks.withColumnRenamed("at", "t").withColumn("is_event", F.lit(False)), allowMissingColumns=True)

    def run(rows: DataFrame) -> None:
        S.suppress(rows, Q.TTL, at, f"{at}/cp").awaitTermination()

    _in_turn(spark, both, at, run)
    return spark.read.schema("event_id long").parquet(f"{at}/out").select("event_id")


def stream_appends(spark: SparkSession, sf: str) -> DataFrame:
    """Local changes over three runs; numbers, vectors and identities go on."""
    at = folder(spark)
    _in_turn(spark, Q.local_changes(spark, sf), at, lambda rows: S.append_changes(rows, at, f"{at}/cp", X.hour()).awaitTermination())
    return spark.read.parquet(f"{at}/log").select("event_id", "path", "op_type", "origin_seq", V.text(F.col("vv")).alias("vv"), "uuid")


def stream_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests in two batches, of which the first came a second time and a third of it again in the second."""
    at = folder(spark)
    rows = X.chunks(spark, sf)
    for number, part in ((0, "file % 2 = 0"), (0, "file % 2 = 0"), (1, "file % 3 = 0 OR file % 2 = 1")):
        S.put_manifests(rows.filter(part), at, number)
    return S.manifests(spark, at).select("file", "chunk_count", F.array_join(F.transform("chunks", lambda c: c["hash"]), ",").alias("hashes"))


def stream_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A change feed that overflowed once, so what it may have lost comes from a rescan."""
    at = folder(spark)
    X.events(spark, sf).createOrReplaceTempView("tidemark_events")
    feed = spark.sql(Q._FEED.replace("FROM events", "FROM tidemark_events")).unionByName(spark.createDataFrame([(-1, "overflow", None, None)], "event_id long, kind string, old string, new string"))
    feed.write.parquet(f"{at}/in")
    disk, index = settle(X.disk(spark, sf), "disk"), settle(R.current_state(X.ops(spark, sf)), "index")
    S.ingest_feed(spark.readStream.schema(feed.schema).parquet(f"{at}/in"), "/share", disk, index, f"{at}/out", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("path", "path_old", "kind")


def rescans(spark: SparkSession, sf: str) -> DataFrame:
    """A notice, and the scan that follows."""
    at = folder(spark)
    spark.range(1).write.parquet(f"{at}/in")
    notices = spark.readStream.schema("id long").parquet(f"{at}/in")
    S.rescan(notices, lambda: X.disk(spark, sf), lambda: R.current_state(X.ops(spark, sf)), f"{at}/out", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("path", "kind", "content_hash")


def gossip_rosters(spark: SparkSession, sf: str) -> DataFrame:
    """Rosters of two nodes, each in a batch of its own."""
    at = folder(spark)
    entries = X.roster(spark, sf)
    for part in ("epoch > 2", "epoch <= 3"):
        entries.filter(part).write.mode("append").parquet(f"{at}/in")
        S.gossip(spark.readStream.schema(entries.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/cp").awaitTermination()
    return S.gossiped(spark, f"{at}/out")


def stream_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Operations through a stream, and the holes among them."""
    at, schema, files = _logged(spark, sf)
    S.lost_so_far(S.read_ops(spark, f"{at}/log", schema, files).filter("event_id % 11 <> 0"), f"{at}/seen", f"{at}/cp").awaitTermination()
    return S.sequence_gaps(spark.read.parquet(f"{at}/seen").distinct())


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Results that go on and those that are kept aside, from one stream each."""
    results = X.events(spark, sf).select("event_id", F.when(F.col("event_type") == "error", "too_large").when(F.col("event_type") == "click", "none").otherwise(F.col("event_type")).alias("error"))
    on, dead = S.split_quarantine(results)
    return on.select("event_id", "route").unionByName(dead.select("event_id", "route"))


def quiet_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Debounce by session windows, over a bounded table."""
    e = X.events(spark, sf).select(F.concat(F.lit("u/"), "user_id").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("kind"), F.timestamp_micros("t").alias("ts"), "event_id")
    return S.quiet_writes(e, "1 hour").select("path", "event_id")


def stream_quiet(spark: SparkSession, sf: str) -> DataFrame:
    """Debounce as a stream: a tick long after the last event lets the watermark close every burst."""
    at = folder(spark)
    e = X.events(spark, sf).select(F.concat(F.lit("u/"), "user_id").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("kind"), F.timestamp_micros("t").alias("ts"), "event_id")
    tick = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(F.lit("").alias("path"), F.lit("tick").alias("kind"), "ts", F.lit(-1).cast("long").alias("event_id"))
    e.unionByName(tick).write.parquet(f"{at}/in")
    quiet = S.quiet_writes(spark.readStream.schema(e.schema).parquet(f"{at}/in"), "1 hour")
    quiet.select("path", "event_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, event_id long").parquet(f"{at}/out")


def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.sequence_gaps(X.ops(spark, sf).filter("event_id % 11 <> 0"))


def op_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select(F.timestamp_micros("t").alias("ts"), F.col("event_type").alias("origin"))
    return S.op_rate(e, "1 hour").select("origin", F.unix_seconds("begin").alias("begin"), "n")


_STATE = f"{X.OPS}, {X.winners('w')} SELECT path, tombstone, content_hash, {X.VV_TEXT} AS vv FROM w"
SQL = {
    "stream_dedup": f"{X.OPS} SELECT op_id, path FROM ops",
    "stream_current_state": _STATE,
    "bootstrap_handoff": _STATE,
    "stream_renames": Q.SQL["renamed_state"],
    "stream_suppression": Q.SUPPRESSED,
    "stream_appends": Q.LOCAL_APPENDS,
    "stream_manifests": f"{X.CHUNKS} SELECT file, count(*) AS chunk_count, string_agg(hash, ',' ORDER BY idx) AS hashes FROM hashed GROUP BY file",
    "stream_feed": f"{Q.SQL['scan_diff'].split(' SELECT path, ' + chr(39) + 'write')[0]}, f AS ({Q._FEED}), {Q.SQL['feed_normalization'].split('), ', 1)[1].rsplit(' SELECT event_id, kind', 1)[0]}, events_ AS (SELECT event_id, kind, path, path_old{Q.SQL['feed_normalization'].rsplit('SELECT event_id, kind, path, path_old', 1)[1]}) "
    "SELECT path, path_old, kind FROM events_ UNION ALL SELECT path, NULL, 'write' FROM disk UNION ALL SELECT path, NULL, 'delete' FROM w WHERE NOT tombstone AND path NOT IN (SELECT path FROM disk)",
    "rescans": Q.SQL["scan_diff"],
    "gossip_rosters": f"{X.ROSTER} SELECT node, addr, fingerprint, epoch, kind, content_hash FROM won",
    "dead_letters": "SELECT event_id, CASE event_type WHEN 'error' THEN 'quarantine' WHEN 'click' THEN 'ok' ELSE 'retry' END AS route FROM events",
    "quiet_writes": "WITH e AS (SELECT event_id, 'u/' || user_id AS path, event_type, epoch_us(ts) AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, event_id) AS nxt FROM e) SELECT path, event_id FROM n WHERE event_type <> 'error' AND (nxt IS NULL OR nxt - t > 3600000000)",
    "stream_quiet": "WITH e AS (SELECT event_id, 'u/' || user_id AS path, event_type, epoch_us(ts) AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, event_id) AS nxt FROM e) SELECT path, event_id FROM n WHERE event_type <> 'error' AND (nxt IS NULL OR nxt - t > 3600000000)",
    "sequence_gaps": f'{X.OPS}, g AS (SELECT origin, origin_seq, coalesce(lag(origin_seq) OVER (PARTITION BY origin ORDER BY origin_seq), 0) AS b FROM ops WHERE event_id % 11 <> 0) SELECT origin, b + 1 AS "from", origin_seq - 1 AS "to" FROM g WHERE origin_seq > b + 1',
    "stream_gaps": f'{X.OPS}, g AS (SELECT origin, origin_seq, coalesce(lag(origin_seq) OVER (PARTITION BY origin ORDER BY origin_seq), 0) AS b FROM ops WHERE event_id % 11 <> 0) SELECT origin, b + 1 AS "from", origin_seq - 1 AS "to" FROM g WHERE origin_seq > b + 1',
    "op_rate": "SELECT event_type AS origin, epoch_us(ts) // 3600000000 * 3600 AS begin, count(*) AS n FROM events GROUP BY ALL",
}


def queries():
    return {f.__name__: f for f in (stream_dedup, stream_current_state, stream_renames, bootstrap_handoff, stream_suppression, stream_appends, stream_manifests, stream_feed, rescans, gossip_rosters, stream_gaps, dead_letters, quiet_writes, stream_quiet, sequence_gaps, op_rate)}


def oracle_sql() -> dict[str, str]:
    return SQL
