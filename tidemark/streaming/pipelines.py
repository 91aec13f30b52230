"""Streams of operations: dedup, materialisation, debounce, suppression, quarantine, and the hand-over from a snapshot.

Operations are never dropped for being late: causality decides, not time. So nothing here puts a watermark on the op stream;
only debounce, which is about time, does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import predicates as P
from tidemark.operators import chunks as C
from tidemark.operators import ingest as I
from tidemark.operators import oplog as L
from tidemark.operators import resolve as R
from tidemark.operators import roster as N
from tidemark.sources.shared import release, settle

INDEX = "path string, tombstone boolean, content_hash string, meta_hash string, naming_hash string, mode int, size long, uuid string, vv map<string,bigint>"


def read_ops(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Operations from files that appear at path; the reader's offsets are the resumable cursor, the rate is admission control."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedup(ops: DataFrame) -> DataFrame:
    """Each op_id once, without a horizon: the set of applied operations is never trimmed."""
    return ops.dropDuplicates(["op_id"])


def _done(spark: SparkSession, path: str, name: str) -> dict[int, object]:
    """Complete folders <name>=<number> below path, by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    return {int(p.getName()[len(name) + 1 :]): p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _chain(number: int) -> list[int]:
    """The levels that hold all batches up to this one: n covers the last n & -n of them."""
    out = []
    while number > 0:
        out.append(number)
        number -= number & -number
    return out


def fold_batch(batch: DataFrame, number: int, path: str) -> None:
    """Add a batch's candidates, the latest of each origin per path, to the levels of the state below `path`.

    Level n (batch number + 2; a snapshot is number -1) merges the batch with the levels of the batches before that it covers, as
    a binary counter does. So a candidate is written anew log n times in n batches, a state is read from log n levels, and nothing
    rewrites all of it each time. A level is written before the batch is committed, and a batch that runs again writes the same
    level anew, so every operation counts once. Levels that neither this state nor the one before needs are removed.
    """
    _add_level(R.candidates(batch), number + 2, path, R.latest_per_origin)


def _add_level(new: DataFrame, level: int, path: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Write a level: merge takes the new rows and those of the levels that it covers."""
    spark = new.sparkSession
    held = _done(spark, path, "level")
    for n in _chain(level - 1):
        if n > level - (level & -level) and n in held:
            new = new.unionByName(spark.read.schema(new.schema).parquet(f"{path}/level={n}"))
    merge(new).write.mode("overwrite").parquet(f"{path}/level={level}")
    needed = {level, *_chain(level), *_chain(level - 1)}
    for n, at in held.items():
        if n not in needed and n < level:
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the candidates of every path up to date in the folder `path`; state commits precede the source's offsets."""
    return ops.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialized(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Current rows after the last complete batch, or after the last one before a batch number."""
    held = [n for n in _done(spark, path, "level") if before is None or n < before + 2]
    return R.winners(spark.read.parquet(*(f"{path}/level={n}" for n in _chain(max(held)) if n in held)))


def append_batch(changes: DataFrame, number: int, path: str, block: Column) -> None:
    """A batch of local changes as operations: to the log in path/log/batch=<number>, and into the state in path/state.

    Numbers go on after what earlier batches wrote, so a batch that runs again writes the same operations anew.
    """
    spark = changes.sparkSession
    logs = [f"{path}/log/batch={n}" for n in _done(spark, f"{path}/log", "batch") if n < number]
    log = spark.read.parquet(*logs).select("origin", "origin_seq") if logs else spark.createDataFrame([], "origin string, origin_seq long")
    index = materialized(spark, f"{path}/state", number) if number else spark.createDataFrame([], INDEX)
    R.append_local(changes, index, log, ["t", "event_id"], block).write.mode("overwrite").parquet(f"{path}/log/batch={number}")
    fold_batch(spark.read.parquet(f"{path}/log/batch={number}"), number, f"{path}/state")


def append_changes(changes: DataFrame, path: str, checkpoint: str, block: Column) -> StreamingQuery:
    """Local changes as a stream: no-op filter, numbers, vectors and identities, over the state that earlier batches left."""
    return changes.writeStream.foreachBatch(lambda batch, number: append_batch(batch, number, path, block)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_manifests(chunks: DataFrame, path: str, number: int) -> None:
    """Manifests of a batch (file, idx, hash, len): chunk rows first, then the headers that count them, each under the batch's number.

    A batch that runs again replaces its own rows. A reader sees a manifest only with all its chunks.
    """
    chunks.select("file", "idx", "hash", "len").write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
    C.manifests(chunks).write.mode("overwrite").parquet(f"{path}/headers/batch={number}")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Complete manifests of all batches; of a file that came more than once the last."""
    headers, chunks = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/chunks")
    last = headers.groupBy("file").agg(F.max_by(F.struct("batch", "chunk_count"), "batch").alias("h")).select("file", "h.*")
    return C.complete(last.select("file", "chunk_count"), chunks.join(last.select("file", "batch"), ["file", "batch"], "left_semi"))


def ingest_feed(feed: DataFrame, root: str, disk: DataFrame, index: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A change feed (kind, old, new, ...) as local events (path, path_old, kind) below path/batch=<number>.

    A batch with an overflow (kind = 'overflow': the feed lost events) is followed by a rescan: what differs between disk and index.
    """

    def run(batch: DataFrame, number: int) -> None:
        events = I.normalize_events(batch.filter("kind <> 'overflow'"), root).select("path", "path_old", "kind")
        if not batch.filter("kind = 'overflow'").isEmpty():
            events = events.unionByName(I.scan_diff(disk, index).select("path", F.lit(None).cast("string").alias("path_old"), "kind"))
        events.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rescan(notices: DataFrame, disk: Callable[[], DataFrame], index: Callable[[], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A scan of the disk against the index into path/batch=<number> for each batch of notices.

    notices: a rate stream for scans at a steady pace, or files that ask for one early; `every` is the trigger, else all that is there.
    Both tables are made anew for each batch.
    """

    def run(_: DataFrame, number: int) -> None:
        I.scan_diff(disk(), index()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = notices.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def gossip(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Roster entries as they come, merged into the winners below path/roster=<number>; the last but one stays for a batch that runs again."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = {n: at for n, at in _done(spark, path, "roster").items() if n < number}
        merged = N.merge(spark.read.parquet(f"{path}/roster={max(held)}"), batch) if held else N.winners(batch)
        merged.write.mode("overwrite").parquet(f"{path}/roster={number}")
        for n in sorted(held)[:-1]:
            held[n].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held[n], True)

    return entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gossiped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/roster={max(_done(spark, path, 'roster'))}")


def quiet_writes(events: DataFrame, gap: str, lateness: str = "0 seconds") -> DataFrame:
    """The last write of each burst on a path; a burst ends when nothing came for `gap`. events: (path, kind, ts, event_id)."""
    burst = events.withWatermark("ts", lateness).groupBy("path", F.session_window("ts", gap).alias("burst"))
    return burst.agg(F.max_by(F.struct("kind", "event_id"), F.struct("ts", "event_id")).alias("last")).select("path", "burst.end", "last.*").filter("kind = 'write'")


REGISTERED = "path string, kind string, content_hash string, t long, number int"


def _last_registered(found: DataFrame) -> DataFrame:
    """What the last batch that touched a path left there."""
    return found.groupBy("path").agg(F.max_by(F.struct(*found.columns), "number").alias("v")).select("v.*")


def suppress_batch(marked: DataFrame, number: int, path: str, ttl: int) -> None:
    """A batch's events that no registration swallows into path/out/batch=<number>, and what it leaves registered into path/state.

    The registration that earlier batches left on a path comes before all of the batch. One that is used or replaced leaves
    a row without a time. A path is one window in order of time, with neither a fold nor a process for it.
    """
    spark, columns = marked.sparkSession, ("path", "kind", "content_hash", "t", "is_event", "event_id")
    rows, levels = marked.select(*columns, F.lit(1).alias("turn")), _chain(number)
    if levels:
        left = _last_registered(spark.read.schema(REGISTERED).parquet(*(f"{path}/state/level={n}" for n in levels))).filter("t IS NOT NULL")
        mine = left.join(marked.select("path").distinct(), "path", "left_semi")
        rows = rows.unionByName(mine.select("path", "kind", "content_hash", "t", F.lit(False).alias("is_event"), F.lit(0).cast("long").alias("event_id"), F.lit(0).alias("turn")))
    by = Window.partitionBy("path").orderBy("turn", "t", "is_event", "kind", F.col("content_hash").asc_nulls_first(), "event_id")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(~F.col("is_event"), F.struct("kind", "content_hash", "t")), ignorenulls=True).over(upto)
    told = rows.withColumns({"mark": own, "is_last": F.lead(F.lit(1)).over(by).isNull()})
    alike = (F.col("kind") == F.col("mark.kind")) & ((F.col("kind") == "delete") | F.col("content_hash").eqNullSafe(F.col("mark.content_hash")))
    told = told.withColumn("hit", F.coalesce(F.col("is_event") & alike & (F.col("t") - F.col("mark.t") < ttl), F.lit(False)))
    told = told.withColumn("hits", F.sum(F.col("hit").cast("long")).over(upto))
    told = told.withColumn("hits", F.col("hits") - F.coalesce(F.last(F.when(~F.col("is_event"), F.col("hits")), ignorenulls=True).over(upto), F.lit(0)))
    passed = F.col("is_event") & ~(F.col("hit") & (F.col("hits") == 1))
    told = settle(told.select("path", "event_id", passed.alias("passed"), "is_last", "mark", "hits").filter("passed OR (is_last AND mark IS NOT NULL)"), "told")
    told.filter("passed").select("event_id").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    unused = lambda c: F.when(F.col("hits") == 0, F.col(f"mark.{c}")).alias(c)
    new = told.filter("is_last AND mark IS NOT NULL").select("path", unused("kind"), unused("content_hash"), unused("t"), F.lit(number).alias("number"))
    _add_level(new, number + 1, f"{path}/state", _last_registered)
    release(told)


def suppress(marked: DataFrame, ttl: int, path: str, checkpoint: str) -> StreamingQuery:
    """Events that no registration swallows, as the batch operator has it; marked: (path, kind, content_hash, t in microseconds, is_event, event_id).

    A path's state is its one registration, until it is used or replaced; one older than ttl swallows nothing. A micro-batch
    may come in any order, batches come in order of time. A batch that runs again writes the same files.
    """
    return marked.writeStream.foreachBatch(lambda batch, number: suppress_batch(batch, number, path, ttl)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_quarantine(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes on, and the dead letters."""
    routed = results.withColumn("route", P.error_class(F.col("error")))
    return routed.filter("route <> 'quarantine'"), routed.filter("route = 'quarantine'")


def after_frontier(ops: DataFrame, frontier: DataFrame) -> DataFrame:
    """Live operations that the bootstrap snapshot does not cover: a stream-static join on the frontier, one row per origin."""
    covered = frontier.select("origin", "max_seq")
    return ops.join(covered, "origin", "left").filter(F.col("origin_seq") > F.coalesce("max_seq", F.lit(0))).drop("max_seq")


def sequence_gaps(ops: DataFrame) -> DataFrame:
    """Holes in an origin's sequence, which call for a rescan.

    Holes inside blocks of sequence numbers are found block by block; those between blocks from one row for each block.
    """
    before = F.lag("origin_seq").over(Window.partitionBy("origin", "block").orderBy("origin_seq"))
    each = ops.select("origin", "origin_seq", L.block_of("origin_seq").alias("block")).withColumn("before", before)
    inside = each.filter(F.col("origin_seq") > F.col("before") + 1)
    edges = each.groupBy("origin", "block").agg(F.min("origin_seq").alias("origin_seq"), F.max("origin_seq").alias("last"))
    across = edges.withColumn("before", F.coalesce(F.lag("last").over(Window.partitionBy("origin").orderBy("block")), F.lit(0)))
    found = inside.select("origin", "before", "origin_seq").unionByName(across.filter(F.col("origin_seq") > F.col("before") + 1).select("origin", "before", "origin_seq"))
    return found.select("origin", (F.col("before") + 1).alias("from"), (F.col("origin_seq") - 1).alias("to"))


def lost_so_far(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same on a stream: blocks with the operations of each batch go to `path`, and sequence_gaps reads them whenever asked.

    A hole may be filled by a later batch, so nothing is told before it is asked for.
    """
    seen = ops.select("origin", "origin_seq")
    return seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def op_rate(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Operations per origin in tumbling or sliding windows."""
    return events.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "origin").agg(F.count(F.lit(1)).alias("n")).select("origin", F.col("window.start").alias("begin"), "n")
