"""Op log: appends, scans, frontiers, cursors, acknowledgements and lag."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import vv as V

#: Sequence numbers that one task looks at.
BLOCK = 65_536
#: Operations of a path that are compared at once with as many others.
PAIRED = 1_024


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose op_id the log does not have, each once: an insert that ignores known keys."""
    return new.dropDuplicates(["op_id"]).join(log.select("op_id"), "op_id", "left_anti")


def ops_since(log: DataFrame, origin: str, after: int, limit: int) -> DataFrame:
    """The next operations of an origin after a cursor, in order; a range scan with a limit, which is the feature."""
    return log.filter((F.col("origin") == origin) & (F.col("origin_seq") > after)).orderBy("origin_seq").limit(limit)


def unapplied(ops: DataFrame, applied: DataFrame) -> DataFrame:
    return ops.join(applied.select("op_id").distinct(), "op_id", "left_anti")


def has_applied(ops: DataFrame, applied: DataFrame) -> DataFrame:
    return ops.join(applied.select("op_id"), "op_id", "left_semi")


def frontier(log: DataFrame) -> DataFrame:
    return log.groupBy("origin").agg(F.max("origin_seq").alias("max_seq"))


def next_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("origin").agg((F.max("origin_seq") + 1).alias("next_seq"))


def numbered(df: DataFrame, key: str, order: list[str], block: Column, parts: int | None = None) -> DataFrame:
    """Rows with their rank from 1 within key, as column n, in the given order.

    A key may hold a large part of all rows, so no task orders a whole key: rows are ranked within (key, block), where
    block, a number, never falls in that order, and get the count of the rows in the key's earlier blocks on top. Only those
    counts, a row for each block, are summed by key. parts: tasks that share the blocks, where the session's number is too small.
    """
    blocks = df.withColumn("_block", block)
    inside = (blocks.repartition(parts, key, "_block") if parts else blocks).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)))
    sums = blocks.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(key, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return inside.join(starts, [key, "_block"]).withColumn("n", (F.col("_before") + F.col("_n")).cast("long")).drop("_block", "_n", "_before")


def assign_sequence(changes: DataFrame, log: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Gap-free origin_seq after the log's highest, and the op_id that follows from it; block as for numbered."""
    placed = numbered(changes, "origin", order, block).join(frontier(log), "origin", "left")
    placed = placed.withColumn("origin_seq", F.coalesce("max_seq", F.lit(0)) + F.col("n")).drop("n", "max_seq")
    return placed.withColumn("op_id", D.op_id(F.col("origin"), F.col("origin_seq")))


def advance_cursors(cursors: DataFrame, news: DataFrame) -> DataFrame:
    """Monotone upsert of (peer, origin, recv_cursor, last_acked_seq)."""
    return cursors.unionByName(news).groupBy("peer", "origin").agg(F.max("recv_cursor").alias("recv_cursor"), F.max("last_acked_seq").alias("last_acked_seq"))


def cursor_values(pairs: DataFrame, cursors: DataFrame, column: str) -> DataFrame:
    """A cursor for every asked (peer, origin); 0 where none is stored."""
    return pairs.join(cursors.select("peer", "origin", column), ["peer", "origin"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def migrate_cursors(old: DataFrame, origins: DataFrame) -> DataFrame:
    """One cursor per (peer, origin) from a table that had a single cursor per peer: it stood for the peer's own operations."""
    return old.join(origins.select("origin").distinct(), old["peer"] == F.col("origin")).select("peer", "origin", F.col("cursor").alias("recv_cursor"), F.lit(0).cast("long").alias("last_acked_seq"))


def block_of(seq: str) -> Column:
    """Block of a sequence number; the first is 1."""
    return F.floor((F.col(seq) - 1) / BLOCK).cast("long")


def contiguous_ack(received: DataFrame) -> DataFrame:
    """Per (peer, origin) the largest seq up to which everything arrived, whatever the order of arrival.

    Blocks of sequence numbers are judged apart, so a long history is many tasks. The answer lies in the first block that is
    not full: number 0, or one after a full block, and not full itself.
    """
    keys = ["peer", "origin"]
    each = received.select(*keys, "origin_seq").distinct().withColumn("block", block_of("origin_seq"))
    rank = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("origin_seq"))
    straight = F.col("origin_seq") - F.col("block") * BLOCK == F.col("rank")
    blocks = each.withColumn("rank", rank).groupBy(*keys, "block").agg(F.count_if(straight).alias("run"))
    full = blocks.filter(F.col("run") == BLOCK)
    after = full.select(*keys, (F.col("block") + 1).alias("block")).unionByName(blocks.select(*keys, F.lit(0).cast("long").alias("block")).distinct())
    first = after.join(full, [*keys, "block"], "left_anti").groupBy(*keys).agg(F.min("block").alias("block"))
    return first.join(blocks, [*keys, "block"], "left").select(*keys, (F.col("block") * BLOCK + F.coalesce("run", F.lit(0))).cast("long").alias("acked"))


def split_acks(acks: DataFrame) -> DataFrame:
    """Acks with a verdict: in bounds, foreign origin, or beyond what was sent."""
    verdict = F.when(F.col("ack_origin") != F.col("origin"), "foreign").when(F.col("up_to_seq") > F.col("sent_seq"), "beyond").otherwise("ok")
    return acks.withColumn("verdict", verdict)


def lag_view(members: DataFrame, log: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each member and origin (both bounded by the roster): latest seq, what the member has acknowledged, and the difference."""
    latest = frontier(log)
    pairs = members.select(F.col("node").alias("peer")).crossJoin(latest)
    known = pairs.join(cursors, ["peer", "origin"], "left").withColumn("acked", F.coalesce("last_acked_seq", F.lit(0)))
    return known.select("peer", "origin", "max_seq", "acked", (F.col("max_seq") - F.col("acked")).alias("lag"))


def lag_spread(lags: DataFrame) -> DataFrame:
    total = lags.groupBy("peer").agg(F.sum("lag").alias("lag"))
    return total.agg(F.max("lag").alias("max_lag"), F.min("lag").alias("min_lag"), (F.max("lag") - F.min("lag")).alias("spread"))


def op_pair_causality(ops: DataFrame, parts: int | None = None) -> DataFrame:
    """How many pairs of operations on one path stand in each causal relation.

    A pair needs both rows, so paths with long histories cost the square of their length; that is the question asked here,
    not part of resolving, which looks at one row per origin. A path's history is cut into blocks, and each pair of blocks is compared
    apart as two arrays of counters, so a group has at most 2 * PAIRED rows and a long history is many groups, shared by parts tasks.
    """
    own = ops.filter("path IS NOT NULL AND op_id IS NOT NULL").select("path", "op_id", F.map_entries("vv").alias("vv"))
    on_path = Window.partitionBy("path")
    placed = own.withColumn("b", F.floor((F.row_number().over(on_path.orderBy("op_id")) - 1) / PAIRED).cast("long")).withColumn("last", F.floor((F.count(F.lit(1)).over(on_path) - 1) / PAIRED).cast("long"))
    met = placed.select("path", "op_id", "vv", "b", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("o"))
    met = met.select("path", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "op_id", "vv")
    met = met.repartition(parts, "path", "i", "j") if parts else met

    def related(group: pa.Table) -> pa.Table:
        n = group.num_rows
        block, i, j = (group.column(c).to_numpy() for c in ("b", "i", "j"))
        ids = group.column("op_id").combine_chunks().dictionary_encode().indices.to_numpy()
        lists = group.column("vv").combine_chunks()
        entries = lists.flatten()
        nodes = entries.field("key").dictionary_encode()
        rows = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
        counters = np.zeros((len(nodes.dictionary), n), np.int64)
        counters[nodes.indices.to_numpy(), rows] = entries.field("value").to_numpy()
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        asked = ids[left][:, None] != ids[right][None, :]
        if i[0] == j[0]:
            asked &= np.tri(n, k=-1, dtype=bool)
        more, less = np.zeros_like(asked), np.zeros_like(asked)
        for c in counters:
            x, y = c[left][:, None], c[right][None, :]
            more |= x > y
            less |= x < y
        counts = [(asked & more & less).sum(), (asked & (more ^ less)).sum(), (asked & ~(more | less)).sum()]
        return pa.table({"relation": ["concurrent", "ordered", "equal"], "pairs": pa.array(counts, pa.int64())})

    return met.groupBy("path", "i", "j").applyInArrow(related, "relation string, pairs long").groupBy("relation").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


def backfill_uuid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("uuid", F.coalesce("uuid", D.migrated_uuid(F.col("path"))))


def fetch_sources(wanted: DataFrame, peers: DataFrame) -> DataFrame:
    """Peers to ask for each hash, the operation's origin first, then by id."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy((F.col("peer") != F.col("origin")).cast("int"), "peer"))
    return wanted.join(peers, "hash").withColumn("rank", rank)


def acquire(sources: DataFrame, usable: DataFrame) -> DataFrame:
    """Where each hash comes from when peers are asked in order of rank: (hash, peer, rank, tries, outcome).

    sources: (hash, peer, rank); usable: (hash, peer, answer found, missing or busy) of the peers that can be asked. The first peer
    that has it gives it, after as many tries as there are peers before it; if none has it, the loss is permanent if any said so
    and none was busy, else it is to be tried again.
    """
    met = sources.join(usable, ["hash", "peer"], "left")
    got = F.min(F.when(F.col("answer") == "found", F.struct("rank", "peer")))
    busy, missing = F.bool_or(F.col("answer") == "busy"), F.bool_or(F.col("answer") == "missing")
    each = met.groupBy("hash").agg(got.alias("got"), F.coalesce(busy, F.lit(False)).alias("busy"), F.coalesce(missing, F.lit(False)).alias("missing"), F.collect_list(F.when(F.col("answer").isNotNull(), F.col("rank"))).alias("asked"))
    outcome = F.when(F.col("got").isNotNull(), "found").when(F.col("missing") & ~F.col("busy"), "permanent").otherwise("transient")
    tries = F.size(F.filter("asked", lambda r: F.col("got").isNull() | (r <= F.col("got.rank"))))
    return each.select("hash", F.col("got.peer").alias("peer"), F.col("got.rank").alias("rank"), tries.alias("tries"), outcome.alias("outcome"))


def acquisition(asked: DataFrame) -> DataFrame:
    """Outcome per hash: found at some peer, missing at all (permanent), or none usable (transient)."""
    return asked.groupBy("hash").agg(F.when(F.bool_or(F.col("answer") == "found"), "found").when(F.bool_and(F.col("answer") == "missing"), "permanent").otherwise("transient").alias("outcome"))
