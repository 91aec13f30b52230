"""Membership: winning entries, digests, effective peers, links, lifecycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import digest as D


def entry_hash() -> Column:
    return D.digest(F.lit("entry"), F.col("node"), F.col("addr"), F.col("fingerprint"), F.col("epoch"), F.col("kind"))


def verified(entries: DataFrame, verify: Callable[[DataFrame], Column]) -> DataFrame:
    """Entries that the given predicate accepts; others never enter."""
    return entries.filter(verify(entries))


def winners(entries: DataFrame) -> DataFrame:
    """Per node the entry with the highest (epoch, removal before addition, content hash); order of arrival plays no part."""
    keyed = entries.withColumn("content_hash", entry_hash())
    key = F.struct("epoch", (F.col("kind") == "remove").cast("int"), "content_hash")
    return keyed.groupBy("node").agg(F.max_by(F.struct("addr", "fingerprint", "epoch", "kind", "content_hash"), key).alias("w")).select("node", "w.*")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exchange of two rosters: the same in either order, and again."""
    columns = ["node", "addr", "fingerprint", "epoch", "kind"]
    return winners(a.select(*columns).unionByName(b.select(*columns)))


def roster_digest(won: DataFrame) -> DataFrame:
    """One digest of the winners in order of node; a roster is small by nature."""
    ordered = F.array_sort(F.collect_list(F.struct("node", "content_hash")))
    return won.agg(F.sha2(F.concat(F.lit("roster"), F.array_join(F.transform(ordered, lambda x: x["content_hash"]), "")), 256).alias("digest"))


def needs_exchange(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two rosters differ, from their digests alone."""
    return roster_digest(a).select(F.col("digest").alias("x")).crossJoin(roster_digest(b).select(F.col("digest").alias("y"))).select((F.col("x") != F.col("y")).alias("differ"))


def live_members(won: DataFrame) -> DataFrame:
    return won.filter("kind = 'add'")


def next_epoch(won: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(won.select("node", "epoch"), "node", "left").select("node", (F.coalesce("epoch", F.lit(0)) + 1).cast("long").alias("next_epoch"))


def effective_peers(seeds: DataFrame, won: DataFrame, own: str) -> DataFrame:
    """Seeds, overridden by additions and evicted by removals, without oneself."""
    s = seeds.select("node", F.col("addr").alias("seed_addr"), F.col("fingerprint").alias("seed_fingerprint"))
    met = s.join(won.select("node", "addr", "fingerprint", "kind"), "node", "full").filter((F.col("node") != own) & F.coalesce(F.col("kind") != "remove", F.lit(True)))
    return met.select("node", F.coalesce("addr", "seed_addr").alias("addr"), F.coalesce("fingerprint", "seed_fingerprint").alias("fingerprint"))


def allowed(connections: DataFrame, peers: DataFrame) -> DataFrame:
    """Connections whose fingerprint a peer has."""
    return connections.join(peers.select("fingerprint"), "fingerprint", "left_semi")


def peer_of(connections: DataFrame, peers: DataFrame) -> DataFrame:
    return connections.join(peers.select("fingerprint", "node"), "fingerprint")


def peer_views(peers: DataFrame, connected: DataFrame) -> DataFrame:
    """Peers by id, with whether they are connected."""
    marks = connected.select("node").distinct().withColumn("up", F.lit(True))
    return peers.join(marks, "node", "left").withColumn("connected", F.coalesce("up", F.lit(False))).drop("up").orderBy("node")


def pick_peer(peers: DataFrame, seed: int) -> DataFrame:
    """One peer, drawn by the seed alone: the smallest digest of seed and id, whatever the order of rows. One row is the feature."""
    return peers.orderBy(D.digest(F.lit(seed), F.col("node")), "node").limit(1)


def member_views(won: DataFrame, states: DataFrame) -> DataFrame:
    """Live members by id with their lifecycle state; joining where nothing is known."""
    return live_members(won).join(states.select("node", "state"), "node", "left").withColumn("state", F.coalesce("state", F.lit("joining"))).orderBy("node")


def link_changes(desired: DataFrame, running: DataFrame) -> DataFrame:
    """What to do for each node: start, restart (address or fingerprint changed), stop or keep."""
    r = running.select("node", F.col("addr").alias("run_addr"), F.col("fingerprint").alias("run_fingerprint"))
    met = desired.select("node", "addr", "fingerprint").join(r, "node", "full")
    action = F.when(F.col("run_addr").isNull(), "start").when(F.col("addr").isNull(), "stop").when((F.col("addr") != F.col("run_addr")) | (F.col("fingerprint") != F.col("run_fingerprint")), "restart").otherwise("keep")
    return met.select("node", action.alias("action"))


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each node from events (node, peer, event in expected, completed, unreachable): active once every expected peer
    is completed or unreachable (at once if none is expected), syncing after any outcome, else joining."""
    each = events.groupBy("node", "peer").agg(F.bool_or(F.col("event") == "expected").alias("expected"), F.bool_or(F.col("event").isin("completed", "unreachable")).alias("settled"))
    state = F.when(F.bool_and(~F.col("expected") | F.col("settled")), "active").when(F.bool_or("settled"), "syncing").otherwise("joining")
    return each.groupBy("node").agg(F.count_if("expected").alias("expected"), F.count_if(F.col("expected") & F.col("settled")).alias("settled"), state.alias("state"))
