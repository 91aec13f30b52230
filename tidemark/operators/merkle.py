"""Hierarchical digests of an index, differences of two indexes, and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import scalars as S
from tidemark.functions import vv as V
from tidemark.operators import resolve as R
from tidemark.sources.shared import settle

CHILD = ("prefix", "name", "is_dir", "hash", "depth")
#: Children from which on a folder is hashed in two levels, and large folders up to which they are broadcast.
WIDE, MANY = 100_000, 100_000


def leaves(index: DataFrame) -> DataFrame:
    """Every row, deleted ones included, with its leaf hash."""
    return index.select("path", D.leaf_hash(F.col("path"), F.col("tombstone"), F.col("content_hash"), F.col("uuid"), F.col("meta_hash"), V.text(F.col("vv"))).alias("hash"))


def depth_of(path: str) -> object:
    return F.size(F.split(path, "/")) - 1


def combine(children: DataFrame, wide: int | None = None) -> DataFrame:
    """Hash of each prefix from its children, sorted by name; a name that is both file and folder has two children.

    With `wide`, a folder with more children than that is hashed in two levels: children by the first two digits of the digest of
    their name, then those 256 hashes in order. So no task collects a very large folder. The form follows from the number of
    children alone, so equal folders have equal hashes; folders of unlike numbers differ anyway.
    """
    part = D.canonical(F.col("name"), F.col("is_dir").cast("int"), F.col("hash"))
    parts = children.select("prefix", "name", "is_dir", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "is_dir", "part"))), lambda x: x["part"]), "")
    flat = lambda rows: rows.groupBy("prefix").agg(F.sha2(F.concat(F.lit("3:dir"), joined), 256).alias("hash"))
    if wide is None:
        return flat(parts)
    large = settle(children.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > wide).select("prefix"), "wide")
    if large.isEmpty():
        return flat(parts)
    side = F.broadcast(large) if large.count() <= MANY else large.hint("shuffle_merge")
    cut = parts.join(side, "prefix", "left_semi").groupBy("prefix", F.substring(F.sha2("name", 256), 1, 2).alias("bucket")).agg(F.sha2(joined, 256).alias("h"))
    buckets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")
    return flat(parts.join(side, "prefix", "left_anti")).unionByName(cut.groupBy("prefix").agg(F.sha2(F.concat(F.lit("4:wide"), buckets), 256).alias("hash")))


def levels(index: DataFrame, wide: int = WIDE) -> DataFrame:
    """All children of all prefixes: (prefix, name, is_dir, hash, depth). One aggregation per level of the deepest path."""
    path = F.col("path")
    found = settle(leaves(index).select(S.parent(path).alias("prefix"), S.name(path).alias("name"), F.lit(False).alias("is_dir"), "hash", depth_of("path").alias("depth")), "leaves")
    files = {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()}  # a row for each level
    total, below = found, 0
    for depth in range(max(files, default=0), 0, -1):
        below += files.get(depth, 0)  # no folder here has more children than there are files from here down
        dirs = settle(combine(total.filter(F.col("depth") == depth), wide if below > wide else None), "dirs")
        prefix = F.col("prefix")
        total = total.unionByName(dirs.select(S.parent(prefix).alias("prefix"), S.name(prefix).alias("name"), F.lit(True).alias("is_dir"), "hash", F.lit(depth - 1).alias("depth")))
    return total


def root(tree: DataFrame, wide: int = WIDE) -> DataFrame:
    """The root hash: one row, also for an empty tree."""
    spark = tree.sparkSession
    top = combine(tree.filter("depth = 0"), wide).select("hash")
    empty = spark.range(1).select(F.sha2(F.lit("3:dir"), 256).alias("empty"))
    return empty.join(top, F.lit(True), "left").select(F.coalesce("hash", "empty").alias("root"))


def children_page(tree: DataFrame, prefix: str, after: str, limit: int) -> DataFrame:
    """The next children of a prefix by name, and whether there are more; a page is the feature."""
    page = tree.filter((F.col("prefix") == prefix) & (F.col("name") > after)).orderBy("name", "is_dir").limit(limit + 1)
    n = F.row_number().over(Window.partitionBy("prefix").orderBy("name", "is_dir"))  # over the limit + 1 rows of the page
    total = F.count(F.lit(1)).over(Window.partitionBy("prefix"))
    return page.select("prefix", "name", "is_dir", "hash", n.alias("n"), (total > limit).alias("more")).filter(F.col("n") <= limit).drop("n")


def diff(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Leaves of the remote tree that the local one lacks or has differently. Folders with equal hashes are not entered."""
    parts = [unlike for _, unlike in descend(remote, local)]
    out = parts[0] if parts else remote.limit(0).withColumn("local_hash", F.col("hash"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("NOT is_dir").select(S.join_path(F.col("prefix"), F.col("name")).alias("path"), "hash", "local_hash")


def listings(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What a diff costs: folders whose children are listed (none if the roots agree), and leaves that differ. One row."""
    met = descend(remote, local)
    opened = sum((1 if prefixes is None else prefixes.count()) for prefixes, _ in met)
    unlike = sum(rows.filter("NOT is_dir").count() for _, rows in met)
    return remote.sparkSession.createDataFrame([(opened, unlike)], "listings long, leaves long")


def descend(remote: DataFrame, local: DataFrame) -> list[tuple[DataFrame | None, DataFrame]]:
    """Level by level the folders entered (None: the root) and their children that the local tree lacks or has differently."""
    if root(remote).first() == root(local).first():
        return []
    out: list[tuple[DataFrame | None, DataFrame]] = []
    entered, depth = None, 0
    while True:
        theirs = remote.filter(F.col("depth") == depth)
        if entered is not None:
            theirs = theirs.join(entered, "prefix", "left_semi")
        ours = local.filter(F.col("depth") == depth).select("prefix", "name", "is_dir", F.col("hash").alias("local_hash"))
        unlike = settle(theirs.join(ours, ["prefix", "name", "is_dir"], "left").filter(~F.col("hash").eqNullSafe(F.col("local_hash"))), "unlike")
        out.append((entered, unlike))
        entered = unlike.filter("is_dir").select(S.join_path(F.col("prefix"), F.col("name")).alias("prefix"))
        if entered.isEmpty():
            return out
        depth += 1


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local index after a pull: newer rows are applied, concurrent ones resolved (copies included), the rest stays.

    Copies go through a chain of names past the rows that hold theirs, also those that this pull has just put there, so no row
    is lost to a copy. A conflict whose chain is too long stays as it is locally, for a later pull.
    """
    columns = R.ROW
    changed = settle(diff(levels(remote), levels(local)).select("path"), "changed")
    decided = settle(R.decide(remote.join(changed, "path", "left_semi"), local), "decided")
    mine = local.select("path", F.col("vv").alias("local_vv"))
    fresh = decided.filter("decision = 'apply'").join(mine, "path", "left").withColumn("vv", F.when(F.col("local_vv").isNull(), F.col("vv")).otherwise(V.merge(F.col("vv"), F.coalesce("local_vv", F.col("vv"))))).select(*columns)
    contested = decided.filter("decision = 'concurrent'").select(*columns)
    extra = (F.lit(None).cast("string").alias("origin"), F.lit(None).cast("long").alias("origin_seq"))
    while True:
        both = contested.select(*columns, *extra).unionByName(local.join(contested.select("path"), "path", "left_semi").select(*columns, *extra))
        maximal = R.antichain(both)
        won = settle(R.winners(both).select(*columns), "won")
        index = settle(R.upsert(local.select(*columns), fresh.unionByName(won)), "index")
        placed = settle(R.place_copies(R.copies(maximal, won), index), "placed")
        stuck = placed.filter("action = 'unresolved'").select(F.col("copy_of").alias("path")).distinct()
        if stuck.isEmpty():
            break
        contested = settle(contested.join(stuck, "path", "left_anti"), "contested")
    rows = placed.filter("row IS NOT NULL").select(F.col("copy_path").alias("path"), "row.*", "depth")
    last = rows.groupBy("path").agg(F.max_by(F.struct(*columns), "depth").alias("r")).select("r.*")
    return R.upsert(index, last)


def report(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Counters of a pull: compared leaves by decision."""
    changed = diff(levels(remote), levels(local)).select("path")
    decided = R.decide(remote.join(changed, "path", "left_semi"), local)
    return decided.agg(F.count(F.lit(1)).alias("leaves"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("apply", "concurrent", "ignore")))
