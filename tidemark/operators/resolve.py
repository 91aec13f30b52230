"""Resolution: decisions, candidates, antichains, winners, preserved copies, rename effects. Causality comes from vectors alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import vv as V
from tidemark.operators.oplog import assign_sequence
from tidemark.sources.shared import settle

#: Columns of a version, next to its path and vector.
VERSION = ("tombstone", "content_hash", "meta_hash", "naming_hash", "mode", "size", "uuid")
CHAIN = 4


def version_key(x: str = "") -> Column:
    """What decides between concurrent versions: live before deleted, then content, then metadata."""
    c = (lambda n: F.col(f"{x}.{n}")) if x else F.col
    return F.struct((~c("tombstone")).cast("int").alias("live"), F.coalesce(c("content_hash"), F.lit(D.ZEROS)).alias("content"), c("meta_hash").alias("meta"))


def decision(local_vv: Column, remote_vv: Column) -> Column:
    """apply, ignore or concurrent; local is null where there is no row."""
    relation = V.compare(remote_vv, local_vv)
    return F.when(local_vv.isNull() | (relation == "dominates"), "apply").when(relation == "concurrent", "concurrent").otherwise("ignore")


def decide(ops: DataFrame, index: DataFrame) -> DataFrame:
    """Every operation with the decision against the row at its path."""
    local = index.select("path", F.col("vv").alias("local_vv"))
    return ops.join(local, "path", "left").withColumn("decision", decision(F.col("local_vv"), F.col("vv"))).drop("local_vv")


def effects(ops: DataFrame) -> DataFrame:
    """Versions that operations put at paths: a rename is a write at its path and a deletion at its old one."""
    empty = {"content_hash": F.lit(None).cast("string"), "meta_hash": F.lit(D.NO_META), "naming_hash": F.lit(None).cast("string"), "mode": F.lit(0), "size": F.lit(0).cast("long")}
    gone = F.col("op_type") == "delete"
    own = [F.when(gone, empty[c]).otherwise(F.col(c)).alias(c) if c in empty else F.col(c) for c in VERSION if c != "tombstone"]
    target = ops.select("path", gone.alias("tombstone"), *own, "vv", "origin", "origin_seq", "op_id")
    moved = ops.filter("op_type = 'rename' AND path_old IS NOT NULL")
    source = moved.select(F.col("path_old").alias("path"), F.lit(True).alias("tombstone"), *(empty[c].alias(c) if c in empty else F.col(c) for c in VERSION if c != "tombstone"), "vv", "origin", "origin_seq", "op_id")
    return target.unionByName(source)


def candidates(ops: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Effects of the operations, and the rows of the index that the operations do not cover."""
    found = effects(ops).select("path", *VERSION, "vv", "origin", "origin_seq")
    if index is None:
        return found
    covered = V.merged_by(found.select("path", "vv"), ["path"]).withColumnRenamed("vv", "ops_vv")
    rows = index.join(covered, "path", "left").filter(F.col("ops_vv").isNull() | ~V.covers(F.col("ops_vv"), F.col("vv")))
    return found.unionByName(rows.select("path", *VERSION, "vv", F.lit(None).cast("string").alias("origin"), F.lit(None).cast("long").alias("origin_seq")))


def latest_per_origin(found: DataFrame) -> DataFrame:
    """The last candidate of each origin on a path dominates that origin's earlier ones, so no others can be maximal.

    A path then has as many candidates as it has origins, however long its history; rows without an origin all stay. One grouping, no
    union: what was found is worked out once, and rows that lie together by path still do.
    """
    row, alone = F.struct(*found.columns), F.col("origin").isNull()
    grouped = found.groupBy("path", "origin").agg(F.max_by(row, "origin_seq").alias("v"), F.collect_list(F.when(alone, row)).alias("each"))
    stays = grouped.select("path", F.explode(F.when(alone, F.col("each")).otherwise(F.array("v"))).alias("v"))
    return stays.select(*("path" if c == "path" else f"v.{c}" for c in found.columns))


def by_path(found: DataFrame) -> DataFrame:
    """Per path its candidates c, one of each origin, and m, those of them that no other strictly dominates.

    Two shuffles and no join: the first combines before it, so a path with a long history sends a row per origin and task; the
    second brings together at most as many rows as a path has origins.
    """
    each = F.collect_list(F.struct(*VERSION, "vv", "origin", "origin_seq"))
    grouped = latest_per_origin(found).groupBy("path").agg(each.alias("c"))
    return grouped.withColumn("m", F.filter("c", lambda x: ~F.exists(F.col("c"), lambda y: V.dominates(y["vv"], x["vv"]))))


def key_of(x: Column) -> Column:
    """version_key of a version that is a struct."""
    return F.struct((~x["tombstone"]).cast("int").alias("live"), F.coalesce(x["content_hash"], F.lit(D.ZEROS)).alias("content"), x["meta_hash"].alias("meta"))


def antichain(found: DataFrame) -> DataFrame:
    """Candidates that no other on the path strictly dominates; of equal vectors the one with the largest key, mode and uuid."""
    each = by_path(found).select("path", F.explode("m").alias("v")).select("path", "v.*").withColumn("vv_key", V.key(F.col("vv")))
    order = F.struct(version_key(), "mode", F.coalesce("uuid", F.lit("")), "size", F.coalesce("naming_hash", F.lit("")), F.coalesce("origin", F.lit("")), F.coalesce("origin_seq", F.lit(0)))
    columns = [c for c in each.columns if c != "vv_key"]
    return each.groupBy("path", "vv_key").agg(F.max_by(F.struct(*columns), order).alias("v")).select("v.*")


def winners(found: DataFrame, maximal: DataFrame | None = None) -> DataFrame:
    """One row per path: the largest key wins; among equal keys mode and uuid are the largest; the vector merges all candidates.

    The antichain follows from the candidates, so a caller that has it need not pass it.
    """
    return _won(by_path(found))


def torn(found: DataFrame) -> DataFrame:
    """Winners of the paths with more than one maximal candidate, and as members how many; equal vectors count once, as in antichain.

    Both follow from a path's candidates, so these are found once and nothing is joined.
    """
    vectors = F.array_distinct(F.transform("m", lambda x: V.key(x["vv"])))
    met = by_path(found).withColumn("members", F.size(vectors).cast("long"))
    return _won(met.filter("path IS NOT NULL AND members > 1"), "members")


def _won(grouped: DataFrame, *more: str) -> DataFrame:
    keyed = grouped.withColumn("k", F.array_max(F.transform("m", key_of))).withColumn("same", F.filter("m", lambda x: key_of(x) == F.col("k")))
    most = lambda n: F.array_max(F.transform("same", lambda x: x[n]))
    dead = F.col("k.live") == 0
    none = F.create_map().cast("map<string,bigint>")
    return keyed.select(
        "path", dead.alias("tombstone"), F.when(~dead, most("content_hash")).alias("content_hash"), F.when(dead, D.NO_META).otherwise(F.col("k.meta")).alias("meta_hash"),
        F.when(~dead, most("naming_hash")).alias("naming_hash"), F.when(dead, 0).otherwise(most("mode")).alias("mode"), F.when(dead, 0).otherwise(most("size")).cast("long").alias("size"), most("uuid").alias("uuid"),
        F.aggregate("c", none, lambda a, x: V.merge(a, x["vv"])).alias("vv"), *more,
    )


def copies(maximal: DataFrame, won: DataFrame) -> DataFrame:
    """Losing versions with content whose key differs from the winner's, at the paths where they are preserved; same names coalesce."""
    key = won.select("path", version_key().alias("won_key"))
    lost = maximal.join(key, "path").filter(F.col("content_hash").isNotNull() & ~F.col("tombstone") & (version_key() != F.col("won_key")))
    named = lost.withColumn("copy_path", D.copy_path(F.col("path"), F.col("content_hash"), F.col("naming_hash")))
    first = F.row_number().over(Window.partitionBy("copy_path").orderBy(version_key().desc()))
    kept = named.withColumn("_n", first).filter("_n = 1")
    path = F.col("copy_path")
    return kept.select("copy_path", F.col("path").alias("copy_of"), "content_hash", "meta_hash", "naming_hash", "mode", "size", D.copy_uuid(path).alias("uuid"), D.copy_vv(path).alias("vv"))


ROW = ("path", *VERSION, "vv")


def as_copy(rows: DataFrame) -> DataFrame:
    """Versions bound for copy_path, with the identity and the vector that follow from that path."""
    path = F.col("copy_path")
    return rows.withColumns({"uuid": D.copy_uuid(path), "vv": D.copy_vv(path), "tombstone": F.lit(False)})


def place_copies(planned: DataFrame, index: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Where planned copies end up among existing rows, over a chain of bounded length.

    Columns: copy_path, copy_of, depth, action, row (what the path then holds, null where it stays) and version (the copy).
    A free path is written; a row whose vector equals or dominates the copy's stays (keep). At a concurrent row the larger
    key holds the path (replace if it is the copy's, else yield), vectors merge, and a loser with content of another key moves one
    link on, to a name that follows from this path. What is left after the last link is unresolved.
    """
    rows = index.select(F.col("path").alias("copy_path"), F.struct(*VERSION, "vv").alias("held"))
    own = F.struct(*VERSION, "vv")
    pending, done = settle(as_copy(planned).select("copy_path", "copy_of", own.alias("version")), "planned"), []
    for depth in range(1, chain + 1):
        met = pending.join(rows, "copy_path", "left")
        relation = V.compare(F.col("held.vv"), F.col("version.vv"))
        stronger = version_key("version") >= version_key("held")
        met = met.withColumn("action", F.when(F.col("held").isNull() | (relation == "dominated"), "write").when(relation.isin("equal", "dominates"), "keep").when(stronger, "replace").otherwise("yield"))
        tie = version_key("version") == version_key("held")
        both = {n: F.when(tie, F.greatest(f"version.{n}", f"held.{n}")) for n in ("mode", "uuid")}
        both["uuid"] = F.coalesce(both["uuid"], F.when(F.col("action") == "yield", F.col("held.uuid")), F.col("version.uuid"))
        merged = {"vv": V.merge(F.col("version.vv"), F.col("held.vv")), "tombstone": F.lit(False)}
        mixed = F.struct(*(merged.get(n, F.coalesce(both.get(n, F.lit(None)), F.when(F.col("action") == "yield", F.col(f"held.{n}")).otherwise(F.col(f"version.{n}")))).alias(n) for n in (*VERSION, "vv")))
        row = F.when(F.col("action") == "write", F.col("version")).when(F.col("action") != "keep", mixed)
        met = settle(met.select("copy_path", "copy_of", "version", "held", "action", row.alias("row"), (F.col("action").isin("replace", "yield") & ~tie).alias("moves")), "met")
        done.append(met.select("copy_path", "copy_of", F.lit(depth).alias("depth"), "action", "row", "version"))
        loser = F.when(F.col("action") == "replace", F.col("held")).otherwise(F.col("version"))
        moving = met.filter("moves").select("copy_path", "copy_of", loser.alias("version")).filter("NOT version.tombstone AND version.content_hash IS NOT NULL")
        further = D.copy_path(F.col("copy_path"), F.col("version.content_hash"), F.col("version.naming_hash"))
        pending = as_copy(moving.select(further.alias("copy_path"), "copy_of", "version.*")).select("copy_path", "copy_of", own.alias("version"))
        rows = rows.join(met.filter("row IS NOT NULL").select("copy_path"), "copy_path", "left_anti").unionByName(met.filter("row IS NOT NULL").select("copy_path", F.col("row").alias("held")))
    done.append(pending.select("copy_path", "copy_of", F.lit(chain + 1).alias("depth"), F.lit("unresolved").alias("action"), F.lit(None).cast(pending.schema["version"].dataType).alias("row"), "version"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def current_state(ops: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The resolved row of every path: a pure function of the set of operations."""
    return winners(candidates(ops, index))


def drop_noops(ops: DataFrame, index: DataFrame) -> DataFrame:
    """Without operations that would change nothing: same content and metadata, deletion of what is gone, empty renames."""
    at = index.select("path", *(F.col(c).alias(f"at_{c}") for c in ("tombstone", "content_hash", "meta_hash")))
    source = index.select(F.col("path").alias("path_old"), F.col("tombstone").alias("source_tombstone"))
    met = ops.join(at, "path", "left").join(source, "path_old", "left")
    same = ~F.col("at_tombstone") & F.col("content_hash").eqNullSafe(F.col("at_content_hash")) & F.col("meta_hash").eqNullSafe(F.col("at_meta_hash"))
    noop = (
        F.when(F.col("op_type") == "write", F.coalesce(same, F.lit(False)))
        .when(F.col("op_type") == "delete", F.coalesce(F.col("at_tombstone"), F.lit(True)))
        .otherwise((F.col("path") == F.col("path_old")) | F.coalesce(F.col("source_tombstone"), F.lit(True)))
    )
    return met.filter(~noop).select(*ops.columns)


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with rows in place of those at the same paths."""
    return index.join(rows.select("path"), "path", "left_anti").unionByName(rows.select(*index.columns))


def all_files(index: DataFrame) -> DataFrame:
    """The whole index in order of path: ranges of paths are sorted apart, so partitions follow each other."""
    return index.orderBy("path")


def needs_staging(planned: DataFrame, index: DataFrame) -> DataFrame:
    """Planned rows whose content or metadata is not current yet, and whether content must move."""
    at = index.filter("NOT tombstone").select("path", F.col("content_hash").alias("at_content"), F.col("meta_hash").alias("at_meta"))
    met = planned.join(at, "path", "left")
    return met.filter(~(F.col("content_hash").eqNullSafe(F.col("at_content")) & F.col("meta_hash").eqNullSafe(F.col("at_meta")))).withColumn("needs_content", ~F.col("content_hash").eqNullSafe(F.col("at_content"))).drop("at_content", "at_meta")


def local_vectors(changes: DataFrame, index: DataFrame) -> DataFrame:
    """Vector of a local change: the row's (a rename merges its source's), with the own counter one higher."""
    none = F.create_map().cast("map<string,bigint>")
    at = index.select("path", F.col("vv").alias("at_vv"))
    source = index.select(F.col("path").alias("path_old"), F.col("vv").alias("source_vv"))
    met = changes.join(at, "path", "left").join(source, "path_old", "left")
    merged = V.merge(F.coalesce("at_vv", none), F.coalesce("source_vv", none))
    return met.withColumn("vv", V.increment(merged, F.col("origin"))).drop("at_vv", "source_vv")


def append_local(changes: DataFrame, index: DataFrame, log: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Operations for local changes (path, op_type write or delete, content_hash, meta_hash, naming_hash, mode, size, origin).

    In the given order a change that would change nothing goes, compared with the change before it on its path or with the index;
    the others get the next numbers of their origin, the path's vector one higher for each change, and the path's identity
    or a fresh one. Several changes of a path may come at once.
    """
    none = F.create_map().cast("map<string,bigint>")
    at = index.select("path", *(F.col(c).alias(f"at_{c}") for c in ("tombstone", "content_hash", "meta_hash", "uuid", "vv")))
    w = Window.partitionBy("path").orderBy(*order)
    met = changes.join(at, "path", "left")
    first = F.row_number().over(w) == 1
    before = {"tombstone": F.lag(F.col("op_type") == "delete").over(w), "content_hash": F.lag("content_hash").over(w), "meta_hash": F.lag("meta_hash").over(w)}
    met = met.withColumns({f"old_{n}": F.when(first, F.col(f"at_{n}")).otherwise(c) for n, c in before.items()})
    gone = F.coalesce("old_tombstone", F.lit(True))
    same = ~gone & F.col("content_hash").eqNullSafe(F.col("old_content_hash")) & F.col("meta_hash").eqNullSafe(F.col("old_meta_hash"))
    kept = met.filter(~F.when(F.col("op_type") == "delete", gone).otherwise(same))
    kept = kept.withColumn("_k", F.row_number().over(w)).withColumn("_vv", F.coalesce("at_vv", none))
    grown = F.map_concat(F.map_filter("_vv", lambda n, _: n != F.col("origin")), F.map_from_arrays(F.array("origin"), F.array(V.get(F.col("_vv"), F.col("origin")) + F.col("_k"))))
    placed = assign_sequence(kept.withColumn("vv", grown), log, order, block)
    minted = F.first(D.fresh_uuid(F.col("origin"), F.col("origin_seq"), F.col("path"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("uuid", F.coalesce("at_uuid", minted)).withColumn("path_old", F.lit(None).cast("string"))
    return placed.drop("_k", "_vv", *(c for c in placed.columns if c.startswith(("at_", "old_"))))
