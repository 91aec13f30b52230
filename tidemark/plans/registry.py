"""Queries of the change-log engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import predicates as P
from tidemark.functions import scalars as S
from tidemark.functions import vv as V
from tidemark.operators import chunks as C
from tidemark.operators import ingest as I
from tidemark.operators import merkle as M
from tidemark.operators import oplog as L
from tidemark.operators import policy as Q
from tidemark.operators import resolve as R
from tidemark.operators import roster as N
from tidemark.operators import views as W
from tidemark.plans import fixtures as X
from tidemark.sources.shared import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROW = ("path", "tombstone", "content_hash", "meta_hash", "mode", "size", "uuid")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from tidemark.streaming import registry as streams

    return QUERIES | streams.queries()


def oracle_sql() -> dict[str, str]:
    from tidemark.streaming import registry as streams

    return SQL | streams.oracle_sql()


def shown(index: DataFrame) -> DataFrame:
    return index.select(*ROW, V.text(F.col("vv")).alias("vv"))


SHOWN = f"{', '.join(ROW)}, {X.VV_TEXT} AS vv"

# Resolution.


@query(f"{X.OPS}, {X.winners('w')} SELECT {SHOWN} FROM w")
def current_state(spark, sf):
    return shown(R.current_state(X.ops(spark, sf)))


@query(f"{X.OPS}, {X.winners('w')}, torn AS (SELECT path, count(*) AS members FROM w_max GROUP BY path HAVING count(*) > 1) SELECT path, members, tombstone, content_hash FROM w JOIN torn USING (path)")
def conflict_winners(spark, sf):
    return R.torn(R.candidates(X.ops(spark, sf))).select("path", "members", "tombstone", "content_hash")


_COPIES = (
    f"{X.OPS}, {X.winners('w')}, lost AS (SELECT m.path, m.content_hash, m.meta_hash, m.naming_hash FROM w_ranked m JOIN w ON m.path = w.path WHERE m.rank > 1 AND m.content_hash IS NOT NULL AND NOT m.tombstone), "
    f"named AS (SELECT *, path || '.{D.MARKER}-' || {X.dig('content_hash', 'naming_hash')}[1:16] AS copy_path FROM lost), kept AS (SELECT *, row_number() OVER (PARTITION BY copy_path ORDER BY content_hash DESC, meta_hash DESC) AS n FROM named)"
)


@query(f"{_COPIES} SELECT copy_path, path AS copy_of, content_hash, {X.dig(chr(39) + 'copy' + chr(39), 'copy_path')}[1:32] AS uuid FROM kept WHERE n = 1")
def conflict_copies(spark, sf):
    found = R.candidates(X.ops(spark, sf))
    maximal = R.antichain(found)
    return R.copies(maximal, R.winners(found)).select("copy_path", "copy_of", "content_hash", "uuid")


_ORIGIN = X.dig("'copy-origin'", "copy_path")


@query(
    f"{_COPIES}, first AS (SELECT copy_path, path AS copy_of, content_hash, naming_hash, content_hash[1:1] < '8' AS met, reverse(content_hash) AS other FROM kept WHERE n = 1), "
    f"pushed AS (SELECT copy_of || '.{D.MARKER}-' || {X.dig('least(content_hash, other)', 'naming_hash')}[1:16] || copy_path[length(copy_of) + 1:] AS copy_path, copy_of, least(content_hash, other) AS content_hash FROM first WHERE met AND content_hash <> other) "
    f"SELECT copy_path, copy_of, content_hash, 1 AS depth, CASE WHEN NOT met THEN 'write' WHEN content_hash >= other THEN 'replace' ELSE 'yield' END AS action, CASE WHEN met THEN greatest(content_hash, other) ELSE content_hash END AS holds, {_ORIGIN}[1:32] || ':1' || CASE WHEN met THEN ',x:1' ELSE '' END AS vv FROM first "
    f"UNION ALL SELECT copy_path, copy_of, content_hash, 2, 'write', content_hash, {_ORIGIN}[1:32] || ':1' FROM pushed"
)
def copy_chain(spark, sf):
    found = settle(R.latest_per_origin(R.candidates(X.ops(spark, sf))), "found")
    planned = settle(R.copies(R.antichain(found), R.winners(found)), "planned")
    squatters = planned.filter(F.substring("content_hash", 1, 1) < "8").select(F.col("copy_path").alias("path"), F.lit(False).alias("tombstone"), F.reverse("content_hash").alias("content_hash"), "meta_hash", "naming_hash", "mode", "size", "uuid", F.create_map(F.lit("x"), F.lit(1).cast("long")).alias("vv"))
    return R.place_copies(planned, squatters).select("copy_path", "copy_of", "version.content_hash", "depth", "action", F.col("row.content_hash").alias("holds"), V.text(F.col("row.vv")).alias("vv"))


_EQ = " AND ".join(f"a.{c} = b.{c}" for c in X.COUNTERS)


@query(f"{X.OPS} SELECT CASE WHEN {_EQ} THEN 'equal' WHEN {X.above('a', 'b')} OR {X.above('b', 'a')} THEN 'ordered' ELSE 'concurrent' END AS relation, count(*) AS pairs FROM ops a JOIN ops b ON a.path = b.path AND a.op_id < b.op_id GROUP BY 1")
def op_pair_causality(spark, sf):
    return L.op_pair_causality(X.ops(spark, sf), X.shares(spark, sf))


@query(
    f"{X.OPS}, {X.winners('w', where='event_id % 5 <> 0')} SELECT CASE WHEN w.path IS NULL OR {X.above('o', 'w')} THEN 'apply' WHEN {X.above('w', 'o')} OR ({' AND '.join(f'o.{c} = w.{c}' for c in X.COUNTERS)}) THEN 'ignore' ELSE 'concurrent' END AS decision, count(*) AS n "
    "FROM ops o LEFT JOIN w ON o.path = w.path GROUP BY 1"
)
def decide_counts(spark, sf):
    decided = R.decide(X.ops(spark, sf), X.replica(spark, sf, 5))
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(f"{X.OPS}, m AS (SELECT path, {', '.join(f'max({c}) AS {c}' for c in X.COUNTERS)} FROM ops GROUP BY path) SELECT path, {X.VV_TEXT} AS vv FROM m")
def vv_merge_by_path(spark, sf):
    return V.merged_by(X.ops(spark, sf), ["path"]).select("path", V.text(F.col("vv")).alias("vv"))


@query("SELECT user_id % 50 AS grp, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS vv FROM (SELECT user_id % 50 AS user_id, event_type, max(event_id % 9) AS n FROM events WHERE event_id % 9 > 0 GROUP BY ALL) GROUP BY 1")
def vv_from_pairs(spark, sf):
    e = X.events(spark, sf).select((F.col("user_id") % 50).alias("grp"), "event_type", (F.col("event_id") % 9).alias("n0"))
    return V.from_pairs(e, ["grp"], "event_type", "n0").select("grp", V.text(F.col("vv")).alias("vv"))


@query(
    f"{X.OPS}, {X.winners('w', where='event_id % 7 <> 0')}, m AS (SELECT path, {', '.join(f'max({c}) AS {c}' for c in X.COUNTERS)} FROM ops WHERE event_id % 3 = 0 GROUP BY path) "
    f"SELECT w.path, {' AND '.join(f'm.{c} >= w.{c}' for c in X.COUNTERS)} AS covered FROM w JOIN m ON w.path = m.path"
)
def row_coverage(spark, sf):
    merged = V.merged_by(X.ops(spark, sf).filter("event_id % 3 = 0").select("path", "vv"), ["path"]).withColumnRenamed("vv", "ops_vv")
    return X.replica(spark, sf, 7).join(merged, "path").select("path", V.covers(F.col("ops_vv"), F.col("vv")).alias("covered"))


@query(
    f"{X.OPS}, n AS (SELECT o.op_id FROM ops o), {X.winners('w', where='event_id % 5 <> 0')} SELECT o.op_id, o.path FROM ops o LEFT JOIN w ON o.path = w.path WHERE o.event_id % 5 = 0 AND NOT (CASE WHEN o.op_type = 'write' "
    "THEN coalesce(NOT w.tombstone AND o.content_hash IS NOT DISTINCT FROM w.content_hash AND o.meta_hash IS NOT DISTINCT FROM w.meta_hash, false) ELSE coalesce(w.tombstone, true) END)"
)
def noop_filter(spark, sf):
    return R.drop_noops(X.ops(spark, sf).filter("event_id % 5 = 0"), X.replica(spark, sf, 5)).select("op_id", "path")


@query(
    f"{X.OPS} SELECT CASE WHEN event_id % 9 = 0 THEN path || '.r' ELSE path END AS path, op_type = 'delete' AND event_id % 9 <> 0 AS tombstone, op_id FROM ops UNION ALL SELECT path, true, op_id FROM ops WHERE event_id % 9 = 0"
)
def rename_effects(spark, sf):
    return R.effects(X.renames(spark, sf)).select("path", "tombstone", "op_id")


_RENAMED = (
    f"{X.OPS}, moved AS (SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN path || '.r' ELSE path END AS path, CASE WHEN event_id % 9 = 0 THEN 'rename' ELSE op_type END AS op_type) FROM ops "
    "UNION ALL BY NAME SELECT * REPLACE ('delete' AS op_type, CAST(NULL AS VARCHAR) AS content_hash, '-' AS meta_hash, CAST(NULL AS VARCHAR) AS naming_hash, 0 AS size) FROM ops WHERE event_id % 9 = 0)"
)


@query(f"{_RENAMED}, {X.winners('w', source='moved')} SELECT path, tombstone, content_hash, {X.VV_TEXT} AS vv FROM w")
def renamed_state(spark, sf):
    return R.current_state(X.renames(spark, sf)).select("path", "tombstone", "content_hash", V.text(F.col("vv")).alias("vv"))


@query(
    f"{X.OPS}, {X.winners('w', where='event_id % 5 <> 0')}, v AS (SELECT o.op_id, o.origin, {', '.join(f'coalesce(w.{c}, 0) + CASE WHEN o.origin = {chr(39)}{c[2:]}{chr(39)} THEN 1 ELSE 0 END AS {c}' for c in X.COUNTERS)} FROM ops o LEFT JOIN w ON o.path = w.path WHERE o.event_id % 5 = 0) "
    f"SELECT op_id, {X.VV_TEXT} AS vv FROM v"
)
def local_vectors(spark, sf):
    changes = X.ops(spark, sf).filter("event_id % 5 = 0").drop("vv")
    return R.local_vectors(changes, X.replica(spark, sf, 5)).select("op_id", V.text(F.col("vv")).alias("vv"))


@query(f"{X.OPS}, {X.winners('a', where='event_id % 7 <> 0')}, {X.winners('b', where='event_id % 5 <> 0')} SELECT path, coalesce(b.content_hash, a.content_hash) AS content_hash FROM a FULL JOIN (SELECT * FROM b WHERE NOT tombstone) b USING (path)")
def index_upsert(spark, sf):
    return R.upsert(X.replica(spark, sf, 7), X.replica(spark, sf, 5).filter("NOT tombstone")).select("path", "content_hash")


@query(
    f"{X.OPS}, {X.winners('a', where='event_id % 7 <> 0')}, {X.winners('b', where='event_id % 5 <> 0')} SELECT a.path, a.content_hash IS DISTINCT FROM b.content_hash AS needs_content FROM a LEFT JOIN (SELECT * FROM b WHERE NOT tombstone) b ON a.path = b.path "
    "WHERE NOT (a.content_hash IS NOT DISTINCT FROM b.content_hash AND a.meta_hash IS NOT DISTINCT FROM b.meta_hash)"
)
def staging_needed(spark, sf):
    return R.needs_staging(X.replica(spark, sf, 7), X.replica(spark, sf, 5)).select("path", "needs_content")


# Op log.


@query(f"{X.OPS} SELECT origin, max(origin_seq) AS max_seq FROM ops GROUP BY origin")
def frontier(spark, sf):
    return L.frontier(X.ops(spark, sf))


@query(f"{X.OPS} SELECT origin, max(origin_seq) + 1 AS next_seq FROM ops GROUP BY origin")
def next_seq(spark, sf):
    return L.next_seq(X.ops(spark, sf))


@query(f"{X.OPS} SELECT op_type, count(*) AS n FROM ops GROUP BY op_type")
def op_counts(spark, sf):
    return X.ops(spark, sf).groupBy("op_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{X.OPS} SELECT op_id, origin_seq, path FROM ops WHERE origin = 'click' AND origin_seq > 50 ORDER BY origin_seq LIMIT 64")
def ops_since(spark, sf):
    return L.ops_since(X.ops(spark, sf), "click", 50, 64).select("op_id", "origin_seq", "path")


@query(f"{X.OPS} SELECT op_id FROM ops WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def append_ops(spark, sf):
    log = X.ops(spark, sf)
    new = log.filter("event_id % 3 = 0")
    return L.append(log.filter("event_id % 2 = 0"), new.unionByName(new)).select("op_id")


@query(f"{X.OPS} SELECT op_id FROM ops WHERE event_id % 3 = 0 AND event_id % 2 = 0")
def applied_ops(spark, sf):
    log = X.ops(spark, sf)
    return L.has_applied(log.filter("event_id % 3 = 0"), log.filter("event_id % 2 = 0")).select("op_id")


@query("SELECT event_type AS origin, event_id, 100 + row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS origin_seq FROM events")
def sequence_assignment(spark, sf):
    e = X.events(spark, sf).select(F.col("event_type").alias("origin"), "event_id", "t")
    log = spark.createDataFrame([(o, 100) for o in X.ORIGINS], "origin string, origin_seq long")
    return L.assign_sequence(e, log, ["t", "event_id"], X.hour()).select("origin", "event_id", "origin_seq")


@query(
    f"{X.OPS}, {X.PEERS}, got AS (SELECT DISTINCT peer, origin, origin_seq FROM ops, peers WHERE peer <> origin AND NOT (event_id % 11 = 0 AND origin_seq > 20)), r AS (SELECT *, row_number() OVER (PARTITION BY peer, origin ORDER BY origin_seq) AS n FROM got) "
    "SELECT peer, origin, coalesce(max(CASE WHEN n = origin_seq THEN origin_seq END), 0) AS acked FROM r GROUP BY ALL"
)
def contiguous_ack(spark, sf):
    return L.contiguous_ack(X.received(spark, sf))


@query(f"{X.OPS}, {X.CURSORS}, latest AS (SELECT origin, max(origin_seq) AS max_seq FROM ops GROUP BY origin) SELECT p.peer, l.origin, max_seq, coalesce(last_acked_seq, 0) AS acked, max_seq - coalesce(last_acked_seq, 0) AS lag FROM peers p CROSS JOIN latest l LEFT JOIN cursors c ON c.peer = p.peer AND c.origin = l.origin")
def lag_view(spark, sf):
    members = spark.createDataFrame([(o,) for o in X.ORIGINS], "node string")
    return L.lag_view(members, X.ops(spark, sf), X.cursors(spark, sf))


@query(
    f"{X.OPS}, {X.CURSORS}, latest AS (SELECT origin, max(origin_seq) AS max_seq FROM ops GROUP BY origin), lags AS (SELECT p.peer, sum(max_seq - coalesce(last_acked_seq, 0)) AS lag FROM peers p CROSS JOIN latest l LEFT JOIN cursors c ON c.peer = p.peer AND c.origin = l.origin GROUP BY p.peer) "
    "SELECT CAST(max(lag) AS BIGINT) AS max_lag, CAST(min(lag) AS BIGINT) AS min_lag, CAST(max(lag) - min(lag) AS BIGINT) AS spread FROM lags"
)
def lag_spread(spark, sf):
    return L.lag_spread(lag_view(spark, sf))


@query(f"{X.OPS}, {X.CURSORS} SELECT peer, origin, greatest(recv_cursor, CASE WHEN peer = 'view' THEN 999 END) AS recv_cursor, last_acked_seq FROM cursors")
def cursor_upsert(spark, sf):
    now = X.cursors(spark, sf)
    news = now.filter("peer = 'view'").select("peer", "origin", F.lit(999).cast("long").alias("recv_cursor"), F.lit(1).cast("long").alias("last_acked_seq"))
    return L.advance_cursors(now, news)


@query(f"{X.OPS}, {X.CURSORS} SELECT p.peer, o.peer AS origin, coalesce(c.recv_cursor, 0) AS recv_cursor FROM peers p CROSS JOIN peers o LEFT JOIN cursors c ON c.peer = p.peer AND c.origin = o.peer")
def cursor_values(spark, sf):
    pairs = spark.createDataFrame([(a, b) for a in X.ORIGINS for b in X.ORIGINS], "peer string, origin string")
    return L.cursor_values(pairs, X.cursors(spark, sf), "recv_cursor").select("peer", "origin", "recv_cursor")


@query(f"{X.OPS} SELECT op_id, CASE WHEN user_id % 4 = 0 THEN 'foreign' WHEN origin_seq > 300 THEN 'beyond' ELSE 'ok' END AS verdict FROM ops")
def ack_bounds(spark, sf):
    acks = X.ops(spark, sf).select("op_id", "origin", F.when(F.col("user_id") % 4 == 0, "other").otherwise(F.col("origin")).alias("ack_origin"), F.col("origin_seq").alias("up_to_seq"), F.lit(300).alias("sent_seq"))
    return L.split_acks(acks).select("op_id", "verdict")


@query(f"{X.OPS} SELECT op_id, CASE WHEN event_id % 6 = 0 THEN {X.dig(chr(39) + 'uuid-of' + chr(39), 'path')}[1:32] ELSE 'known' END AS uuid FROM ops")
def uuid_backfill(spark, sf):
    return L.backfill_uuid(X.ops(spark, sf).withColumn("uuid", F.when(F.col("event_id") % 6 != 0, "known"))).select("op_id", "uuid")


@query(
    "WITH w AS (SELECT DISTINCT sha256(props) AS hash, min(event_type) AS origin FROM events GROUP BY props), p AS (SELECT DISTINCT sha256(props) AS hash, event_type AS peer FROM events) "
    "SELECT hash, peer, row_number() OVER (PARTITION BY hash ORDER BY CASE WHEN peer <> origin THEN 1 ELSE 0 END, peer) AS rank FROM w JOIN p USING (hash)"
)
def fetch_sources(spark, sf):
    e = X.events(spark, sf).select(F.sha2("props", 256).alias("hash"), "event_type")
    return L.fetch_sources(e.groupBy("hash").agg(F.min("event_type").alias("origin")), e.select("hash", F.col("event_type").alias("peer")).distinct()).select("hash", "peer", "rank")


_ANSWER = "CASE WHEN event_id % 37 = 0 THEN 'found' WHEN user_id % 2 = 0 THEN 'missing' ELSE 'busy' END"


@query(f"SELECT user_id AS hash, CASE WHEN bool_or(a = 'found') THEN 'found' WHEN bool_and(a = 'missing') THEN 'permanent' ELSE 'transient' END AS outcome FROM (SELECT user_id, {_ANSWER} AS a FROM events) GROUP BY user_id")
def acquisition(spark, sf):
    return L.acquisition(X.events(spark, sf).select(F.col("user_id").alias("hash"), F.expr(_ANSWER).alias("answer")))


# Hierarchical digests.

_LEAF = X.dig("'leaf'", "path", "CASE WHEN tombstone THEN 1 ELSE 0 END", "content_hash", "uuid", "meta_hash", "vv")


def _tree(name: str, where: str) -> str:
    """SQL of the levels of an index with paths of three parts."""
    part = f"{X.fld('name')} || {X.fld('d')} || {X.fld('hash')}"
    total = f"sha256('3:dir' || string_agg({part}, '' ORDER BY name, d))"
    return f"""{X.winners(name, where=where)}, {name}_t AS (SELECT *, {X.VV_TEXT} AS vv FROM {name}), {name}_l AS (SELECT path, {_LEAF} AS hash FROM {name}_t),
{name}_2 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS prefix, regexp_extract(path, '([^/]*)$', 1) AS name, 0 AS d, hash, 2 AS depth FROM {name}_l),
{name}_1 AS (SELECT 'u' AS prefix, prefix[3:] AS name, 1 AS d, {total} AS hash, 1 AS depth FROM {name}_2 GROUP BY {name}_2.prefix),
{name}_0 AS (SELECT '' AS prefix, 'u' AS name, 1 AS d, {total} AS hash, 0 AS depth FROM {name}_1), {name}_tree AS (SELECT * FROM {name}_2 UNION ALL SELECT * FROM {name}_1 UNION ALL SELECT * FROM {name}_0)"""


_A, _B = _tree("a", "event_id % 7 <> 0"), _tree("b", "event_id % 5 <> 0")


@query(f"{X.OPS}, {_A} SELECT path, hash FROM a_l")
def merkle_leaves(spark, sf):
    return M.leaves(X.replica(spark, sf, 7))


@query(f"{X.OPS}, {_A} SELECT prefix, name, d = 1 AS is_dir, hash, depth FROM a_tree")
def merkle_levels(spark, sf):
    return M.levels(X.replica(spark, sf, 7))


@query(f"{X.OPS}, {_A} SELECT sha256('3:dir' || {X.fld('name')} || {X.fld('d')} || {X.fld('hash')}) AS root FROM a_0")
def merkle_root(spark, sf):
    return M.root(M.levels(X.replica(spark, sf, 7)))


@query(f"{X.OPS}, {_A}, {_B} SELECT a_l.path, a_l.hash, b_l.hash AS local_hash FROM a_l LEFT JOIN b_l ON a_l.path = b_l.path WHERE a_l.hash IS DISTINCT FROM b_l.hash")
def merkle_diff(spark, sf):
    return M.diff(M.levels(X.replica(spark, sf, 7)), M.levels(X.replica(spark, sf, 5)))


_PAGES = (("", "", 5), ("u", "", 3), ("u", "4", 5), ("u", "4", 2))


@query(
    f"{X.OPS}, {_A} "
    + " UNION ALL ".join(f"(SELECT {n} AS page, prefix, name, d = 1 AS is_dir, hash, count(*) OVER () > {limit} AS more FROM a_tree WHERE prefix = '{prefix}' AND name > '{after}' QUALIFY row_number() OVER (ORDER BY name, d) <= {limit})" for n, (prefix, after, limit) in enumerate(_PAGES))
)
def children_page(spark, sf):
    tree = settle(M.levels(X.replica(spark, sf, 7)), "tree")
    pages = [M.children_page(tree, *asked).select(F.lit(n).alias("page"), "*") for n, asked in enumerate(_PAGES)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


_REL = f"CASE WHEN b.path IS NULL OR {X.above('a', 'b')} THEN 'apply' WHEN {X.above('b', 'a')} OR ({_EQ}) THEN 'ignore' ELSE 'concurrent' END"


@query(f"{X.OPS}, {_A}, {_B}, d AS (SELECT {_REL} AS r FROM a LEFT JOIN b ON a.path = b.path JOIN a_l ON a_l.path = a.path LEFT JOIN b_l ON b_l.path = a.path WHERE a_l.hash IS DISTINCT FROM b_l.hash) SELECT count(*) AS leaves, count_if(r = 'apply') AS apply, count_if(r = 'concurrent') AS concurrent, count_if(r = 'ignore') AS ignore FROM d")
def reconcile_report(spark, sf):
    return M.report(X.replica(spark, sf, 7), X.replica(spark, sf, 5))


_OF = {x: ", ".join(f"{x}.{c} AS {x}_{c}" for c in (*ROW[1:], "naming_hash", *X.COUNTERS)) for x in "ab"}
_KEY = {x: f"(CASE WHEN {x}_tombstone THEN 0 ELSE 1 END, coalesce({x}_content_hash, repeat('0', 64)), {x}_meta_hash)" for x in "ab"}
_PEAKS = ", ".join(f"greatest(a_{c}, coalesce(b_{c}, 0)) AS {c}" for c in X.COUNTERS)
_TAKE = f"r = 'apply' OR {_KEY['a']} >= {_KEY['b']}"


@query(
    f"{X.OPS}, {_A}, {_B}, met AS (SELECT a.path, {_REL} AS r, {_OF['a']}, {_OF['b']} FROM a LEFT JOIN b ON a.path = b.path JOIN a_l ON a_l.path = a.path LEFT JOIN b_l ON b_l.path = a.path WHERE a_l.hash IS DISTINCT FROM b_l.hash), "
    f"put AS (SELECT path, {', '.join(f'CASE WHEN {_TAKE} THEN a_{c} ELSE b_{c} END AS {c}' for c in ROW[1:])}, {_PEAKS} FROM met WHERE r <> 'ignore'), "
    f"lost AS (SELECT path, {', '.join(f'CASE WHEN {_TAKE} THEN b_{c} ELSE a_{c} END AS {c}' for c in (*ROW[1:], 'naming_hash'))} FROM met WHERE r = 'concurrent' AND {_KEY['a']} <> {_KEY['b']}), "
    f"named AS (SELECT *, path || '.{D.MARKER}-' || {X.dig('content_hash', 'naming_hash')}[1:16] AS copy_path FROM lost WHERE NOT tombstone AND content_hash IS NOT NULL), "
    f"kept AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY copy_path ORDER BY content_hash DESC, meta_hash DESC) = 1) "
    f"SELECT {SHOWN} FROM put UNION ALL SELECT {SHOWN} FROM b WHERE path NOT IN (SELECT path FROM put) "
    f"UNION ALL SELECT copy_path, false, content_hash, meta_hash, mode, size, {X.dig(chr(39) + 'copy' + chr(39), 'copy_path')}[1:32], {_ORIGIN}[1:32] || ':1' FROM kept"
)
def reconcile_apply(spark, sf):
    return shown(M.reconcile(X.replica(spark, sf, 5), X.replica(spark, sf, 7)))


@query(
    f"{X.OPS}, {_A}, {_B}, un AS (SELECT x.* FROM a_tree x LEFT JOIN b_tree y ON x.prefix = y.prefix AND x.name = y.name AND x.d = y.d WHERE x.hash IS DISTINCT FROM y.hash) "
    "SELECT CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END + count_if(d = 1) AS BIGINT) AS listings, count_if(d = 0) AS leaves FROM un"
)
def reconcile_listings(spark, sf):
    return M.listings(M.levels(X.replica(spark, sf, 7)), M.levels(X.replica(spark, sf, 5)))


# Content plane.


@query(f"{X.CHUNKS} SELECT file, idx, hash, len FROM hashed")
def fixed_chunks(spark, sf):
    return X.chunks(spark, sf).select("file", "idx", "hash", "len")


@query(f"{X.CHUNKS} SELECT file, count(*) AS chunk_count, CAST(sum(len) AS BIGINT) AS total_len FROM hashed GROUP BY file")
def manifest_totals(spark, sf):
    return C.manifests(X.chunks(spark, sf))


@query(f'{X.CHUNKS} SELECT file, idx, len, CAST(coalesce(sum(len) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM hashed')
def manifest_offsets(spark, sf):
    return C.offsets(X.chunks(spark, sf)).select("file", "idx", "len", "offset")


@query(f"{X.CHUNKS} SELECT file, count(*) AS chunk_count, string_agg(hash, ',' ORDER BY idx) AS hashes FROM hashed GROUP BY file HAVING count(CASE WHEN NOT (file % 10 = 3 AND idx = 1) THEN 1 END) = count(*)")
def complete_manifests(spark, sf):
    all_ = X.chunks(spark, sf)
    found = C.complete(C.manifests(all_).select("file", "chunk_count"), all_.filter("NOT (file % 10 = 3 AND idx = 1)"))
    return found.select("file", "chunk_count", F.array_join(F.transform("chunks", lambda c: c["hash"]), ",").alias("hashes"))


@query(f"{X.CHUNKS} SELECT file, idx, hash FROM hashed WHERE file = 0 AND idx >= 2 AND idx < 7")
def manifest_page(spark, sf):
    return C.manifest_page(X.chunks(spark, sf), 0, 2, 5).select("file", "idx", "hash")


@query(f"{X.CHUNKS} SELECT DISTINCT hash, len FROM hashed WHERE hash NOT IN (SELECT hash FROM hashed WHERE file % 2 = 0)")
def missing_chunks(spark, sf):
    return C.missing(X.chunks(spark, sf), X.have(spark, sf))


@query(f"{X.CHUNKS}, u AS (SELECT hash, max(len) AS len, bool_or(file % 2 = 0) AS here FROM hashed GROUP BY hash) SELECT count_if(here) AS hits, count_if(NOT here) AS fetches, CAST(coalesce(sum(CASE WHEN NOT here THEN len END), 0) AS BIGINT) AS fetch_bytes FROM u")
def fetch_plan(spark, sf):
    return C.fetch_plan(X.chunks(spark, sf), X.have(spark, sf))


@query(f"{X.CHUNKS} SELECT count(*) AS n_refs, count(DISTINCT hash) AS n_distinct, CAST(sum(len) AS BIGINT) AS ref_bytes, (SELECT CAST(sum(len) AS BIGINT) FROM (SELECT DISTINCT hash, len FROM hashed)) AS stored_bytes FROM hashed")
def dedup_stats(spark, sf):
    return C.dedup_stats(X.chunks(spark, sf))


@query(f"{X.CHUNKS} SELECT count(*) AS n_chunks, CAST(sum(len) AS BIGINT) AS n_bytes FROM (SELECT DISTINCT hash, len FROM hashed WHERE file % 2 = 0)")
def cas_stats(spark, sf):
    return C.store_stats(X.have(spark, sf))


@query(f"{X.CHUNKS} SELECT DISTINCT hash, len FROM hashed WHERE file % 3 = 0 AND hash NOT IN (SELECT hash FROM hashed WHERE file % 2 = 0)")
def store_chunks(spark, sf):
    new = X.chunks(spark, sf).filter("file % 3 = 0").select("hash", "len", "body")
    forged = new.withColumn("hash", F.reverse("hash"))
    return C.store(X.have(spark, sf), new.unionByName(forged)).select("hash", "len")


@query(f"{X.CHUNKS} SELECT count_if(file % 4 = 0) AS corrupt, count_if(file % 4 <> 0) AS sound FROM hashed")
def store_verification(spark, sf):
    held = X.chunks(spark, sf).withColumn("body", F.when(F.col("file") % 4 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return C.verify_store(held).agg(F.count_if("corrupt").alias("corrupt"), F.count_if(~F.col("corrupt")).alias("sound"))


@query("SELECT doc_id AS file, sha256(text) AS hash FROM documents WHERE length(text) > 0")
def assemble(spark, sf):
    all_ = X.chunks(spark, sf)
    return C.assemble(all_, all_.select("hash", "body").dropDuplicates(["hash"])).select("file", F.sha2("content", 256).alias("hash"))


@query(f"{X.CHUNKS}, r AS (SELECT *, sum(len) OVER (PARTITION BY file ORDER BY idx) AS running FROM (SELECT file, idx, CASE WHEN file % 7 = 0 AND idx = 2 THEN 0 ELSE len END AS len FROM hashed)) SELECT file, CASE WHEN bool_or(len <= 0 OR len > 256) THEN 'bad_size' WHEN bool_or(running > 5000) THEN 'too_large' ELSE 'ok' END AS verdict FROM r GROUP BY file")
def manifest_validation(spark, sf):
    odd = X.chunks(spark, sf).withColumn("len", F.when((F.col("file") % 7 == 0) & (F.col("idx") == 2), 0).otherwise(F.col("len")))
    return C.validate_manifest(odd, 256, 5000)


_BUCKETS = "(SELECT hash[1:2] AS bucket, sha256(string_agg(line, '' ORDER BY line)) AS h FROM (SELECT sha256(text) AS hash, sha256(text) || '  ' || doc_id || chr(10) AS line FROM documents) GROUP BY 1)"


@query(f"SELECT sha256(string_agg(h, '' ORDER BY bucket)) AS digest FROM {_BUCKETS}")
def tree_digest(spark, sf):
    return C.tree_digest(X.files(spark, sf).select("file", F.sha2("content", 256).alias("hash")))


@query()
def fastcdc_chunks(spark, sf):
    whole = X.files(spark, sf).select("file", F.encode("content", "UTF-8").alias("content"))
    return C.content_chunks(whole, 256, 1024, 4096).select("file", "idx", "len", "hash")


# Membership.


@query(f"{X.ROSTER} SELECT * FROM won")
def roster_winners(spark, sf):
    return N.winners(X.roster(spark, sf))


@query(f"{X.ROSTER} SELECT sha256('roster' || string_agg(content_hash, '' ORDER BY node)) AS digest FROM won")
def roster_digest(spark, sf):
    return N.roster_digest(N.winners(X.roster(spark, sf)))


@query(f"{X.ROSTER} SELECT node, addr, fingerprint, epoch, kind, content_hash FROM won")
def roster_merge(spark, sf):
    all_ = X.roster(spark, sf)
    return N.merge(all_.filter("epoch > 2"), all_.filter("epoch <= 3"))


@query(f"{X.ROSTER} SELECT node, addr, fingerprint, epoch FROM won WHERE kind = 'add'")
def live_members(spark, sf):
    return N.live_members(N.winners(X.roster(spark, sf))).select("node", "addr", "fingerprint", "epoch")


_EFFECTIVE = "effective AS (SELECT coalesce(s.node, w.node) AS node, coalesce(w.addr, s.addr) AS addr, coalesce(w.fingerprint, s.fingerprint) AS fingerprint FROM seeded s FULL JOIN won w ON s.node = w.node WHERE coalesce(s.node, w.node) <> '03' AND coalesce(w.kind, 'add') <> 'remove')"


@query(f"{X.ROSTER}, {_EFFECTIVE} SELECT * FROM effective")
def effective_peers(spark, sf):
    return N.effective_peers(X.seeds(spark), N.winners(X.roster(spark, sf)), "03")


@query(f"{X.ROSTER}, n AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS node FROM range(25) r(i)) SELECT node, coalesce(epoch, 0) + 1 AS next_epoch FROM n LEFT JOIN won USING (node)")
def next_epoch(spark, sf):
    nodes = spark.range(25).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("node"))
    return N.next_epoch(N.winners(X.roster(spark, sf)), nodes)


@query(f"{X.ROSTER}, {_EFFECTIVE} SELECT node, CAST(node AS INT) % 3 = 0 AS connected FROM effective")
def peer_views(spark, sf):
    peers = N.effective_peers(X.seeds(spark), N.winners(X.roster(spark, sf)), "03")
    return N.peer_views(peers, X.roster(spark, sf).filter("cast(node AS int) % 3 = 0")).select("node", "connected")


@query(f"{X.ROSTER}, {_EFFECTIVE} SELECT e.node FROM keyed k JOIN effective e USING (fingerprint)")
def peer_by_fingerprint(spark, sf):
    peers = N.effective_peers(X.seeds(spark), N.winners(X.roster(spark, sf)), "03")
    return N.peer_of(X.roster(spark, sf).select("fingerprint"), peers).select("node")


@query(f"{X.ROSTER}, {_EFFECTIVE} SELECT coalesce(e.node, s.node) AS node, CASE WHEN s.addr IS NULL THEN 'start' WHEN e.addr IS NULL THEN 'stop' WHEN e.addr <> s.addr OR e.fingerprint <> s.fingerprint THEN 'restart' ELSE 'keep' END AS action FROM effective e FULL JOIN seeded s ON e.node = s.node")
def link_changes(spark, sf):
    return N.link_changes(N.effective_peers(X.seeds(spark), N.winners(X.roster(spark, sf)), "03"), X.seeds(spark))


_LIFE = "SELECT user_id AS node, event_id AS peer, CASE event_type WHEN 'click' THEN 'expected' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'unreachable' ELSE 'seen' END AS event FROM events"


@query(
    f"WITH v AS ({_LIFE}), p AS (SELECT node, peer, bool_or(event = 'expected') AS e, bool_or(event IN ('completed', 'unreachable')) AS s FROM v GROUP BY ALL) "
    "SELECT node, count_if(e) AS expected, count_if(e AND s) AS settled, CASE WHEN bool_and(NOT e OR s) THEN 'active' WHEN bool_or(s) THEN 'syncing' ELSE 'joining' END AS state FROM p GROUP BY node"
)
def lifecycle(spark, sf):
    e = X.events(spark, sf).selectExpr("user_id AS node", "event_id AS peer", "CASE event_type WHEN 'click' THEN 'expected' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'unreachable' ELSE 'seen' END AS event")
    return N.lifecycle(e)


# Ingest.

_DISK = "disk AS (SELECT path, CASE WHEN u % 17 = 0 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash FROM (SELECT *, CAST(regexp_extract(path, '([^/]*)$', 1) AS BIGINT) AS u FROM w WHERE NOT tombstone) WHERE u % 13 <> 0)"


@query(f"{X.OPS}, {X.winners('w')}, {_DISK} SELECT path, 'write' AS kind, content_hash FROM disk UNION ALL SELECT path, 'delete', NULL FROM w WHERE NOT tombstone AND path NOT IN (SELECT path FROM disk)")
def scan_diff(spark, sf):
    return I.scan_diff(X.disk(spark, sf), R.current_state(X.ops(spark, sf)))


@query(
    "WITH e AS (SELECT event_id, 'u/' || user_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS kind, epoch_us(ts) AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY path ORDER BY t, event_id) AS nxt FROM e) "
    "SELECT event_id, path FROM n WHERE kind = 'write' AND coalesce(nxt, 1900000000000000) - t >= 3600000000"
)
def debounce(spark, sf):
    e = X.events(spark, sf).select("event_id", F.concat(F.lit("u/"), "user_id").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("kind"), "t")
    return I.debounce(e, 3_600_000_000, 1_900_000_000_000_000).select("event_id", "path")


_FEED = "SELECT event_id, CASE WHEN event_type = 'click' THEN 'rename' WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS kind, CASE WHEN event_id % 3 = 0 THEN '/out/' ELSE '/share/' END || user_id AS old, CASE WHEN event_id % 4 = 0 THEN '/out/' WHEN event_id % 10 = 1 THEN '/share/.staging-' ELSE '/share/d/' END || event_id AS new FROM events"


@query(
    f"WITH f AS ({_FEED}), r AS (SELECT event_id, kind, CASE WHEN starts_with(old, '/share/') THEN old[8:] END AS o, CASE WHEN starts_with(new, '/share/') THEN new[8:] END AS n FROM f), "
    "k AS (SELECT event_id, CASE WHEN kind = 'rename' AND o IS NOT NULL AND n IS NOT NULL THEN 'rename' WHEN kind = 'rename' AND o IS NOT NULL THEN 'delete' WHEN kind = 'rename' THEN 'write' ELSE kind END AS kind, CASE WHEN kind = 'rename' AND o IS NOT NULL AND n IS NULL THEN o ELSE n END AS path, CASE WHEN kind = 'rename' AND o IS NOT NULL AND n IS NOT NULL THEN o END AS path_old FROM r) "
    "SELECT event_id, kind, path, path_old FROM k WHERE path IS NOT NULL AND NOT contains(regexp_extract(path, '([^/]*)$', 1), '.staging-')"
)
def feed_normalization(spark, sf):
    X.events(spark, sf).createOrReplaceTempView("tidemark_events")
    return I.normalize_events(spark.sql(_FEED.replace("FROM events", "FROM tidemark_events")), "/share").select("event_id", "kind", "path", "path_old")


@query(f"{X.OPS}, {X.winners('w')}, {_DISK}, ev AS (SELECT path, op_type AS kind, op_id FROM ops) SELECT op_id, kind FROM ev WHERE NOT (kind = 'delete' AND path IN (SELECT path FROM disk))")
def delete_recheck(spark, sf):
    e = X.ops(spark, sf).select("op_id", "path", F.col("op_type").alias("kind"))
    return I.recheck_deletes(e, X.disk(spark, sf)).select("op_id", "kind")


TTL = 90_000_000_000
#: Registrations come from every third event, some for other content and some long before it; several at a time fall on one path.
SUPPRESSED = (
    f"{X.OPS}, marks AS (SELECT path, op_type AS kind, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE content_hash END AS content_hash, t - CASE WHEN event_id % 2 = 0 THEN {2 * TTL} ELSE 1000 END AS t, 0 AS is_event, CAST(NULL AS BIGINT) AS event_id FROM ops WHERE event_id % 3 = 0), "
    "mixed AS (SELECT * FROM marks UNION ALL SELECT path, op_type, content_hash, t, 1, event_id FROM ops), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, is_event, kind, coalesce(content_hash, ''), event_id) AS n FROM mixed), "
    "told AS (SELECT *, max(CASE WHEN is_event = 0 THEN n END) OVER (PARTITION BY path ORDER BY n) AS last FROM ranked), "
    f"hits AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.path, e.last ORDER BY e.t, e.event_id) AS k FROM told e JOIN ranked m ON m.path = e.path AND m.n = e.last WHERE e.is_event = 1 AND e.kind = m.kind AND (e.kind = 'delete' OR e.content_hash IS NOT DISTINCT FROM m.content_hash) AND e.t - m.t < {TTL}) "
    "SELECT event_id FROM ops WHERE event_id NOT IN (SELECT event_id FROM hits WHERE k = 1)"
)


def suppressible(spark, sf):
    """Events, and registrations of every third of them."""
    e = X.ops(spark, sf).select("path", F.col("op_type").alias("kind"), "content_hash", "t", "event_id")
    early = F.when(F.col("event_id") % 2 == 0, F.lit(2 * TTL)).otherwise(F.lit(1000))
    marks = e.filter("event_id % 3 = 0").select("path", "kind", F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("t") - early).alias("at"))
    return e, marks


@query(SUPPRESSED)
def suppression(spark, sf):
    return I.suppress(*suppressible(spark, sf), TTL).select("event_id")


_PATHS = ("a/b.txt", "", "/abs", "a/../b", "./a", "a//b", "..", "a/.", "dir.d/file", ".bashrc", "x.tar.gz", "a/.staging-1", "n.", "deep/er/.hid.den", "a/b.conflict-0123456789abcdef.txt")
_VALUES = ", ".join(f"('{p}')" for p in _PATHS)


@query(f"SELECT p AS path, length(p) > 0 AND NOT starts_with(p, '/') AND len(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.')) > 0 AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM (VALUES {_VALUES}) v(p)")
def safe_paths(spark, sf):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", P.is_safe_path(F.col("path")).alias("safe"))


_EXT = r"'^(.+)(\.[^.]*)$'"
_NAME = "regexp_extract(p, '^(.*/)?([^/]*)$', 2)"


@query(f"SELECT p AS path, regexp_extract(p, '^(.*/)?([^/]*)$', 1) || CASE WHEN regexp_matches({_NAME}, {_EXT}) THEN regexp_extract({_NAME}, {_EXT}, 1) ELSE {_NAME} END || '.{D.MARKER}-' || {X.dig(chr(39) + 'c' + chr(39), chr(39) + 'n' + chr(39))}[1:16] || CASE WHEN regexp_matches({_NAME}, {_EXT}) THEN regexp_extract({_NAME}, {_EXT}, 2) ELSE '' END AS copy_path, contains(p, '.{D.MARKER}-') AS is_copy FROM (VALUES {_VALUES}) v(p)")
def copy_paths(spark, sf):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", D.copy_path(F.col("path"), F.lit("c"), F.lit("n")).alias("copy_path"), P.is_copy(F.col("path")).alias("is_copy"))


@query("SELECT o_orderkey, CAST(o_orderkey % 1000 AS BIGINT) * CASE o_orderkey % 4 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 1 END AS rate, CASE WHEN o_orderkey % 30 < 24 OR (o_orderkey % 30 = 24 AND o_orderkey % 60 = 0) THEN CAST((o_orderkey % 30) * 60 + o_orderkey % 60 AS INT) END AS minute, CASE WHEN o_totalprice * 3 <= 262144 THEN 'priority' ELSE 'bulk' END AS lane FROM orders")
def scalar_functions(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    rate = F.concat((k % 1000).cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "m", "g"))), (k % 4 + 1).cast("int")))
    clock = F.concat((k % 30).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    return o.select("o_orderkey", S.rate(rate).alias("rate"), S.minute_of_day(clock).alias("minute"), S.lane(F.col("o_totalprice") * 3).alias("lane"))


# Policy and monitoring.

_RULES = ((0, ["weekday"], 540, 1020, 100, 10), (1, ["tue", "sat"], 1320, 360, 900, 90), (2, ["weekend", "fri"], 0, 1440, 500, 50), (3, ["mon"], 0, 60, 50, 0), (4, ["all"], 300, 300, 1, 1), (5, ["all"], 1380, 30, 0, 5))
_RULE_SQL = ", ".join(f"({i}, {d}, {a}, {b}, {g}, {p})" for i, d, a, b, g, p in _RULES)
_RATED = (
    f"rules(rule_idx, days, b, e, g, p) AS (VALUES {_RULE_SQL}), m AS (SELECT s.*, rule_idx, g, p FROM s LEFT JOIN rules ON (list_contains(days, 'all') OR (list_contains(days, 'weekend') AND day IN (0, 6)) OR (list_contains(days, 'weekday') AND day NOT IN (0, 6)) OR list_contains(days, ['sun', 'mon', 'tue', 'wed', 'thu', 'fri', 'sat'][day + 1])) "
    "AND CASE WHEN b <= e THEN minute >= b AND minute < e ELSE minute >= b OR minute < e END), rated AS (SELECT slot, day, minute, coalesce(min_by(g, rule_idx), 7) AS global_rate, coalesce(min_by(p, rule_idx), 3) AS peer_rate FROM m GROUP BY ALL)"
)


def rules(spark):
    return spark.createDataFrame(list(_RULES), "rule_idx int, days array<string>, begin int, end int, global_rate int, peer_rate int")


@query(f"WITH s AS (SELECT DISTINCT epoch_us(ts) // 60000000 AS slot, CAST(epoch_us(ts) // 86400000000 % 7 AS INT) AS day, CAST(epoch_us(ts) // 60000000 % 1440 AS INT) AS minute FROM events), {_RATED} SELECT * FROM rated")
def schedule_rates(spark, sf):
    slots = X.events(spark, sf).select(F.floor(F.col("t") / 60_000_000).alias("slot"), (F.floor(F.col("t") / 86_400_000_000) % 7).cast("int").alias("day"), (F.floor(F.col("t") / 60_000_000) % 1440).cast("int").alias("minute"))
    return Q.scheduled_rates(slots.distinct(), rules(spark), (7, 3))


@query(
    "WITH tick AS (SELECT user_id AS node, event_id AS slot, CAST(event_id % 7 AS INT) AS day, CAST(event_id * 37 % 1440 AS INT) AS minute, value > 5 AS has_space, CASE event_type WHEN 'purchase' THEN 'pause' WHEN 'signup' THEN 'resume' END AS said FROM events), "
    f"s AS (SELECT DISTINCT slot, day, minute FROM tick), {_RATED}, k AS (SELECT *, count(said) OVER (PARTITION BY node ORDER BY slot) AS g FROM tick), h AS (SELECT *, max(said) OVER (PARTITION BY node, g) AS told FROM k) "
    "SELECT node, slot, CASE WHEN told = 'pause' THEN 'operator' WHEN NOT has_space THEN 'guard' ELSE 'none' END AS paused, global_rate, peer_rate FROM h JOIN rated USING (slot)"
)
def policy_ticks(spark, sf):
    said = F.when(F.col("event_type") == "purchase", "pause").when(F.col("event_type") == "signup", "resume")
    ticks = X.events(spark, sf).select(F.col("user_id").alias("node"), F.col("event_id").alias("slot"), (F.col("event_id") % 7).cast("int").alias("day"), (F.col("event_id") * 37 % 1440).cast("int").alias("minute"), (F.col("value") > 5).alias("has_space"), said.alias("said"))
    return Q.policy_ticks(ticks, rules(spark), (7, 3)).select("node", "slot", "paused", "global_rate", "peer_rate")


@query("WITH m AS (SELECT user_id AS key, event_id AS t, value > 3 AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t) AS i FROM m) SELECT key, count(*) AS length, min(t) AS begin, max(t) AS \"end\" FROM g WHERE f GROUP BY key, i HAVING count(*) >= 3")
def streaks(spark, sf):
    return Q.streaks(X.events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("t"), "value"), F.col("value") > 3, 3)


@query("WITH l AS (SELECT user_id AS key, event_id AS t, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id), false) AS f FROM events), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY t) AS i FROM l) SELECT key, count(*) AS length, min(t) AS begin, max(t) AS \"end\" FROM g WHERE f GROUP BY key, i HAVING count(*) >= 3")
def rising_streaks(spark, sf):
    return Q.rising_streaks(X.events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("t"), "value"), "value", 3)


@query("SELECT value AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) AS n, count(*) OVER () AS c FROM events) WHERE n = least(c * 95 // 100, c - 1) + 1")
def p95(spark, sf):
    return Q.p95(X.events(spark, sf), "value")


@query("SELECT user_id AS key, median(value) AS median FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 10 GROUP BY user_id")
def early_median(spark, sf):
    return Q.early_median(X.events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("t"), "value"), "value")


@query("SELECT user_id AS key, event_id AS t, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def hourly_deltas(spark, sf):
    return Q.deltas(X.events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("t")), "t").select("key", "t", "delta")


@query("SELECT o_orderkey, coalesce(o_totalprice - greatest(20000.0, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * 2 END * 10.0 / 100) >= o_orderkey % 50000, false) AND o_orderkey % 9 <> 0 AS admitted FROM orders")
def space_guard(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("available"), (F.col("o_totalprice") * 2).alias("capacity"), (F.col("o_orderkey") % 50000).alias("incoming"))
    return Q.space_guard(o, 20_000, 10.0).select("o_orderkey", "admitted")


def _bucket(name: str, source: str, key: str, rate: int, t: str = "t") -> str:
    """SQL of a token bucket: (…, wait) of the requests of source."""
    w = f"PARTITION BY {key} ORDER BY {t}, seq"
    return (
        f"{name}_a AS (SELECT *, coalesce({t} - lag({t}) OVER ({w}), 0)::HUGEINT * {rate} - amount::HUGEINT * 1000000 AS step FROM {source}), {name}_b AS (SELECT *, sum(step) OVER ({w} ROWS UNBOUNDED PRECEDING) AS total FROM {name}_a), "
        f"{name}_c AS (SELECT *, total + min({rate * 1_000_000}::HUGEINT - amount::HUGEINT * 1000000 - total) OVER ({w} ROWS UNBOUNDED PRECEDING) AS rest FROM {name}_b), {name} AS (SELECT * EXCLUDE (step, total, rest), greatest(0.0, -CAST(rest AS DOUBLE) / {float(rate * 1_000_000)!r}::DOUBLE) AS wait FROM {name}_c)"
    )


_REQUESTS = "r AS (SELECT user_id % 7 AS peer, epoch_us(ts) AS t, event_id AS seq, CAST(length(props) * 1000 AS BIGINT) AS amount FROM events)"


def requests(spark, sf):
    return X.events(spark, sf).select((F.col("user_id") % 7).alias("peer"), "t", F.col("event_id").alias("seq"), (F.length("props") * 1000).cast("long").alias("amount"))


@query(f"WITH {_REQUESTS}, {_bucket('w', 'r', 'peer', 15)} SELECT peer AS key, seq, wait FROM w")
def token_bucket(spark, sf):
    return Q.token_bucket(requests(spark, sf).withColumnRenamed("peer", "key"), 15, ticks=1_000_000).select("key", "seq", "wait")


@query(f"WITH {_REQUESTS}, {_bucket('g', 'r', '0', 70)}, s AS (SELECT peer, t + CAST(ceil(wait * 1000000) AS BIGINT) AS t, seq, amount, wait AS global_wait FROM g), {_bucket('p', 's', 'peer', 12)} SELECT peer, seq, global_wait, wait AS peer_wait FROM p")
def two_level_rates(spark, sf):
    return Q.two_buckets(requests(spark, sf), 70, 12).select("peer", "seq", "global_wait", "peer_wait")


@query()
def backoff_delays(spark, sf):
    return Q.backoff(spark.range(12).select(F.col("id").cast("double").alias("n")), 42)


@query("SELECT event_type AS error, count(*) AS n, CASE WHEN event_type IN ('too_large') THEN 'quarantine' WHEN event_type = 'none' THEN 'ok' ELSE 'retry' END AS route FROM (SELECT CASE event_type WHEN 'error' THEN 'too_large' WHEN 'click' THEN 'none' ELSE event_type END AS event_type FROM events) GROUP BY event_type")
def quarantine_split(spark, sf):
    e = X.events(spark, sf).select(F.when(F.col("event_type") == "error", "too_large").when(F.col("event_type") == "click", "none").otherwise(F.col("event_type")).alias("error"))
    return W.quarantine_split(e).groupBy("error", "route").agg(F.count(F.lit(1)).alias("n"))


_CONF_A = {"log_level": "info", "chunk_avg": "16384", "ingress_rate": "10m", "share": "/s", "old_key": "1"}
_CONF_B = {"log_level": "debug", "chunk_avg": "32768", "ingress_rate": "10m", "share": "/s", "new_key": "2"}


def _pairs(d: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@query(f"WITH a(name, old) AS (VALUES {_pairs(_CONF_A)}), b(name, new) AS (VALUES {_pairs(_CONF_B)}) SELECT name, old, new, CASE WHEN name IN {W.HOT} THEN 'reload' ELSE 'restart' END AS needs FROM a FULL JOIN b USING (name) WHERE old IS DISTINCT FROM new")
def config_diff(spark, sf):
    make = lambda d: spark.createDataFrame(list(d.items()), "name string, value string")
    return W.config_diff(make(_CONF_A), make(_CONF_B))


@query(f"{X.OPS}, {X.winners('w')} SELECT content_hash, min(path) AS path FROM w WHERE NOT tombstone GROUP BY content_hash")
def path_for_hash(spark, sf):
    return W.path_for_hash(R.current_state(X.ops(spark, sf)))


_WITH_COPIES = f"{_COPIES}, held AS (SELECT path, tombstone, content_hash, size FROM w UNION ALL SELECT copy_path, false, content_hash, 0 FROM kept WHERE n = 1)"


def with_copies(spark, sf):
    """The current state and the conflict copies beside it."""
    found = R.candidates(X.ops(spark, sf))
    won = settle(R.winners(found), "won")
    kept = R.copies(R.antichain(found), won).select(F.col("copy_path").alias("path"), F.lit(False).alias("tombstone"), "content_hash", F.lit(0).cast("long").alias("size"))
    return won.select("path", "tombstone", "content_hash", "size").unionByName(kept)


@query(f"{_WITH_COPIES} SELECT count_if(NOT tombstone) AS live, count_if(tombstone) AS deleted, count_if(NOT tombstone AND contains(path, '.{D.MARKER}-')) AS copies, CAST(sum(CASE WHEN NOT tombstone THEN size END) AS BIGINT) AS bytes, (SELECT count(*) FROM ops) AS ops FROM held")
def status(spark, sf):
    return W.status(with_copies(spark, sf), X.ops(spark, sf))


@query(f"{_WITH_COPIES} SELECT path, content_hash FROM held WHERE NOT tombstone AND contains(path, '.{D.MARKER}-')")
def conflict_view(spark, sf):
    return W.conflicts(with_copies(spark, sf)).select("path", "content_hash")


@query(f"{_WITH_COPIES} SELECT count_if(NOT tombstone AND contains(path, '.{D.MARKER}-')) AS copies, count_if(NOT tombstone) AS live, count_if(NOT tombstone AND contains(path, '.{D.MARKER}-')) / count_if(NOT tombstone) AS ratio FROM held")
def live_copy_ratio(spark, sf):
    return Q.live_copy_ratio(with_copies(spark, sf))


@query(f"{X.OPS}, {X.winners('w')} SELECT row_number() OVER (ORDER BY path) AS place, path, tombstone FROM w")
def all_files(spark, sf):
    ordered = R.all_files(R.current_state(X.ops(spark, sf)))
    first = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    parts = settle(ordered.select(F.spark_partition_id().alias("part"), "path", "tombstone"), "ordered")
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", before.alias("before"))
    return parts.withColumn("n", first).join(starts, "part").select((F.col("before") + F.col("n")).alias("place"), "path", "tombstone")


@query(f"{X.CHUNKS}, u AS (SELECT hash, bool_or(file % 2 = 0) AS here FROM hashed GROUP BY hash) SELECT file, count(*) AS chunks, count_if(NOT here) AS missing, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(CASE WHEN here THEN 0 ELSE len END) AS BIGINT) AS missing_bytes FROM hashed JOIN u USING (hash) GROUP BY file")
def transfers(spark, sf):
    return W.transfers(X.chunks(spark, sf), X.have(spark, sf))


@query(f"WITH v AS ({_LIFE}) SELECT node, '{{' || string_agg('\"' || event || '\":' || n, ',' ORDER BY event) || '}}' AS health FROM (SELECT node, event, count(*) AS n FROM v GROUP BY ALL) GROUP BY node")
def health(spark, sf):
    e = X.events(spark, sf).selectExpr("user_id AS node", "CASE event_type WHEN 'click' THEN 'expected' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'unreachable' ELSE 'seen' END AS name")
    return W.health(e.groupBy("node", "name").agg(F.count(F.lit(1)).alias("value")))


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS origin, count(*) AS n FROM events GROUP BY ALL")
def ops_per_hour(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("origin")).agg(F.count(F.lit(1)).alias("n"))


# Further predicates, digests and views.


@query(f"{X.OPS}, {_A} SELECT prefix, CASE WHEN count(*) > 12 THEN 'too_many' WHEN bool_or(length(name) NOT BETWEEN 1 AND 2) THEN 'bad_name' WHEN sum(length(name)) > 20 THEN 'too_large' ELSE 'ok' END AS verdict FROM a_tree GROUP BY prefix")
def listing_validation(spark, sf):
    return C.validate_listing(M.levels(X.replica(spark, sf, 7)), 12, 2, 20)


_DIGEST = "(SELECT sha256('roster' || string_agg(content_hash, '' ORDER BY node)) FROM won{})"


@query(f"{X.ROSTER} SELECT 'part' AS other, {_DIGEST.format(' WHERE node < ' + chr(39) + '10' + chr(39))} <> {_DIGEST.format('')} AS differ UNION ALL SELECT 'same', {_DIGEST.format('')} <> {_DIGEST.format('')}")
def exchange_needed(spark, sf):
    won = N.winners(X.roster(spark, sf))
    again = N.merge(X.roster(spark, sf), won)
    return N.needs_exchange(won.filter("node < '10'"), won).select(F.lit("part").alias("other"), "differ").unionByName(N.needs_exchange(again, won).select(F.lit("same").alias("other"), "differ"))


@query(f"{X.ROSTER}, known AS (SELECT node, CASE WHEN CAST(node AS INT) % 3 = 0 THEN 'active' ELSE 'syncing' END AS state FROM won WHERE CAST(node AS INT) % 2 = 0) SELECT w.node, coalesce(k.state, 'joining') AS state FROM won w LEFT JOIN known k ON w.node = k.node WHERE kind = 'add'")
def member_views(spark, sf):
    won = N.winners(X.roster(spark, sf))
    known = won.filter("cast(node AS int) % 2 = 0").select("node", F.when(F.col("node").cast("int") % 3 == 0, "active").otherwise("syncing").alias("state"))
    return N.member_views(won, known).select("node", "state")


@query(f"{X.ROSTER} SELECT node FROM won ORDER BY {X.dig('7', 'node')}, node LIMIT 1")
def peer_choice(spark, sf):
    return N.pick_peer(N.winners(X.roster(spark, sf)), 7).select("node")


@query(f"{X.ROSTER} SELECT node, epoch, kind FROM won WHERE fingerprint[1:1] < 'c'")
def verified_entries(spark, sf):
    won = N.winners(X.roster(spark, sf))
    return N.verified(won, lambda e: F.substring(e["fingerprint"], 1, 1) < "c").select("node", "epoch", "kind")


@query(f"{X.ROSTER}, {_EFFECTIVE} SELECT s_suppkey FROM supplier WHERE sha256('f' || s_name) IN (SELECT fingerprint FROM effective)")
def allowed_connections(spark, sf):
    peers = N.effective_peers(X.seeds(spark), N.winners(X.roster(spark, sf)), "03")
    asked = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.sha2(F.concat(F.lit("f"), "s_name"), 256).alias("fingerprint"))
    return N.allowed(asked, peers).select("s_suppkey")


@query(f"{X.OPS}, {X.winners('w', where='event_id % 5 <> 0')}, d AS (SELECT CASE WHEN w.path IS NULL OR {X.above('o', 'w')} THEN 'apply' WHEN {X.above('w', 'o')} OR ({' AND '.join(f'o.{c} = w.{c}' for c in X.COUNTERS)}) THEN 'ignore' ELSE 'concurrent' END AS r FROM ops o LEFT JOIN w ON o.path = w.path) SELECT count_if(r = 'apply') AS apply, count_if(r = 'ignore') AS ignore, count_if(r = 'concurrent') AS concurrent FROM d")
def engine_counters(spark, sf):
    return W.counters(R.decide(X.ops(spark, sf), X.replica(spark, sf, 5)))


@query(f"{X.OPS} SELECT op_id, op_id[1:8] AS short_id, op_id[1:2] || '/' || op_id AS cas_path, CASE op_type WHEN 'write' THEN 0 WHEN 'delete' THEN 1 END AS code, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN starts_with(path, 'u/3/') THEN path[5:] END AS below, mode & 511 AS bits FROM ops")
def path_functions(spark, sf):
    p = F.col("path")
    return X.ops(spark, sf).select("op_id", S.short_id(F.col("op_id")).alias("short_id"), S.cas_path(F.col("op_id")).alias("cas_path"), S.op_code(F.col("op_type")).alias("code"), S.parent(p).alias("parent"), S.name(p).alias("name"), S.relative(p, F.lit("u/3")).alias("below"), S.mode_bits(F.col("mode")).alias("bits"))


@query("SELECT s_suppkey, sha256(s_name) AS fingerprint FROM supplier")
def certificate_fingerprints(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", D.certificate_fingerprint(F.encode("s_name", "UTF-8")).alias("fingerprint"))


@query("SELECT event_id, CASE WHEN event_id % 40 <= 25 AND user_id % 7 <> 3 THEN 'ok' ELSE 'rejected' END AS verdict FROM events")
def size_and_path_limits(spark, sf):
    e = X.events(spark, sf).select("event_id", (F.col("event_id") % 40).alias("size"), F.when(F.col("user_id") % 7 == 3, "../x").otherwise("a/x").alias("path"))
    good, bad = I.within_limits(e, 25)
    return good.select("event_id", F.lit("ok").alias("verdict")).unionByName(bad.select("event_id", F.lit("rejected").alias("verdict")))


@query("SELECT event_id, event_type = 'click' AS own FROM events")
def push_origin_check(spark, sf):
    return X.events(spark, sf).select("event_id", P.pushed_by_origin(F.col("event_type"), F.lit("click")).alias("own"))


@query(f"{X.OPS}, {X.winners('w')} SELECT path, size FROM w WHERE NOT tombstone")
def live_files(spark, sf):
    return R.current_state(X.ops(spark, sf)).filter(P.is_live(F.col("tombstone"))).select("path", "size")


@query(f"{X.OPS}, {X.winners('w')} SELECT 'tidemark_' || op_type || ' ' || count(*) AS line FROM ops GROUP BY op_type")
def metrics_lines(spark, sf):
    return W.prometheus(op_counts(spark, sf).select(F.col("op_type").alias("name"), F.col("n").alias("value")))


@query(f"{X.OPS} SELECT op_id, NOT tombstone_ AS live, is_hex, CASE op_type WHEN 'write' THEN 'write' WHEN 'delete' THEN 'delete' END AS op_name, CAST(event_id % 7 AS INT) AS kind_code, CASE WHEN event_id % 7 IN (0, 1, 2, 3, 4) THEN true ELSE false END AS replicable, state, hex, back, hole, most FROM (SELECT *, op_type = 'delete' AS tombstone_, event_id % 5 <> 0 AS is_hex, ['joining', 'syncing', 'active'][event_id % 3 + 1] AS state, lower(hex(path)) AS hex, CASE WHEN event_id % 2 = 0 THEN path END AS back, event_id % 4 = 0 AS hole, CAST(floor(size * 1000 / 4096.0) + 2 AS BIGINT) AS most FROM ops)")
def code_functions(spark, sf):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, (*S.KINDS, "socket", "folder"))), (e % 7 + 1).cast("int"))
    text = F.when(e % 5 != 0, F.col("op_id")).otherwise(F.concat(F.substring("op_id", 1, 63), F.lit("G")))
    coded = S.to_hex(F.encode("path", "UTF-8"))
    sent = F.when(e % 2 == 0, coded).otherwise(F.concat(coded, F.lit("0")))
    data = F.when(e % 4 == 0, F.unhex(F.lit("000000"))).otherwise(F.unhex(F.lit("000100")))
    return X.ops(spark, sf).select(
        "op_id", P.is_live(F.col("op_type") == "delete").alias("live"), S.is_hex(text, 64).alias("is_hex"), S.op_name(S.op_code(F.col("op_type"))).alias("op_name"), F.coalesce(S.kind_code(kind), (e % 7).cast("int")).alias("kind_code"), P.is_replicable(kind).alias("replicable"),
        S.state_name(S.state_code(F.element_at(F.array(*map(F.lit, S.LIFECYCLE)), (e % 3 + 1).cast("int")))).alias("state"), coded.alias("hex"), F.decode(S.from_hex(sent), "UTF-8").alias("back"), S.is_hole(data).alias("hole"), S.most_chunks(F.col("size") * 1000).cast("long").alias("most"),
    )


@query(f"{X.OPS}, v AS (SELECT op_id, {X.VV_TEXT} AS vv, '4:6162' || '2:' || CASE WHEN event_id % 2 = 0 THEN '01' ELSE '02' END || '6:616263' || '0:' AS xattrs FROM ops) SELECT op_id, vv = '' AS empty, xattrs, {X.dig(chr(39) + 'name' + chr(39), chr(39) + 'regular' + chr(39), '420', 'NULL', 'NULL', 'xattrs')} AS naming FROM v")
def naming_functions(spark, sf):
    pair = lambda k, v: F.struct(F.unhex(F.lit(k)).alias("k"), v.alias("v"))
    value = F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("02")))
    xattrs = D.xattr_text(F.array(pair("616263", F.unhex(F.lit(""))), pair("6162", value)))
    return X.ops(spark, sf).select("op_id", V.is_empty(F.col("vv")).alias("empty"), xattrs.alias("xattrs")).withColumn("naming", D.naming_hash(F.lit("regular"), F.lit(420), F.lit(None), F.lit(None), F.col("xattrs")))


@query(f"{X.OPS}, {X.PEERS} SELECT o.peer AS peer, o.peer AS origin, CAST(length(o.peer) AS BIGINT) AS recv_cursor, CAST(0 AS BIGINT) AS last_acked_seq FROM peers o")
def cursor_migration(spark, sf):
    old = spark.createDataFrame([(o, len(o)) for o in (*X.ORIGINS, "gone")], "peer string, cursor long")
    return L.migrate_cursors(old, X.ops(spark, sf))


@query(f"{X.OPS} SELECT op_id FROM ops WHERE event_id % 3 <> 0")
def unapplied_ops(spark, sf):
    log = X.ops(spark, sf)
    return L.unapplied(log, log.filter("event_id % 3 = 0")).select("op_id")


@query(f"{X.OPS} SELECT op_id, user_id % 4 <> 0 AND origin_seq <= 300 AS good FROM ops")
def ack_predicate(spark, sf):
    other = F.when(F.col("user_id") % 4 == 0, "other").otherwise(F.col("origin"))
    return X.ops(spark, sf).select("op_id", P.ack_in_bounds(other, F.col("origin"), F.col("origin_seq"), F.lit(300)).alias("good"))


@query("SELECT doc_id, length(text) > 0 AS text_path FROM documents")
def text_paths(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", P.is_text_path(F.encode("text", "UTF-8")).alias("text_path"))


_LOCAL = (
    "changes AS (SELECT 'me' AS origin, 'u/' || user_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op_type, CASE WHEN event_type <> 'error' THEN sha256(event_type) END AS content_hash, epoch_us(ts) AS t, event_id FROM events), "
    "seen AS (SELECT *, lag(content_hash) OVER w AS old, coalesce(lag(op_type = 'delete') OVER w, true) AS gone FROM changes WINDOW w AS (PARTITION BY path ORDER BY t, event_id)), "
    "real AS (SELECT * FROM seen WHERE NOT CASE WHEN op_type = 'delete' THEN gone ELSE NOT gone AND content_hash = old END), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, event_id) AS k, row_number() OVER (ORDER BY t, event_id) AS origin_seq FROM real), "
    f"minted AS (SELECT *, {X.dig(chr(39) + 'uuid' + chr(39), chr(39) + 'me' + chr(39), 'first_value(origin_seq) OVER (PARTITION BY path ORDER BY t, event_id)', 'path')}[1:32] AS uuid FROM numbered)"
)
LOCAL_APPENDS = f"WITH {_LOCAL} SELECT event_id, path, op_type, origin_seq, 'me:' || k AS vv, uuid FROM minted"


def local_changes(spark, sf):
    """Changes of one node, many of which change nothing."""
    gone = F.col("event_type") == "error"
    return X.events(spark, sf).select(
        F.lit("me").alias("origin"), F.concat(F.lit("u/"), "user_id").alias("path"), F.when(gone, "delete").otherwise("write").alias("op_type"), F.when(~gone, F.sha2("event_type", 256)).alias("content_hash"),
        F.when(~gone, F.lit("m")).otherwise(D.NO_META).alias("meta_hash"), F.when(~gone, F.lit("n")).alias("naming_hash"), F.lit(420).alias("mode"), F.lit(1).cast("long").alias("size"), "t", "event_id",
    )


@query(LOCAL_APPENDS)
def local_appends(spark, sf):
    nothing = spark.createDataFrame([], "path string, tombstone boolean, content_hash string, meta_hash string, uuid string, vv map<string,bigint>")
    log = spark.createDataFrame([], "origin string, origin_seq long")
    return R.append_local(local_changes(spark, sf), nothing, log, ["t", "event_id"], X.hour()).select("event_id", "path", "op_type", "origin_seq", V.text(F.col("vv")).alias("vv"), "uuid")


@query(f"{X.OPS}, {X.winners('w')}, i AS (SELECT DISTINCT path FROM w), late AS (SELECT path, max(event_id) AS event_id FROM ops GROUP BY path) SELECT w.path, w.content_hash, {X.VV_TEXT} AS vv FROM w")
def state_over_index(spark, sf):
    log = X.ops(spark, sf)
    early = R.current_state(log.filter("event_id % 2 = 0"))
    return R.current_state(log, early).select("path", "content_hash", V.text(F.col("vv")).alias("vv"))


_ASKED = "asked AS (SELECT hash, peer, rank, CASE WHEN (length(peer) + ascii(hash[1:1])) % 4 = 0 THEN 'found' WHEN ascii(hash[2:2]) % 3 = 0 THEN 'busy' ELSE 'missing' END AS answer FROM s WHERE ascii(hash[3:3]) % 5 <> rank)"


@query(
    "WITH w AS (SELECT sha256(props) AS hash, min(event_type) AS origin FROM events GROUP BY props), p AS (SELECT DISTINCT sha256(props) AS hash, event_type AS peer FROM events), "
    f"s AS (SELECT hash, peer, row_number() OVER (PARTITION BY hash ORDER BY CASE WHEN peer <> origin THEN 1 ELSE 0 END, peer) AS rank FROM w JOIN p USING (hash)), {_ASKED}, "
    "g AS (SELECT s.hash, min(CASE WHEN answer = 'found' THEN s.rank END) AS rank, bool_or(coalesce(answer = 'busy', false)) AS busy, bool_or(coalesce(answer = 'missing', false)) AS missing FROM s LEFT JOIN asked a ON a.hash = s.hash AND a.peer = s.peer GROUP BY s.hash) "
    "SELECT g.hash, s.peer, g.rank, (SELECT count(*) FROM asked a WHERE a.hash = g.hash AND (g.rank IS NULL OR a.rank <= g.rank)) AS tries, CASE WHEN g.rank IS NOT NULL THEN 'found' WHEN missing AND NOT busy THEN 'permanent' ELSE 'transient' END AS outcome FROM g LEFT JOIN s ON s.hash = g.hash AND s.rank = g.rank"
)
def acquisition_order(spark, sf):
    sources = settle(fetch_sources(spark, sf), "sources")
    code = lambda i: F.ascii(F.substring("hash", i, 1))
    answer = F.when((F.length("peer") + code(1)) % 4 == 0, "found").when(code(2) % 3 == 0, "busy").otherwise("missing")
    return L.acquire(sources, sources.filter(code(3) % 5 != F.col("rank")).select("hash", "peer", answer.alias("answer")))


@query(
    f"{_RENAMED.replace('moved AS', 'all_moved AS')}, r AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN regexp_replace(path, '[.]r$', '') END AS path_old FROM all_moved WHERE event_id % 9 = 0 AND op_type = 'rename'), {X.winners('w', where='event_id % 5 <> 0')} "
    "SELECT r.op_id, r.path FROM r LEFT JOIN w ON w.path = r.path_old WHERE NOT coalesce(w.tombstone, true)"
)
def noop_renames(spark, sf):
    return R.drop_noops(X.renames(spark, sf).filter("op_type = 'rename'"), X.replica(spark, sf, 5)).select("op_id", "path")
