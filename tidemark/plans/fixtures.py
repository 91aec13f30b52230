"""Op logs, indexes, content, rosters and cursors derived from the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import vv as V
from tidemark.operators import chunks as C
from tidemark.operators import oplog as L
from tidemark.operators import resolve as R
from tidemark.sources.shared import read_shared, settle

ORIGINS = ("click", "error", "purchase", "signup", "view")
#: Propagation delay of an operation to other origins, in microseconds.
LAG = 21_600_000_000
CHUNK = 256
#: Operations of one task.
PORTION = 100_000
#: Portions that one task reads from the files, and that the blocks of an hour are meant for.
READ, HOURLY = 10, 60


def micros(ts: str) -> object:
    """Microseconds of a timestamp without time zone, whatever the session's zone."""
    return F.unix_micros(F.to_timestamp(F.concat(F.col(ts).cast("string"), F.lit("Z"))))


def hour(parts: int = 1) -> object:
    """Hour of an event, or the fraction of one that gives a larger log more blocks, of about as many events."""
    return F.floor(F.col("t") / (3_600_000_000 // -(-parts // HOURLY)))


def events(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    """The events; of a log of so many portions, a task reads READ of them."""
    path, tasks = f"{sf_dir}/events.parquet", -(-parts // READ)
    read = read_shared(spark, path, tasks) if tasks > spark.sparkContext.defaultParallelism else spark.read.parquet(path)
    return read.withColumn("t", micros("ts"))


def portions(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that share the log, by the number of events, which stands in the files' footers."""
    return -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // PORTION)


def shares(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that share the log's shuffles; None, which leaves them to the session, where one portion holds it all.

    The number is named even where the session's own is larger, as Spark would merge those partitions into one for each core.
    """
    parts = portions(spark, sf_dir)
    return max(parts, spark.sparkContext.defaultParallelism) if parts > 1 else None


def ops(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """The op log of the events. What follows from a row alone is worked out last: shuffles and sorts carry events, not their digests."""
    parts = shares(spark, sf_dir)
    e = events(spark, sf_dir, parts or 1).filter(where).select("event_id", "t", "user_id", F.col("event_type").alias("origin"), "props")
    path = F.concat(F.lit("u/"), (F.col("user_id") % 10).cast("string"), F.lit("/"), F.col("user_id").cast("string"))
    on_path = Window.partitionBy("path")
    own = on_path.orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = on_path.orderBy("t").rangeBetween(Window.unboundedPreceding, -LAG)

    def counter(o: str) -> object:
        is_o = (F.col("origin") == o).cast("long")
        return F.when(F.col("origin") == o, F.sum(is_o).over(own)).otherwise(F.coalesce(F.sum(is_o).over(seen), F.lit(0).cast("long")))

    e = L.numbered(e, "origin", ["t", "event_id"], hour(parts or 1), parts).withColumnRenamed("n", "origin_seq").withColumn("path", path)
    e = e.repartition(parts, "path") if parts else e
    counted = e.select("*", V.normalize(F.map_from_arrays(F.array(*map(F.lit, ORIGINS)), F.array(*map(counter, ORIGINS)))).alias("vv"))
    gone = F.col("origin") == "error"
    counted = counted.select(
        "event_id", "t", "user_id", "origin", F.when(gone, "delete").otherwise("write").alias("op_type"), "path",
        F.when(~gone, F.sha2("props", 256)).alias("content_hash"), F.when(gone, 0).otherwise(F.length("props")).cast("long").alias("size"),
        F.when(F.col("event_id") % 2 == 0, 420).otherwise(384).alias("mode"), "origin_seq", "vv",
    )
    live = F.col("op_type") == "write"
    return counted.select(
        "*", D.op_id(F.col("origin"), F.col("origin_seq")).alias("op_id"), F.lit(None).cast("string").alias("path_old"), D.migrated_uuid(F.col("path")).alias("uuid"),
        F.when(live, D.meta_hash(F.lit("regular"), F.col("mode"), F.col("user_id") % 3, F.col("t"))).otherwise(D.NO_META).alias("meta_hash"),
        F.when(live, D.naming_hash(F.lit("regular"), F.col("mode"), F.lit(None), F.lit(None), F.lit(""))).alias("naming_hash"),
    )


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth operation becomes a rename away from its path."""
    log = ops(spark, sf_dir)
    moved = F.col("event_id") % 9 == 0
    return log.withColumn("path_old", F.when(moved, F.col("path"))).withColumn("op_type", F.when(moved, "rename").otherwise(F.col("op_type"))).withColumn("path", F.when(moved, F.concat("path", F.lit(".r"))).otherwise(F.col("path")))


def replica(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """Index of a replica that missed every modulus-th event."""
    return settle(R.winners(R.candidates(ops(spark, sf_dir).filter(F.col("event_id") % modulus != 0))), "replica")


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = R.current_state(ops(spark, sf_dir)).filter("NOT tombstone")
    user = F.substring_index("path", "/", -1).cast("long")
    return live.filter(user % 13 != 0).select("path", F.when(user % 17 == 0, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(files(spark, sf_dir), CHUNK)


def have(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter("file % 2 = 0").select("hash", "len", "body").dropDuplicates(["hash"])


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    node = F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0")
    return s.select(
        node.alias("node"), F.substring(F.sha2(F.col("s_name"), 256), 1, 12).alias("addr"), F.sha2(F.concat(F.lit("f"), "s_name"), 256).alias("fingerprint"),
        (1 + F.col("s_nationkey") % 4).cast("long").alias("epoch"), F.when(F.col("s_suppkey") % 4 == 0, "remove").otherwise("add").alias("kind"),
    )


def seeds(spark: SparkSession) -> DataFrame:
    node = F.lpad(F.col("id").cast("string"), 2, "0")
    return spark.range(10).select(node.alias("node"), F.concat(F.lit("seed-"), node).alias("addr"), F.sha2(F.concat(F.lit("s"), node), 256).alias("fingerprint"))


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each other origin got of an origin's operations: not every eleventh, from the thousandth on."""
    log = ops(spark, sf_dir).select("origin", "origin_seq", "event_id")
    peers = F.array(*map(F.lit, ORIGINS))
    got = log.filter(~((F.col("event_id") % 11 == 0) & (F.col("origin_seq") > 20)))
    return got.select("origin", "origin_seq", F.explode(peers).alias("peer")).filter("peer <> origin")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ops(spark, sf_dir).select("origin", "origin_seq", F.explode(F.array(*map(F.lit, ORIGINS))).alias("peer")).filter("peer <> origin")
    return log.groupBy("peer", "origin").agg(F.max(F.when(F.col("origin_seq") % 10 < F.length("peer"), F.col("origin_seq"))).alias("recv_cursor"), F.max(F.when(F.col("origin_seq") % 7 == 0, F.col("origin_seq"))).alias("last_acked_seq"))


# SQL text of the same fixtures, for DuckDB.


def fld(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '-' ELSE length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END)"


def dig(*xs: str) -> str:
    return f"sha256({' || '.join(map(fld, xs))})"


def _counter(o: str) -> str:
    is_o = f"sum(CASE WHEN origin = '{o}' THEN 1 ELSE 0 END)"
    return f"""CAST(CASE WHEN origin = '{o}' THEN {is_o} OVER (PARTITION BY path ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
    ELSE coalesce({is_o} OVER (PARTITION BY path ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG} PRECEDING), 0) END AS BIGINT) AS c_{o}"""


OPS = f"""WITH e AS (
  SELECT event_id, epoch_us(ts) AS t, user_id, event_type AS origin, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op_type,
    'u/' || (user_id % 10) || '/' || user_id AS path, CASE WHEN event_type <> 'error' THEN sha256(props) END AS content_hash,
    CASE WHEN event_type = 'error' THEN 0 ELSE length(props) END AS size, CASE WHEN event_id % 2 = 0 THEN 420 ELSE 384 END AS mode FROM events),
counted AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY t, event_id) AS origin_seq, {", ".join(map(_counter, ORIGINS))} FROM e),
ops AS (SELECT *, {dig("'op'", "origin", "origin_seq")} AS op_id, {dig("'uuid-of'", "path")}[1:32] AS uuid,
  CASE WHEN op_type = 'write' THEN {dig("'meta'", "'regular'", "mode", "user_id % 3", "t")} ELSE '-' END AS meta_hash,
  CASE WHEN op_type = 'write' THEN {dig("'name'", "'regular'", "mode", "NULL", "NULL", "''")} END AS naming_hash FROM counted)"""
COUNTERS = [f"c_{o}" for o in ORIGINS]
VV_TEXT = "concat_ws(',', " + ", ".join(f"CASE WHEN c_{o} > 0 THEN '{o}:' || c_{o} END" for o in ORIGINS) + ")"


def above(a: str, b: str) -> str:
    """a strictly dominates b."""
    return "(" + " AND ".join(f"{a}.{c} >= {b}.{c}" for c in COUNTERS) + " AND (" + " OR ".join(f"{a}.{c} > {b}.{c}" for c in COUNTERS) + "))"


def winners(name: str, source: str = "ops", where: str = "true") -> str:
    """CTEs <name>_all, <name>_max (antichain) and <name> (winners)."""
    peaks = ", ".join(f"max({c}) AS {c}" for c in COUNTERS)
    return f"""{name}_all AS (SELECT path, op_type = 'delete' AS tombstone, content_hash, meta_hash, naming_hash, CASE WHEN op_type = 'delete' THEN 0 ELSE mode END AS mode, size, uuid, {", ".join(COUNTERS)} FROM {source} WHERE {where}),
{name}_max AS (SELECT DISTINCT * FROM {name}_all a WHERE NOT EXISTS (SELECT 1 FROM {name}_all b WHERE b.path = a.path AND {above("b", "a")})),
{name}_ranked AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY CASE WHEN tombstone THEN 0 ELSE 1 END DESC, coalesce(content_hash, repeat('0', 64)) DESC, meta_hash DESC) AS rank FROM {name}_max),
{name}_best AS (SELECT path, bool_and(tombstone) AS tombstone, max(content_hash) AS content_hash, max(meta_hash) AS meta_hash, max(naming_hash) AS naming_hash, max(mode) AS mode, max(size) AS size, max(uuid) AS uuid FROM {name}_ranked WHERE rank = 1 GROUP BY path),
{name} AS (SELECT * FROM {name}_best JOIN (SELECT path, {peaks} FROM {name}_all GROUP BY path) USING (path))"""


CHUNKS = f"""WITH parts AS (SELECT doc_id AS file, text AS content, unnest(range(CAST(ceil(length(text) / {CHUNK}.0) AS BIGINT))) AS idx FROM documents),
chunks AS (SELECT file, idx, content[idx * {CHUNK} + 1 : idx * {CHUNK} + {CHUNK}] AS body FROM parts),
hashed AS (SELECT file, idx, sha256(body) AS hash, length(body) AS len, body FROM chunks)"""
ROSTER = f"""WITH entries AS (SELECT lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') AS node, sha256(s_name)[1:12] AS addr, sha256('f' || s_name) AS fingerprint, CAST(1 + s_nationkey % 4 AS BIGINT) AS epoch,
  CASE WHEN s_suppkey % 4 = 0 THEN 'remove' ELSE 'add' END AS kind FROM supplier),
keyed AS (SELECT *, {dig("'entry'", "node", "addr", "fingerprint", "epoch", "kind")} AS content_hash FROM entries),
won AS (SELECT node, addr, fingerprint, epoch, kind, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY epoch DESC, CASE WHEN kind = 'remove' THEN 1 ELSE 0 END DESC, content_hash DESC) AS n FROM keyed) WHERE n = 1),
seeds AS (SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS node FROM range(10) r(i)),
seeded AS (SELECT node, 'seed-' || node AS addr, sha256('s' || node) AS fingerprint FROM seeds)"""
PEERS = "peers AS (SELECT unnest(['" + "', '".join(ORIGINS) + "']) AS peer)"
CURSORS = f"""{PEERS}, cursors AS (SELECT peer, origin, max(CASE WHEN origin_seq % 10 < length(peer) THEN origin_seq END) AS recv_cursor, max(CASE WHEN origin_seq % 7 = 0 THEN origin_seq END) AS last_acked_seq
  FROM ops, peers WHERE peer <> origin GROUP BY ALL)"""
