"""What keeps the work of one task bounded: the number of tasks and passes, and results over many blocks."""

import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.operators import ingest as I
from tidemark.operators import oplog as L
from tidemark.operators import policy as Q
from tidemark.operators import resolve as R
from tidemark.plans import fixtures as X
from tidemark.plans import registry
from tidemark.streaming import pipelines as S
from tidemark.streaming import registry as streams


def test_suppression_carries_over_batches(spark, tmp_path):
    draw = random.Random(11)
    rows = [(draw.choice("pqrs"), draw.choice(["write", "delete"]), draw.choice(["h", "g", None]), t, draw.random() < 0.6, t) for t in range(400)]
    schema = "path string, kind string, content_hash string, t long, is_event boolean, event_id long"
    at = str(tmp_path)
    for i in range(5):
        part = spark.createDataFrame([r for r in rows if i * 80 <= r[3] < i * 80 + 80], schema)
        S.suppress_batch(part, i, at, 30)
        if i == 2:
            S.suppress_batch(part, i, at, 30)  # a batch that runs again
    every = spark.createDataFrame(rows, schema)
    want = I.suppress(every.filter("is_event").drop("is_event"), every.filter("NOT is_event").select("path", "kind", "content_hash", F.col("t").alias("at")), 30)
    assert sorted(r.event_id for r in spark.read.parquet(f"{at}/out").collect()) == sorted(r.event_id for r in want.collect())


def test_log_files_follow_the_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "PORTION", 100)
    at, schema, files = streams._logged(spark, sf)
    written = [r.n for r in spark.read.parquet(f"{at}/log").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    n = X.events(spark, sf).count()
    assert max(written) < 4 * 100 and len(written) > n / 100 / 2
    seen = []
    S.read_ops(spark, f"{at}/log", schema, files).writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(seen) == sum(written)


def test_ops_are_dealt_out_by_rows(spark, sf, monkeypatch):
    want = {(r.op_id, r.path, r.origin_seq, str(sorted(r.vv.items()))) for r in X.ops(spark, sf).collect()}
    monkeypatch.setattr(X, "PORTION", 50)
    log = X.ops(spark, sf)
    assert {(r.op_id, r.path, r.origin_seq, str(sorted(r.vv.items()))) for r in log.collect()} == want
    n = -(-X.events(spark, sf).count() // 50)
    tasks = {r.p for r in log.select("path", "vv", F.spark_partition_id().alias("p")).collect()}
    assert n > 4 and len(tasks) > 4  # the session has 4


def test_ops_are_dealt_out_whatever_the_session_merges(spark, sf, monkeypatch):
    want = {(r.op_id, r.path, str(sorted(r.vv.items()))) for r in X.ops(spark, sf).collect()}
    monkeypatch.setattr(X, "PORTION", 50)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")  # Spark merges them into a few
    try:
        log = X.ops(spark, sf)
        tasks = {r.p for r in log.select("path", "vv", F.spark_partition_id().alias("p")).collect()}
        assert {(r.op_id, r.path, str(sorted(r.vv.items()))) for r in log.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert len(tasks) > 4


def test_pairs_are_compared_in_blocks(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.choice("pq"), f"o{i % 70}", {n: draw.randint(1, 3) for n in "abc" if draw.random() < 0.7}) for i in range(90)] + [("p", "none", None), (None, "x", {"a": 1}), ("p", None, {"a": 1}), ("r", "alone", {})]
    want = {}
    for p, x, a in rows:
        for q, y, b in rows:
            if p is not None and p == q and x is not None and y is not None and x < y:
                a_, b_ = a or {}, b or {}
                more, less = any(v > b_.get(k, 0) for k, v in a_.items()), any(v > a_.get(k, 0) for k, v in b_.items())
                r = "concurrent" if more and less else "ordered" if more or less else "equal"
                want[r] = want.get(r, 0) + 1
    df = spark.createDataFrame(rows, "path string, op_id string, vv map<string,bigint>")
    for block, parts in ((1000, None), (7, 3), (1, None)):
        monkeypatch.setattr(L, "PAIRED", block, raising=False)
        found = L.op_pair_causality(df, *([parts] if parts else []))
        assert {r.relation: r.pairs for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair


def test_buckets_in_blocks_equal_one_window(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), t // 3 * 400_000 if t > 40 else 0, t, draw.randint(0, 12)) for t in range(400)]
    df = spark.createDataFrame(rows, "peer string, t long, seq long, amount long")
    columns = ("seq", "global_wait", "peer_wait", "wait", "t")
    want = sorted(Q.two_buckets(df, 9, 4).select(*columns).collect())
    monkeypatch.setattr(Q, "BLOCK", 50)
    got = Q.two_buckets(df, 9, 4)
    assert sorted(got.select(*columns).collect()) == want
    assert Q.token_bucket(df, 9, ("peer",), 1_000_000).groupBy(F.spark_partition_id()).count().count() > 1
    left, last, held = 9.0, 0, {}
    for _, t, seq, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        left, last = min(9.0, left + 9 * (t - last) / 1e6) - amount, t
        held[seq] = max(0.0, -left / 9)
    assert all(abs(r[1] - held[r[0]]) < 1e-6 for r in want)


def test_copies_are_planned_once(spark, sf, monkeypatch):
    read, place = [], R.place_copies
    monkeypatch.setattr(R, "place_copies", lambda planned, index: read.extend((*planned.inputFiles(), *index.inputFiles())) or place(planned, index))
    assert registry.queries()["copy_chain"](spark, sf).count()
    assert read and not any("events.parquet" in f for f in read)


def test_shuffles_of_the_log_carry_events_without_digests(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "PORTION", 50)
    plan = X.ops(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]  # the shuffle by path and all below it
    assert dealt.count("RepartitionByExpression") == 2 and "sha2" in plan and "sha2" not in dealt


def test_candidates_are_worked_out_once(spark):
    draw = random.Random(9)
    log = [(draw.choice("pq"), draw.choice(["a", "b", None]), i, i) for i in range(40)] + [(None, "a", 50, 50), (None, None, 51, 51)]
    found = spark.createDataFrame(log, "path string, origin string, origin_seq long, size long").withColumn("origin_seq", F.when(F.col("origin").isNotNull(), F.col("origin_seq")))
    last = {(p, o): n for p, o, _, n in log if o}
    kept = R.latest_per_origin(found)
    assert kept.columns == found.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in found.collect() if r.origin is None or r["size"] == last[r.path, r.origin])
    assert "Union" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_rechecked_log_stays_dealt_out(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "PORTION", 50)
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "1000")  # Spark merges them into a few
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["delete_recheck"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    dealt = re.findall(r"hashpartitioning\(path#\d+, (\d+)\)", plan)
    assert dealt and set(dealt) == {str(X.shares(spark, sf))}


def test_log_is_read_in_shares_of_its_rows(spark, sf, tmp_path, monkeypatch):
    table = spark.read.parquet(f"{sf}/events.parquet").toArrow()
    pq.write_table(table, tmp_path / "events.parquet", row_group_size=25)
    want = {(r.op_id, r.path, r.origin_seq, str(sorted(r.vv.items()))) for r in X.ops(spark, sf).collect()}
    monkeypatch.setattr(X, "PORTION", 50)
    monkeypatch.setattr(X, "READ", 1, raising=False)
    monkeypatch.setattr(X, "HOURLY", 1, raising=False)
    numbered, seen = L.numbered, []
    monkeypatch.setattr(L, "numbered", lambda e, key, order, block, parts: seen.append((e, block)) or numbered(e, key, order, block, parts))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # the file is small
    try:
        log = X.ops(spark, str(tmp_path))
        read, block = seen[0]
        shares = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
        assert {(r.op_id, r.path, r.origin_seq, str(sorted(r.vv.items()))) for r in log.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert log.sparkSession is spark and spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    assert sum(shares) == table.num_rows and max(shares) <= 100  # the session has 4 tasks
    hours = X.events(spark, sf).select(X.hour()).distinct().count()
    assert read.select(block).distinct().count() > hours


def test_torn_paths_need_the_log_once(spark, sf):
    read = lambda name: registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert read("conflict_winners").count("parquet") == read("live_files").count("parquet") > 0


def test_torn_paths_equal_the_joined_antichain(spark):
    draw = random.Random(4)
    row = lambda p, o, i: (p, draw.random() < 0.2, draw.choice(["x", "y", None]), draw.choice("mn"), None, 420, draw.randint(0, 9), draw.choice(["u", None]), {n: draw.randint(1, 2) for n in "abc" if draw.random() < 0.6}, o, i)
    rows = [row(draw.choice([*"pqrstv", None]), draw.choice("abcd"), i) for i in range(60)] + [row("p", None, None), row("w", "a", 1), row("x", None, None), row("x", None, None)]
    found = spark.createDataFrame(rows, "path string, tombstone boolean, content_hash string, meta_hash string, naming_hash string, mode int, size long, uuid string, vv map<string,bigint>, origin string, origin_seq long")
    members = R.antichain(found).groupBy("path").agg(F.count("*").alias("members")).filter("members > 1")
    joined, got = R.winners(found).join(members, "path"), R.torn(found)
    assert got.columns == joined.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.collect())) != []
