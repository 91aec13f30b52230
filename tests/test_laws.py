"""Laws of vectors, resolution and rosters, on generated cases that run as one Spark job each."""

import hashlib
import random

from pyspark.sql import functions as F

from tidemark.functions import digest as D
from tidemark.functions import vv as V
from tidemark.operators import chunks as C
from tidemark.operators import ingest as I
from tidemark.operators import merkle as M
from tidemark.operators import oplog as L
from tidemark.operators import policy as Q
from tidemark.operators import resolve as R
from tidemark.operators import roster as N
from tidemark.streaming import pipelines as S

VECTOR = "map<string,bigint>"


def vectors(n, seed):
    draw = random.Random(seed)
    return [{k: draw.randint(1, 4) for k in draw.sample("abcd", draw.randint(0, 3))} for _ in range(n)]


def test_compare_and_merge(spark):
    a, b = vectors(300, 1), vectors(300, 2)
    df = spark.createDataFrame(list(zip(a, b, strict=True)), f"a {VECTOR}, b {VECTOR}")
    x, y = F.col("a"), F.col("b")
    rows = df.select("a", "b", V.compare(x, y).alias("r"), V.compare(y, x).alias("s"), V.compare(x, x).alias("same"), V.merge(x, y).alias("m"), V.merge(y, x).alias("n"), V.increment(x, F.lit("a")).alias("i")).collect()
    for r in rows:
        more = any(v > r.b.get(k, 0) for k, v in r.a.items())
        less = any(v > r.a.get(k, 0) for k, v in r.b.items())
        assert r.r == ("concurrent" if more and less else "dominates" if more else "dominated" if less else "equal")
        assert r.s == {"dominates": "dominated", "dominated": "dominates"}.get(r.r, r.r) and r.same == "equal"
        assert r.m == r.n == {k: max(r.a.get(k, 0), r.b.get(k, 0)) for k in r.a | r.b}
        assert r.i == r.a | {"a": r.a.get("a", 0) + 1}


def version(path, origin, seq, vv, content="c1", kind="write", meta="m"):
    return (f"{origin}{seq}", origin, seq, kind, path, None, None if kind == "delete" else content, "-" if kind == "delete" else meta, "n", 420, 5, "u", vv)


OPS = "op_id string, origin string, origin_seq long, op_type string, path string, path_old string, content_hash string, meta_hash string, naming_hash string, mode int, size long, uuid string, vv map<string,bigint>"


def test_resolution_ignores_order_and_repeats(spark, sf):
    from tidemark.plans import fixtures as X

    log = X.ops(spark, sf)
    want = sorted(map(str, R.current_state(log).select("path", "content_hash", V.text(F.col("vv"))).collect()))
    twice = log.unionByName(log).orderBy(F.rand(3))
    assert sorted(map(str, R.current_state(twice).select("path", "content_hash", V.text(F.col("vv"))).collect())) == want


def test_modify_beats_delete_and_superseded_never_wins(spark):
    rows = [version("p", "a", 1, {"a": 1}, "zzz"), version("p", "a", 2, {"a": 2}, "aaa"), version("p", "b", 1, {"b": 1}, kind="delete"), version("q", "a", 3, {"a": 1}, "x"), version("q", "b", 2, {"b": 1}, "y")]
    found = R.candidates(spark.createDataFrame(rows, OPS))
    maximal = R.antichain(found)
    won = {r.path: r for r in R.winners(found, maximal).collect()}
    assert won["p"].content_hash == "aaa" and not won["p"].tombstone and won["p"].vv == {"a": 2, "b": 1}
    assert won["q"].content_hash == "y"
    assert [r.content_hash for r in R.copies(maximal, R.winners(found, maximal)).collect()] == ["x"]


def test_identical_content_is_not_copied(spark):
    rows = [version("p", "a", 1, {"a": 1}), version("p", "b", 1, {"b": 1})]
    found = R.candidates(spark.createDataFrame(rows, OPS))
    maximal = R.antichain(found)
    assert R.copies(maximal, R.winners(found, maximal)).count() == 0


def test_reconcile_reaches_a_fixpoint(spark, sf):
    from tidemark.plans import fixtures as X
    from tidemark.sources.shared import settle

    a, b = X.replica(spark, sf, 7), X.replica(spark, sf, 5)
    for _ in range(5):
        a = settle(M.reconcile(a, b), "a")
        b = settle(M.reconcile(b, a), "b")
        if M.root(M.levels(a)).first() == M.root(M.levels(b)).first():
            break
    assert M.root(M.levels(a)).first() == M.root(M.levels(b)).first()
    assert M.diff(M.levels(a), M.levels(b)).count() == 0


def row(path, vv, content="c1", tombstone=False, meta="m"):
    return (path, tombstone, None if tombstone else content, "-" if tombstone else meta, "n", 420, 5, "u", vv)


INDEX = "path string, tombstone boolean, content_hash string, meta_hash string, naming_hash string, mode int, size long, uuid string, vv map<string,bigint>"


def copy_of(spark, path, content):
    return spark.range(1).select(D.copy_path(F.lit(path), F.lit(content), F.lit("n")).alias("p"), D.copy_vv(D.copy_path(F.lit(path), F.lit(content), F.lit("n"))).alias("v")).first()


def test_no_row_is_lost_to_a_conflict_copy(spark):
    one = copy_of(spark, "p", "aa")
    # The copy of p's loser finds a row of its own, a tombstone, its own earlier self, an edited self, and a free path.
    cases = {"row": row(one.p, {"z": 5}, "zz"), "weak": row(one.p, {"z": 5}, "00"), "gone": row(one.p, {"z": 5}, tombstone=True), "same": row(one.p, one.v, "aa"), "edited": row(one.p, one.v | {"z": 1}, "ee"), "free": None}
    for name, held in cases.items():
        local = spark.createDataFrame([row("p", {"a": 1}, "aa"), *([held] if held else [])], INDEX)
        remote = spark.createDataFrame([row("p", {"b": 1}, "bb")], INDEX)
        got = {r.path: r for r in M.reconcile(local, remote).collect()}
        assert got["p"].content_hash == "bb" and got["p"].vv == {"a": 1, "b": 1}
        contents = {r.content_hash for r in got.values()}
        assert contents >= ({"bb", "ee"} if name == "edited" else {"aa", "bb"})
        if name in ("row", "weak"):
            low, high = ("aa", "zz") if name == "row" else ("00", "aa")
            assert got[one.p].content_hash == high and got[one.p].vv == one.v | {"z": 5}
            further = copy_of(spark, one.p, low)
            assert got[further.p].content_hash == low and got[further.p].vv == further.v and len(got) == 3
        else:
            assert len(got) == 2 and got[one.p].vv == {"gone": one.v | {"z": 5}, "same": one.v, "edited": one.v | {"z": 1}, "free": one.v}[name]


def test_a_chain_that_is_too_long_leaves_the_conflict(spark):
    path, rows = "p", []
    for _ in range(R.CHAIN):
        step = copy_of(spark, path, "aa")
        path = step.p
        rows.append(row(path, {"z": 1}, "zz"))
    local = spark.createDataFrame([row("p", {"a": 1}, "aa"), row("q", {"a": 1}, "aa"), *rows], INDEX)
    remote = spark.createDataFrame([row("p", {"b": 1}, "bb"), row("q", {"b": 1}, "bb")], INDEX)
    got = {r.path: r for r in M.reconcile(local, remote).collect()}
    assert got["p"].content_hash == "aa" and got["p"].vv == {"a": 1} and got["q"].content_hash == "bb"
    assert all(got[r[0]].vv == {"z": 1} for r in rows) and len(got) == len(rows) + 3


def test_a_pull_lists_what_differs_only(spark):
    rows = [row(f"d{i % 5}/e{i % 3}/f{i}", {"a": 1}) for i in range(60)]
    one = [row(r[0], {"a": 2}) if r[0] == "d1/e1/f31" else r for r in rows]
    a, b = (M.levels(spark.createDataFrame(x, INDEX)) for x in (rows, one))
    assert tuple(M.listings(a, a).first()) == (0, 0)
    assert tuple(M.listings(b, a).first()) == (3, 1)
    assert M.root(M.levels(spark.createDataFrame([], INDEX))).count() == 1 and M.diff(a, a).count() == 0


def test_large_folders_are_hashed_in_two_levels(spark):
    rows = [row(f"big/f{i}", {"a": 1}) for i in range(60)] + [row(f"small/f{i}", {"a": 1}) for i in range(5)] + [row(f"t{i}", {"a": 1}) for i in range(30)]
    index = spark.createDataFrame(rows, INDEX)
    trees = [M.levels(i, wide) for i, wide in ((index, 20), (index.repartition(7), 20), (index, 1000))]
    hashes = [{(r.prefix, r.name): r.hash for r in t.filter("is_dir").collect()} for t in trees]
    roots = [M.root(t, wide).first().root for t, wide in zip(trees, (20, 20, 1000), strict=True)]
    assert hashes[0] == hashes[1] and roots[0] == roots[1] != roots[2]
    assert hashes[0]["", "small"] == hashes[2]["", "small"] and hashes[0]["", "big"] != hashes[2]["", "big"]
    other = M.levels(spark.createDataFrame([row("big/f7", {"a": 2}), *(r for r in rows if r[0] != "big/f7")], INDEX), 20)
    assert [r.path for r in M.diff(other, trees[0]).collect()] == ["big/f7"]


def test_equal_vectors_resolve_alike_in_any_order(spark):
    rows = [version("p", "a", 1, {"a": 1}, "x"), version("p", "b", 1, {"a": 1}, "y"), version("p", "c", 1, {"a": 1}, "w")]
    for order in (rows, rows[::-1]):
        found = R.candidates(spark.createDataFrame(order, OPS))
        assert [r.content_hash for r in R.antichain(found).collect()] == ["y"] == [r.content_hash for r in R.winners(found).collect()]


def test_sequences_over_one_hot_origin(spark):
    n = 3 * L.BLOCK + 10
    log = spark.range(1, n + 1).select(F.lit("o").alias("origin"), F.lit("p").alias("peer"), F.col("id").alias("origin_seq"))
    hole = log.filter(~F.col("origin_seq").isin(5, L.BLOCK, L.BLOCK + 1, 2 * L.BLOCK + 7, 2 * L.BLOCK + 8))
    want = [(5, 5), (L.BLOCK, L.BLOCK + 1), (2 * L.BLOCK + 7, 2 * L.BLOCK + 8)]
    assert sorted((r["from"], r["to"]) for r in S.sequence_gaps(hole).collect()) == want
    acked = lambda df: [tuple(r) for r in L.contiguous_ack(df).collect()]
    assert acked(log) == [("p", "o", n)] and acked(hole) == [("p", "o", 4)]
    assert acked(log.filter(F.col("origin_seq") != 2 * L.BLOCK + 1)) == [("p", "o", 2 * L.BLOCK)]
    assert acked(log.filter(F.col("origin_seq") != 2 * L.BLOCK)) == [("p", "o", 2 * L.BLOCK - 1)] and acked(log.filter("origin_seq > 1")) == [("p", "o", 0)]
    assert acked(log.filter(F.col("origin_seq").between(1, L.BLOCK) | (F.col("origin_seq") > 2 * L.BLOCK))) == [("p", "o", L.BLOCK)]
    many = spark.range(5000).select(F.lit("o").alias("origin"), (F.col("id") * 7919 % 5000).alias("t"))
    got = L.numbered(many, "origin", ["t"], F.floor(F.col("t") / 64)).collect()
    assert all(r.n == r.t + 1 for r in got)


def test_roster_is_order_independent_and_never_resurrects(spark):
    rows = [("n", "a1", "f1", 1, "add"), ("n", "a1", "f1", 2, "remove"), ("n", "a2", "f2", 2, "add"), ("m", "a3", "f3", 1, "add")]
    schema = "node string, addr string, fingerprint string, epoch long, kind string"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    assert sorted(N.winners(one).collect()) == sorted(N.winners(two).collect()) == sorted(N.merge(one, two).collect())
    assert {r.node: r.kind for r in N.winners(one).collect()} == {"n": "remove", "m": "add"}


def test_content_chunks_are_lossless_bounded_and_local():
    data = random.Random(5).randbytes(200_000)
    ends = C.cut_points(data, 1024, 4096, 16384)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes) <= 16384 and min(sizes[:-1]) >= 1024

    def cut(d):
        e = C.cut_points(d, 1024, 4096, 16384)
        return {d[a:b] for a, b in zip([0, *e], e, strict=False)}

    assert len(cut(data) - cut(data[:70_000] + b"x" + data[70_000:])) <= 4
    assert C.cut_points(b"", 4, 8, 16) == [] and C.cut_points(b"abc", 4, 8, 16) == [3]


def test_suppression_is_single_shot(spark):
    e = spark.createDataFrame([("p", "write", "h", 10, 1), ("p", "write", "h", 20, 2), ("p", "write", "g", 10, 3), ("q", "write", "h", 500, 4)], "path string, kind string, content_hash string, t long, event_id long")
    marks = spark.createDataFrame([("p", "write", "h", 5), ("q", "write", "h", 5)], "path string, kind string, content_hash string, at long")
    assert sorted(r.event_id for r in I.suppress(e, marks, 100).collect()) == [2, 3, 4]


def test_one_registration_holds_a_path(spark):
    marks = [("p", "write", "h1", 1), ("p", "write", "h2", 2), ("q", "delete", "x", 1), ("r", "write", "h", 1), ("s", "write", "h", 1), ("t", "write", None, 1)]
    events = [("p", "write", "h1", 3, 1), ("p", "write", "h2", 4, 2), ("p", "write", "h2", 5, 3), ("q", "delete", None, 3, 4), ("r", "write", "g", 3, 5), ("r", "write", "h", 4, 6), ("s", "write", "h", 101, 7), ("t", "delete", None, 2, 8), ("t", "write", None, 3, 9)]
    e = spark.createDataFrame(events, "path string, kind string, content_hash string, t long, event_id long")
    m = spark.createDataFrame(marks, "path string, kind string, content_hash string, at long")
    assert sorted(r.event_id for r in I.suppress(e, m, 100).collect()) == [1, 3, 5, 7, 8]


def test_token_bucket_equals_the_recurrence(spark):
    draw = random.Random(4)
    rows, t = [], 0
    for seq in range(300):
        t += draw.choice([0, 1, 10, 300_000, 2_000_000, 9_000_000])
        rows.append((draw.choice("ab"), t, seq, draw.randint(0, 40)))
    got = {r.seq: r.wait for r in Q.token_bucket(spark.createDataFrame(rows, "key string, t long, seq long, amount long"), 7, ticks=1_000_000).collect()}
    tokens, last = {}, {}
    for key, t, seq, amount in rows:
        tokens[key] = min(7.0, tokens.get(key, 7.0) + (t - last.get(key, t)) * 7 / 1e6) - amount
        last[key] = t
        assert abs(got[seq] - max(0.0, -tokens[key] / 7)) < 1e-6
    free = Q.two_buckets(spark.createDataFrame(rows, "peer string, t long, seq long, amount long"), 0, 0)
    assert free.filter("wait <> 0").count() == 0 and free.count() == 300


def test_backoff_stays_within_its_bounds(spark):
    rows = Q.backoff(spark.range(2000).select((F.col("id") % 12).cast("double").alias("n")), 42).collect()
    assert all(0.25 <= r.delay <= max(0.25, min(15.0, 0.5 * 2**r.n)) for r in rows)
    assert max(r.delay for r in rows) > 10 and len({r.delay for r in rows}) > 1000


def test_p95_narrows_to_the_exact_rank(spark):
    draw = random.Random(6)
    for values in ([draw.random() for _ in range(5000)], [1.0] * 3000, [float(i % 7) for i in range(3000)], [2.5], []):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = sorted(values)[min(len(values) * 95 // 100, len(values) - 1)] if values else None
        for at_once in (10, 1_000_000):
            got = Q.p95(df, "v", at_once).collect()
            assert [r.p95 for r in got] == ([want] if values else [])


def test_chunks_of_bytes_and_text(spark):
    data = random.Random(2).randbytes(1000)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "file int, content binary")
    got = sorted((r.idx, bytes(r.body), r.file_hash) for r in C.fixed_chunks(df, 64, whole=True).collect())
    assert b"".join(b for _, b, _ in got) == data and {h for _, _, h in got} == {hashlib.sha256(data).hexdigest()} and len(got) == 16
    text = "aé\n日𝄞" * 50
    got = sorted((r.idx, r.body, r.len) for r in C.fixed_chunks(spark.createDataFrame([(1, text)], "file int, content string"), 7).collect())
    assert [b for _, b, _ in got] == [text[i : i + 7] for i in range(0, len(text), 7)]
    files = spark.range(3000).select(F.col("id").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    one, two = C.tree_digest(files).first().digest, C.tree_digest(files, at_once=1).first().digest
    assert one != two == C.tree_digest(files.repartition(7), at_once=1).first().digest


def test_manifest_verdicts(spark):
    rows = [(1, 0, 10, "h", "h"), (1, 1, 10, "h", "h"), (2, 0, 10, "h", "x"), (3, 0, 99, "h", "h"), (4, 0, 10, "h", "h"), (4, 1, 10, "h", "h"), (4, 2, 10, "h", "h"), (5, 0, 10, "h", "h"), (5, 4, 10, "h", "h"), (6, 0, 0, "h", "h")]
    df = spark.createDataFrame(rows, "file int, idx int, len int, file_hash string, asked string")
    assert {r.file: r.verdict for r in C.validate_manifest(df, 64, 25, page=2).collect()} == {1: "ok", 2: "other_file", 3: "bad_size", 4: "too_large", 5: "empty_page", 6: "bad_size"}


def test_an_append_that_runs_again_writes_the_same(spark, tmp_path):
    from tidemark.plans import fixtures as X

    schema = "origin string, path string, op_type string, content_hash string, meta_hash string, naming_hash string, mode int, size long, t long, event_id long"
    one = lambda path, kind, content, t: ("me", path, kind, content, "m" if content else "-", "n", 420, 1, t, t)
    batches = [[one("p", "write", "a", 1), one("p", "write", "a", 2), one("q", "delete", None, 3)], [one("p", "write", "a", 4), one("p", "write", "b", 5), one("q", "write", "c", 6)], [one("p", "delete", None, 7), one("p", "delete", None, 8)]]
    at = f"file://{tmp_path}/x"
    for number, rows in enumerate(batches):
        for _ in range(2):
            S.append_batch(spark.createDataFrame(rows, schema), number, at, X.hour())
    got = sorted((r.origin_seq, r.path, r.op_type, dict(r.vv)) for r in spark.read.parquet(f"{at}/log").collect())
    assert got == [(1, "p", "write", {"me": 1}), (2, "p", "write", {"me": 2}), (3, "q", "write", {"me": 1}), (4, "p", "delete", {"me": 3})]
    assert {r.path: r.tombstone for r in S.materialized(spark, f"{at}/state").collect()} == {"p": True, "q": False}


def test_state_levels_hold_every_batch_once(spark, tmp_path):
    at = f"file://{tmp_path}/levels"
    for number in range(9):
        rows = [version(f"p{number % 3}", "abc"[number % 3], number + 1, {"abc"[number % 3]: number + 1}, f"c{number}")]
        for _ in range(1 + number % 2):
            S.fold_batch(spark.createDataFrame(rows, OPS), number, at)
        assert len(S._done(spark, at, "level")) <= 2 + 2 * (number + 2).bit_length()
    assert {r.path: r.content_hash for r in S.materialized(spark, at).collect()} == {"p0": "c6", "p1": "c7", "p2": "c8"}


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", 0.0, 1, 10.0), ("k", 0.0, 2, 5.0), ("k", 10.0, 3, 1.0)], "key string, t double, seq long, amount double")
    assert {r.seq: round(r.wait, 6) for r in Q.token_bucket(df, 10.0).collect()} == {1: 0.0, 2: 0.5, 3: 0.0}
