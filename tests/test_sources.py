"""Files, rosters and configuration."""

import hashlib
import json
import os
import socket

import pytest
from pyspark.sql import functions as F

from tidemark.sources import config, files, tree


def test_tree_and_roster(spark, tmp_path):
    (tmp_path / "share/a").mkdir(parents=True)
    (tmp_path / "share/a/x.txt").write_text("hello")
    (tmp_path / "share/.staging-1").write_text("no")
    rows = files.read_tree(spark, str(tmp_path / "share")).collect()
    assert [(r.path, r.size) for r in rows] == [("a/x.txt", 5)]
    (tmp_path / "roster.json").write_text("\n".join(json.dumps({"node": n, "addr": "a", "fingerprint": "f", "epoch": 1, "kind": k, "sig": s}) for n, k, s in (("a", "add", "good"), ("b", "add", "bad"))))
    good, dropped = files.read_roster(spark, str(tmp_path / "roster.json"), lambda df: F.col("sig") == "good")
    assert [r.node for r in good.collect()] == ["a"] and dropped == 1
    files.write_roster(good, str(tmp_path / "out"))
    assert files.read_roster(spark, str(tmp_path / "out"), lambda df: F.lit(True))[0].count() == 1
    assert files.read_roster(spark, str(tmp_path / "none"), lambda df: F.lit(True))[0].count() == 0


def test_config(tmp_path):
    ok = 'node_id = "a"\nshare = "/s"\nstate = "/v"\nchunk_min = 4096\nchunk_avg = 16384\nchunk_max = 65536\nfree_space_percent = 10.0\n[[peers]]\nnode_id = "b"\naddr = "h:1"\n'
    (tmp_path / "c.toml").write_text(ok)
    assert config.load(str(tmp_path / "c.toml")).peers[0].node_id == "b"
    for bad in (ok.replace("4096", "1"), ok.replace('"/v"', '"/s/v"'), ok.replace("10.0", "96.0"), ok.replace('node_id = "b"', 'node_id = "a"'), ok + "\nunknown = 1\n", ok.replace("16384", "128")):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.toml"))


def test_settings_of_a_whole_node(tmp_path):
    ok = """node_id = "a"
share = "{0}/s"
state = "{0}/v"
key = "{0}/k"
global_rate = 100
owners = "skip"
[[peers]]
node_id = "b"
addr = "h:1"
fingerprint = "f"
[[schedule]]
days = ["weekday", "sun"]
begin = "22:00"
end = "6:30"
global_rate = 5
""".format(tmp_path)
    write = lambda text: (tmp_path / "c.toml").write_text(text)
    (tmp_path / "s").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "s")
    write(ok)
    one = config.load(str(tmp_path / "c.toml"))
    assert one.schedule[0].row(3) == (3, ["weekday", "sun"], 1320, 390, 5, 0) and one.fingerprints() == {"f"} and one.path("roster") == f"{tmp_path}/v.roster"
    write(ok.replace("100", "200").replace('"skip"', '"numeric"'))
    assert one.changed(config.load(str(tmp_path / "c.toml"))) == {"global_rate": "reload", "owners": "restart"}
    for name in config.OUTSIDE:
        for inside in ("s/x", "link/x"):
            write("\n".join(x for x in ok.split("\n") if not x.startswith(f"{name} =")).replace("global_rate = 100", f'{name} = "{tmp_path}/{inside}"'))
            with pytest.raises(ValueError, match=name):
                config.load(str(tmp_path / "c.toml"))
    for bad in (ok.replace("sun", "day"), ok.replace("22:00", "25:00"), ok.replace("6:30", "6:60"), ok.replace("skip", "some"), ok.replace("100", "-1"), ok.replace('"weekday", "sun"', "")):
        write(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.toml"))


def test_tree_source_captures_metadata(spark, tmp_path):
    share = tmp_path / "share"
    (share / "a/b/c").mkdir(parents=True)
    (share / "a/b/c/x.txt").write_text("hello")
    (share / "top").write_text("t")
    (share / "a/.staging-9").write_text("no")
    (share / "a/link").symlink_to("../top")
    (share / "a/loop").symlink_to(share)
    os.mkfifo(share / "a/pipe", 0o600)
    os.chmod(share / "top", 0o4750)
    os.utime(share / "top", ns=(5, 7_000_000_009))
    door = socket.socket(socket.AF_UNIX)
    door.bind(str(share / "door"))
    try:
        os.setxattr(share / "top", "user.b", b"2")
        os.setxattr(share / "top", "user.a", b"1")
        pairs = [(b"user.a", b"1"), (b"user.b", b"2")]
    except OSError:
        pairs = []
    spark.dataSource.register(tree.TreeSource)
    for levels in (0, 1, 3):
        rows = {r.path: r for r in spark.read.format("tree").option("root", str(share)).option("levels", levels).load().collect()}
        assert {p: r.kind for p, r in rows.items()} == {"a/b/c/x.txt": "regular", "top": "regular", "a/link": "symlink", "a/loop": "symlink", "a/pipe": "fifo"}
        top = rows["top"]
        assert (top.mode, top.mtime_s, top.mtime_ns, top.uid, top.size, rows["a/link"].target, rows["a/pipe"].mode) == (0o4750, 7, 9, os.getuid(), 1, "../top", 0o600)
        assert [(bytes(x.k), bytes(x.v)) for x in top.xattrs] == pairs
    skipped = spark.read.format("tree").option("root", str(share)).option("owners", "skip").load()
    assert {(r.uid, r.gid) for r in skipped.collect()} == {(0, 0)}
    assert tree.capture("/dev/null")[0] == "char" and tree.capture("/dev/null")[8] > 0 and tree.capture(str(share / "door")) is None
    door.close()


def test_store_and_key_values(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    body = lambda b: (hashlib.sha256(b).hexdigest(), len(b), bytearray(b))
    rows = spark.createDataFrame([body(b"one"), body(b"two"), ("0" * 64, 3, bytearray(b"bad"))], "hash string, len int, body binary")
    files.write_chunks(rows, at)
    files.write_chunks(rows, at)
    assert sorted(bytes(r.body) for r in files.read_chunks(spark, at).collect()) == [b"one", b"two"]
    spark.createDataFrame([("1" * 64, 3, bytearray(b"rot"))], "hash string, len int, body binary").write.mode("append").parquet(f"{at}/ab=11")
    sound, corrupt = files.read_store(spark, at)
    assert sound.count() == 2 and [r.hash for r in corrupt.collect()] == ["1" * 64]
    assert files.evict_corrupt(spark, at) == 1 and files.evict_corrupt(spark, at) == 0 and files.read_chunks(spark, at).count() == 2
    kv = f"file://{tmp_path}/kv"
    assert files.key_values(spark, kv).count() == 0
    for key, value in (("a", "1"), ("b", "2"), ("a", "3")):
        files.set_key_value(spark, kv, key, value)
    assert {r.key: r.value for r in files.key_values(spark, kv).collect()} == {"a": "3", "b": "2"}
