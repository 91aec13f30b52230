"""Trees of files on a mounted file system with their metadata, as a Spark data source.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("root", "/share").load()

The folder must be mounted at the same place wherever executors run. Entries of the first `levels` levels are listed when the query is
planned, and each folder found there is a partition that its own task walks, so a large tree is many tasks and the driver sees folders only.

Regular files, symbolic links (not followed), fifos and devices are rows; folders are walked, sockets and staging files are left
out. Owners are zero with owners = skip. An entry that goes while it is looked at is left out. Extended attributes are sorted by name.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.predicates import STAGING

SCHEMA = "path string, kind string, size long, mode int, uid long, gid long, mtime_s long, mtime_ns int, target string, rdev long, xattrs array<struct<k:binary,v:binary>>"
# Kinds by the test that tells them.
KINDS = ((stat.S_ISREG, "regular"), (stat.S_ISLNK, "symlink"), (stat.S_ISFIFO, "fifo"), (stat.S_ISCHR, "char"), (stat.S_ISBLK, "block"))


def capture(path: str, owners: str = "numeric") -> tuple | None:
    """Metadata of one entry, not followed: kind to xattrs of the schema; None for what is not replicated."""
    found = os.lstat(path)
    kind = next((name for test, name in KINDS if test(found.st_mode)), None)
    if kind is None:
        return None
    try:
        names = sorted(os.listxattr(path, follow_symlinks=False))
        pairs = [(os.fsencode(n), os.getxattr(path, n, follow_symlinks=False)) for n in names]
    except OSError:  # a file system without them, or one that went meanwhile
        pairs = []
    uid, gid = (0, 0) if owners == "skip" else (found.st_uid, found.st_gid)
    target = os.readlink(path) if kind == "symlink" else None
    rdev = found.st_rdev if kind in ("char", "block") else 0
    return kind, found.st_size if kind == "regular" else 0, stat.S_IMODE(found.st_mode), uid, gid, found.st_mtime_ns // 10**9, found.st_mtime_ns % 10**9, target, rdev, pairs


class Folder(InputPartition):
    """A folder to list, and whether to walk what is below it."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, levels: int, owners: str) -> None:
        self.root, self.levels, self.owners = root, levels, owners

    def partitions(self) -> list[Folder]:
        """Folders of the first levels alone, each walked no further, and those of the last level with all below."""
        out, level = [], [self.root]
        for _ in range(self.levels):
            out += [Folder(p, False) for p in level]
            level = [e.path for p in level for e in os.scandir(p) if e.is_dir(follow_symlinks=False)]
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        pending = [partition.path]
        while pending:
            try:
                entries = list(os.scandir(pending.pop()))
            except OSError:
                continue
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep:
                        pending.append(entry.path)
                elif STAGING not in entry.name:
                    try:
                        found = capture(entry.path, self.owners)
                    except OSError:
                        continue
                    if found is not None:
                        yield os.path.relpath(entry.path, self.root), *found


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        root = self.options.get("root") or self.options.get("path")
        if not root:
            raise ValueError("the tree source needs the option root")
        return TreeReader(root.rstrip("/") or "/", int(self.options.get("levels", 1)), self.options.get("owners", "numeric"))
