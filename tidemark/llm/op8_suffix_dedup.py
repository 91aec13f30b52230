"""Suffix-array dedup: bytes that repeat from a document with a smaller id are removed, by a logarithmic index family.

Texts are UTF-8 bytes. Only strings of `span` bytes matter, so a suffix is known by its first `span` bytes. Every such string has a
lightest `gram`-byte piece by hash; equal strings have equal lightest pieces, so the string's index partition follows from
its own content, and consecutive strings with the same piece travel as one stretch of text.

Two passes keep the shuffle small. The first sends the pieces' hashes alone, packed, and finds those that occur in two
different texts. The second sends the stretches around such pieces, in order of doc_id; a stretch that a task has seen in a text of
a smaller id is settled there, so of a passage that very many texts share a task sends few. Pieces fall into groups by hash, of
about equal bytes whatever the input, and a task holds the index of one group at a time. There a new batch gets its
suffix array (sorted suffixes with the smallest id of each), is searched in the existing levels for suffixes of smaller
ids, and becomes a level; two levels of about the same size merge, so n suffixes lie in about log n levels. The first pass
uses the same family over hashes. Whole copies are found by fingerprint and take no part.

Cases: null counts as the empty text; texts shorter than `span` stay whole; a null id counts as larger than any other; equal
ids are not smaller than each other, so equal rows both stay; an empty table gives an empty result; other columns are ignored;
texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, settle, text_of

SPAN, GRAM = 50, 20
#: Bytes of input for each group of pieces in the first pass, and in the second, in which shared bytes are sent several times over;
#: and groups at least. A partition takes several groups, one after the other, so that partitions come out alike.
GROUP_BYTES, STRETCH_BYTES = 16_000_000, 1_500_000
LEAST_GROUPS = 1024
#: Groups for each partition of either pass.
TOGETHER = (2, 8)
#: Bytes of text whose hashes are packed together.
PACKED = 6_000_000
#: Hashes in a row of the first pass: their owners are numbered by a byte.
ENTRIES = 256
#: Partitions at most.
PARTITIONS = 20_000
#: Bytes of stretches that a task remembers as sent.
SENT_BYTES = 32_000_000
#: Bytes of text worked on at once, so that arrays stay in a core's cache.
SLICE = 400_000
LAST = 2**63 - 1
LOW48 = np.uint64(2**48 - 1)
BASE, ODD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Family:
    """Sorted levels of keys with the smallest owner of each; levels of about equal size merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys some level holds, and their owner (a key is only ever added once)."""
        found, owner = np.zeros(len(keys), bool), np.full(len(keys), LAST, np.int64)
        for known, owners in self.levels:
            mine, theirs = common(known, keys)
            found[mine] = True
            owner[mine] = owners[theirs]
        return found, owner

    def add(self, keys: np.ndarray, owners: np.ndarray) -> None:
        """A new level of sorted distinct keys."""
        while len(keys) and self.levels and len(self.levels[-1][0]) < 2 * len(keys):
            older, theirs = self.levels.pop()
            keys, owners = sort_min(np.concatenate([older, keys]), np.concatenate([theirs, owners]))
        if len(keys):
            self.levels.append((keys, owners))


def common(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys and in known of what both hold, each sorted and distinct: a merge, or a search where known is far longer."""
    if len(known) > 16 * len(keys):
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        mine = np.flatnonzero(known[at] == keys)
        return mine, at[mine]
    both = np.concatenate([known, keys])
    order = np.argsort(both, kind="stable")
    merged = both[order]
    at = np.flatnonzero(merged[1:] == merged[:-1])
    return order[at + 1] - len(known), order[at]


def sort_min(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the smallest owner of each."""
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.minimum.reduceat(owners, first) if len(first) else owners


def lightest(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each place with `span` bytes from there, the smallest hash of its `gram`-byte pieces."""
    if len(data) < span:
        return np.zeros(0, np.uint64)
    power, size = {1: data.astype(np.uint64)}, 1
    while 2 * size <= gram:
        power[2 * size] = power[size][:-size] * np.uint64(pow(BASE, size, 2**64)) + power[size][size:]
        size *= 2
    hashes, have = power[size], size
    for part in sorted(power, reverse=True)[1:]:
        if have + part <= gram:
            n = len(data) - have - part + 1
            hashes, have = hashes[:n] * np.uint64(pow(BASE, part, 2**64)) + power[part][have : have + n], have + part
    hashes = hashes ^ (hashes >> np.uint64(31))
    hashes *= np.uint64(ODD)
    hashes ^= hashes >> np.uint64(29)
    size, wanted = 1, span - gram + 1
    while 2 * size <= wanted:
        hashes = np.minimum(hashes[:-size], hashes[size:])
        size *= 2
    rest = wanted - size
    return np.minimum(hashes[: len(hashes) - rest], hashes[rest:]) if rest else hashes


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, and where each starts (and the last ends)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def stretches(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of places with one lightest piece: index of the text, first place, number of places, 48-bit hash."""
    data, starts = joined(texts)
    light = lightest(data, span)
    inside = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(starts)
    np.add.at(inside, starts[:-1][sizes >= span], 1)
    np.add.at(inside, starts[1:][sizes >= span] - span + 1, -1)
    place = np.flatnonzero(np.cumsum(inside)[: len(light)] > 0)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    value = light[place]
    which = np.searchsorted(starts, place, "right") - 1
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (which[1:] != which[:-1])])
    return which[first], place[first] - starts[which[first]], np.diff(np.r_[first, len(place)]), value[first] & LOW48


def sliced(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch in portions of about `size` bytes: first and last row, and the texts."""
    texts = batch.column("text").cast(pa.binary())
    at = 0
    while at < len(texts):
        part: list[bytes] = []
        total = 0
        while at + len(part) < len(texts) and (not part or total < size):
            part.append(texts[at + len(part)].as_py() or b"")
            total += len(part[-1])
        yield at, at + len(part), part
        at += len(part)


def pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def chopped(blob: bytes, first: np.ndarray, width: int = 6) -> list[bytes]:
    """The entries of so many bytes from each of the given numbers to the next."""
    bounds = [*(width * first).tolist(), len(blob)]
    return [blob[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def send_pieces(groups: int, span: int, entries: int = ENTRIES):
    """The distinct hashes of the lightest pieces of all texts, by group.

    A row has up to `entries` hashes of a group from neighbouring texts, packed: owners (their fingerprints), of (the number of each
    hash's owner in the row) and pieces. Texts of several slices are packed together, so that rows stay full when groups are many.
    """

    def packed(own: np.ndarray, which: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        group = (value % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((value, which, group))
        which, group, value = which[order], group[order], value[order]
        new = starts_of(group, which, value)
        which, group, value = which[new], group[new], value[new]
        begins = np.flatnonzero(starts_of(group))
        inside = np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)]))
        row = starts_of(group) | (inside % entries == 0)
        first, owner = np.flatnonzero(row), row | starts_of(which)
        number = np.cumsum(owner) - 1
        of = (number - np.repeat(number[first], np.diff(np.r_[first, len(group)]))).astype(np.uint8)
        owners = own[which[owner]].astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.array(chopped(owners, number[first], 8), pa.binary()), pa.array(chopped(of.tobytes(), first, 1), pa.binary()), pa.array(chopped(pack(value), first), pa.binary())], ["grp", "owners", "of", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("c1").to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for low, high, texts in sliced(batch):
                which, _, _, value = stretches(texts, span)
                held.append((which + low, value))
                size += sum(map(len, texts))
                if size > PACKED or high == batch.num_rows:
                    yield packed(own, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0

    return run


def opened(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and the owner of each."""
    owners, of, pieces = (rows.column(c).to_pylist() for c in ("owners", "of", "pieces"))
    before = np.cumsum([0, *(len(b) // 8 for b in owners)])[:-1]
    at = np.frombuffer(b"".join(of), np.uint8) + np.repeat(before, [len(b) for b in of])
    return unpack(b"".join(pieces)), np.frombuffer(b"".join(owners), "<i8")[at]


def shared_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that occur in two different texts, for each text that has them: (c1, pieces)."""
    current, known, told = None, Family(), Family()
    for batch in batches:
        for group in np.unique(batch.column("grp").to_numpy()).tolist():
            if group != current:  # rows come in order of group
                current, known, told = group, Family(), Family()
            keys, owners = opened(batch.filter(pc.equal(batch.column("grp"), group)))
            distinct, lowest = sort_min(keys, owners)
            found, before = known.find(distinct)
            owner = np.where(found, before, lowest)
            at = np.searchsorted(distinct, keys)
            other = np.zeros(len(distinct), bool)
            other[at[owners != owner[at]]] = True
            is_told, _ = told.find(distinct)
            out_key, out_text = keys[(other | is_told)[at]], owners[(other | is_told)[at]]
            late = found & other & ~is_told
            out_key, out_text = np.concatenate([out_key, distinct[late]]), np.concatenate([out_text, before[late]])
            known.add(distinct[~found], lowest[~found])
            fresh = other & ~is_told
            told.add(distinct[fresh], np.zeros(int(fresh.sum()), np.int64))
            order = np.argsort(out_text, kind="stable")
            out_key, out_text = out_key[order], out_text[order]
            first = np.flatnonzero(starts_of(out_text))
            yield pa.RecordBatch.from_arrays([pa.array(out_text[first], pa.int64()), pa.array(chopped(pack(out_key), first), pa.binary())], ["c1", "pieces"])


def send_stretches(span: int, groups: int):
    """Of every text, the stretches around its shared pieces, with the group of the piece.

    One that an earlier text of this task with a smaller id has too is removed for certain; only its length goes on, to any group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            for low, high, texts in sliced(batch):
                k, c1 = (batch.column(c).to_numpy(zero_copy_only=False)[low:high] for c in ("k", "c1"))
                wanted = [unpack(b"".join(x.as_py())) for x in batch.column("shared").slice(low, high - low)]
                which, place, count, value = stretches(texts, span)
                bounds = np.searchsorted(which, np.arange(len(texts) + 1))
                keep = np.zeros(len(which), bool)
                for i, w in enumerate(wanted):
                    keep[bounds[i] : bounds[i + 1]] = np.isin(value[bounds[i] : bounds[i + 1]], w)
                which, place, count, value = which[keep], place[keep], count[keep], value[keep]
                parts: list[bytes | None] = [texts[i][p : p + n + span - 1] for i, p, n in zip(which, place, count, strict=True)]
                group = (value % np.uint64(groups)).astype(np.int32)
                own = k[which]
                for i, (part, id_) in enumerate(zip(parts, own.tolist(), strict=True)):
                    first = sent.get(part)
                    if first is not None and first < id_:
                        parts[i], group[i] = None, (id_ + i) % groups
                    elif first is None or id_ < first:
                        held += len(part) + 100 if first is None else 0
                        sent[part] = id_
                if held > SENT_BYTES:
                    sent, held = {}, 0
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(own, pa.int64()), pa.array(c1[which], pa.int64()), pa.array(place, pa.int32()), pa.array(count + span - 1, pa.int32()), pa.array(parts, pa.binary())], ["grp", "k", "c1", "place", "size", "part"])

    return run


def suffixes(parts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `span` bytes of every full suffix of the parts, and the part each is from."""
    data, starts = joined(parts)
    counts = np.diff(starts) - span + 1
    which = np.repeat(np.arange(len(parts)), counts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(np.r_[0, counts[:-1]]), counts) + starts[which]
    windows = np.lib.stride_tricks.sliding_window_view(data, span)[place]
    return np.ascontiguousarray(windows).view(f"S{span}").reshape(-1), which


def repeated_stretches(span: int):
    """Byte ranges whose suffixes start in a text of a smaller id; stretches arrive in order of group and id."""

    def of_group(k: np.ndarray, place: np.ndarray, size: np.ndarray, parts: list[bytes | None], base: int, family: Family, whole: dict[bytes, int]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        novel: list[int] = []
        for i, part in enumerate(parts):
            if part is None:
                out.append((i, int(place[i]), int(place[i]) + int(size[i])))
                continue
            digest = hashlib.blake2b(part, digest_size=16).digest()
            if whole.setdefault(digest, int(k[i])) < k[i]:
                out.append((i, int(place[i]), int(place[i]) + len(part)))
            else:
                novel.append(i)
        for at in range(0, len(novel), 20_000):
            some = novel[at : at + 20_000]
            keys, which = suffixes([parts[i] for i in some], span)
            row = np.array(some)[which]
            owners = k[row]
            distinct, lowest = sort_min(keys, owners)
            found, before = family.find(distinct)
            gone = np.minimum(before, lowest)[np.searchsorted(distinct, keys)] < owners
            family.add(distinct[~found], lowest[~found])
            offset = np.arange(len(row)) - np.searchsorted(which, which)
            edge = np.flatnonzero((np.diff(np.r_[False, gone, False].astype(np.int8)) != 0) | np.r_[True, (row[1:] != row[:-1]), True])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if gone[a]:
                    out.append((int(row[a]), int(place[row[a]] + offset[a]), int(place[row[a]] + offset[b - 1] + span)))
        return [(base + i, a, b) for i, a, b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, family, whole = None, Family(), {}
        for batch in batches:
            grp, k, place, size = (batch.column(c).to_numpy() for c in ("grp", "k", "place", "size"))
            edges = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            out: list[tuple[int, int, int]] = []
            for low, high in zip(edges, edges[1:], strict=False):
                if low < high:
                    if grp[low] != current:
                        current, family, whole = grp[low], Family(), {}
                    out += of_group(k[low:high], place[low:high], size[low:high], batch.column("part").slice(low, high - low).to_pylist(), low, family, whole)
            who = [o[0] for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(k[who], pa.int64()), batch.column("c1").take(pa.array(who, pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["k", "c1", "start", "end"])

    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in sliced(batch):
            rows = []
            for text, ranges in zip(texts, batch.column("ranges").slice(low, high - low).to_pylist(), strict=True):
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for r in sorted(ranges or (), key=lambda r: (r["start"], r["end"])):
                    if r["start"] > end:
                        kept.append(text[at : r["start"]])
                        spans += 1
                        removed += r["end"] - r["start"]
                    else:
                        removed += max(0, r["end"] - end)
                    at = end = max(end, r["end"])
                kept.append(text[at:])
                rows.append((len(text), removed, spans, b"".join(kept)))
            size, removed, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Of every document: its size, removed bytes, maximal removed runs and what is left."""
    text = text_of(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text).alias("c1"), text.alias("text"))
    light = settle(keyed.select("k", "c1", F.xxhash64(F.lit(1), "text").alias("c2"), F.octet_length("text").cast("long").alias("size")), "light")
    first = light.groupBy("c1", "c2").agg(F.min("k").alias("first"), F.first("size").alias("size"))
    total = light.agg(F.sum("size")).first()[0] or 0
    groups, finer = -(-total // GROUP_BYTES), -(-total // STRETCH_BYTES)
    parts_of = [min(PARTITIONS, max(8, n // each)) for n, each in zip((groups, finer), TOGETHER, strict=True)]
    groups, finer = max(3 * 8, groups), max(LEAST_GROUPS, finer)
    copies = light.filter(F.col("size") >= span).join(first.select("c1", "c2", "first"), ["c1", "c2"]).filter("k > first").select("k", "c1", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")).distinct()

    pieces = keyed.select("c1", "text").mapInArrow(send_pieces(groups, span), "grp int, owners binary, of binary, pieces binary")
    shared = pieces.repartition(parts_of[0], "grp").sortWithinPartitions("grp").mapInArrow(shared_pieces, "c1 long, pieces binary").join(first.select("c1", F.col("first").alias("k")), "c1")
    wanted = shared.groupBy("k", "c1").agg(F.collect_list("pieces").alias("shared"))
    # The same columns as in the last join, so that both use one exchange of the texts.
    parts = keyed.join(wanted, ["k", "c1"]).select("doc_id", "k", "c1", "text", "shared").mapInArrow(send_stretches(span, finer), "grp int, k long, c1 long, place int, size int, part binary")
    repeats = parts.repartition(parts_of[1], "grp").sortWithinPartitions("grp", "k").mapInArrow(repeated_stretches(span), "k long, c1 long, start long, end long")
    ranges = repeats.unionByName(copies).groupBy("k", "c1").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return keyed.join(ranges, ["k", "c1"], "left").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats removed from all documents."""
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
