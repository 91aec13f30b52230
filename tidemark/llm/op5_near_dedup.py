"""MinHash near-dedup with sequential Bayesian verification.

Every text becomes the set of its word shingles (64-bit hashes), and a MinHash signature. Texts with equal sets form a class;
what follows works on one row per class. Signatures are banded; the number of bands follows from the threshold and the
chosen miss probability. In a bucket not all pairs are made: first every member meets the bucket's hub (the member that
shares most buckets). Of the members of hubs that this leaves in different components, those outside the hub's largest component
meet each other and those inside it, while those inside it, connected already, don't meet; so a large group of copies costs its size
times the number outside it. They meet in blocks of bounded size, inside a task: first
their signatures, which leaves those with a likely partner, then their sets; only the links that connect come out.

Candidates are verified in sequence. Signatures (one byte per hash) are compared batch by batch, and a pair is dropped as
soon as the posterior probability that it reaches the threshold falls below the miss probability (uniform prior, so the
posterior is a binomial tail). Survivors are confirmed on full sets, made anew from whole texts.

Cases: without words (or text) a set is empty and links with nothing; with fewer words than a shingle the sequence is the
only one; null ids never become a component's id unless there is no other; repeated rows share a class; an empty table
gives an empty result; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, documents, release, settle, text_of
from tidemark.llm.components import connected_components

SHINGLE, ROWS, MISS = 5, 5, 1e-6
#: Members of a hub in a block; two blocks are compared in one task.
BLOCK = 128
#: Hubs up to which their sizes are broadcast to the members: some 50 MB.
BROADCAST_HUBS = 1_000_000
#: Bytes of text whose shingles are made at once; the arrays take some hundred times as much.
SLICE = 500_000
LAST = 2**63 - 1
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 9 <= c <= 13 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    h ^= h >> np.uint64(32)
    return h


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, and where each text's begin; within a text they are sorted."""
    line = b" ".join(t.translate(FOLD) for t in texts) + b" "
    data = np.frombuffer(line, np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = data == 0x20
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & ~np.r_[True, space[:-1]])
    power = np.full(len(data), np.uint64(BASE))
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(len(data), np.uint64(INVERSE))
    back[0] = 1
    np.cumprod(back, out=back)
    words = mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
    first = np.searchsorted(begin, starts)
    count = np.diff(first)
    shingles = np.where(count > 0, np.maximum(1, count - size + 1), 0)
    text = np.repeat(np.arange(len(texts)), shingles)
    offset = np.cumsum(np.r_[0, shingles])
    at = np.arange(len(text)) - offset[text] + first[text]
    last = first[text + 1]
    h = np.minimum(count[text], size).astype(np.uint64)
    for j in range(size):
        inside = at + j < last
        h = mixed(h * MIX[2] + np.uint64(j)) if j else h
        h = h + np.where(inside, words[np.minimum(at + j, max(0, len(words) - 1))] if len(words) else 0, np.uint64(0)) * MIX[3]
    h = mixed(h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """The fewest bands of so many rows with which a pair at the threshold is missed with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, hashes: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """After so many compared hashes, the fewest matches with which the posterior still allows the threshold.

    Bytes also match by chance. P(p >= t | m of n match) is the chance that at most m of n + 1 trials succeed at t.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t))
        out.append((n, m))
    return out


def sliced(*columns: pa.Array, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a row in turn, null as empty, in portions of about `size` bytes that part no row, with the number of the first row.

    Only a portion is held as Python objects at a time.
    """
    raw = [c.cast(pa.binary()) for c in columns]
    at, rows = 0, len(raw[0])
    while at < rows:
        part: list[bytes] = []
        end, total = at, 0
        while end < rows:
            row = [c[end].as_py() or b"" for c in raw]
            total += sum(map(len, row))
            if end > at and total > size:
                break
            part += row
            end += 1
        yield at, part
        at = end


def sketch(bands: int, rows: int, size: int):
    draw = np.random.default_rng(20)
    factor = draw.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in sliced(batch.column("text")):
                h, first = shingle_sets(part, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                signature = np.zeros((len(part), bands * rows), np.uint32)
                sums = np.zeros((2, len(part)), np.uint64)
                if len(full):
                    begin = first[:-1][full]
                    for k in range(bands * rows):
                        signature[full, k] = np.minimum.reduceat((h * factor[k] + shift[k]) >> np.uint64(32), begin).astype(np.uint32)
                    sums[0, full] = np.add.reduceat(mixed(h + MIX[4]), begin)
                    sums[1, full] = np.add.reduceat(mixed(h + MIX[5]), begin)
                keys = np.zeros((len(part), bands), np.uint64)
                for b in range(bands):
                    keys[:, b] = b + 1
                    for r in range(rows):
                        keys[:, b] = mixed(keys[:, b] * MIX[6] + signature[:, b * rows + r])
                low = (signature & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), batch.column("text_hash").slice(at, len(part)), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).reshape(-1))), pa.array([row.tobytes() for row in low], pa.binary())],
                    ["doc_id", "text_hash", "n", "h1", "h2", "bands", "signature"],
                )

    return run


def compared(steps: list[tuple[int, int]]):
    """Pairs whose signatures stay above the bounds of every batch, with the number of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("left", "right"))
            alive, matches, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for upto, least in steps:
                matches[alive] += (a[alive, before:upto] == b[alive, before:upto]).sum(1)
                alive, before = alive[matches[alive] >= least], upto
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive)), pa.array(matches[alive], pa.int64())], ["a", "b", "matches"])

    return run


def confirmed(percent: int, size: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in sliced(batch.column("left"), batch.column("right")):
                h, first = shingle_sets(part, size)
                good = []
                for i in range(len(part) // 2):
                    x, y = h[first[2 * i] : first[2 * i + 1]], h[first[2 * i + 1] : first[2 * i + 2]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(at + i)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(good, pa.int64())), batch.column("b").take(pa.array(good, pa.int64()))], ["a", "b"])

    return run


def prune(pairs: DataFrame, classes: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    sides = [classes.select(F.col("node").alias(x), F.col("signature").alias(y)) for x, y in (("a", "left"), ("b", "right"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(compared(steps), "a long, b long, matches long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    sides = [texts.select(F.col("node").alias(x), F.col("text").alias(y)) for x, y in (("a", "left"), ("b", "right"))]
    return pairs.select("a", "b").join(sides[1], "b").join(sides[0], "a").select("a", "b", "left", "right").mapInArrow(confirmed(percent, size), "a long, b long")


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One whole text of each class among nodes. Ids may repeat with other texts, so the set's fingerprint is checked."""
    wanted = nodes.join(classes.select("node", "k", "h1", "h2"), "node")
    held = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("k"), "text").join(wanted, "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            for at, part in sliced(batch.column("text")):
                h, first = shingle_sets(part, size)
                same = []
                for i in range(len(part)):
                    own = h[first[i] : first[i + 1]]
                    sums = [mixed(own + MIX[k]).sum(dtype=np.uint64).view(np.int64) for k in (4, 5)]
                    if sums[0] == h1[at + i] and sums[1] == h2[at + i]:
                        same.append(i)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at).take(pa.array(same, pa.int64())), pa.array([part[i] for i in same], pa.binary())], ["node", "text"])

    return held.mapInArrow(run, "node long, text binary").dropDuplicates(["node"])


def in_blocks(members: DataFrame, counted: DataFrame, block: int, broadcast_hubs: int = BROADCAST_HUBS):
    """Members of each hub in blocks of bounded size, grouped by pairs of blocks.

    The first blocks hold the members outside the hub's largest component, the others those inside it. Every two members meet
    in one group, but for those that are both inside. counted: the members' (hub, label), settled. Sizes of hubs are broadcast only if counted to be few: a join on
    the hub would bring a large one's members into one task.
    """
    each = counted.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = each.groupBy("hub").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside"))
    tops = settle(tops.filter("outside > 0").select("hub", "top", *(F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("inside", "outside"))), "tops")
    sizes = F.broadcast(tops) if tops.count() <= broadcast_hubs else tops.hint("shuffle_merge")
    is_in = F.col("label") == F.col("top")
    spread = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    own = members.join(sizes, "hub").withColumn("own", F.when(is_in, F.col("outside") + spread("inside")).otherwise(spread("outside")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_in, F.col("outside")).otherwise(F.col("outside") + F.col("inside")) - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "top", "inside", "outside").groupBy("hub", "i", "j")


def sides_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group; the same rows twice where a block meets itself."""
    own = table.column("own").to_numpy()
    return np.flatnonzero(own == table.column("i")[0].as_py()), np.flatnonzero(own == table.column("j")[0].as_py())


def plausible(steps: list[tuple[int, int]]):
    """Members with a partner of another component that the signatures don't rule out, batch by batch."""

    def run(table: pa.Table) -> pa.Table:
        x, y = sides_of(table)
        label = table.column("label").to_numpy()
        bytes_ = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        alive = label[x][:, None] != label[y][None, :]
        matches = np.zeros(alive.shape, np.int16)
        before = 0
        for upto, least in steps:
            if not alive.any():
                break
            for k in range(before, upto):
                matches += bytes_[x, k][:, None] == bytes_[y, k][None, :]
            alive &= matches >= least
            before = upto
        return table.select(["hub", "node", "label"]).take(pa.array(np.unique(np.r_[x[alive.any(1)], y[alive.any(0)]])))

    return run


def differences(size: int):
    """The shingles that a member and its hub don't share, and the size of the member's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in sliced(batch.column("left"), batch.column("right")):
                h, first = shingle_sets(texts, size)
                own = [(h[first[i] : first[i + 1]], h[first[i + 1] : first[i + 2]]) for i in range(0, len(texts), 2)]
                part = batch.slice(at, len(own))
                yield pa.RecordBatch.from_arrays([part.column("hub"), part.column("node"), part.column("label"), pa.array([len(y) for _, y in own], pa.int64()), pa.array([np.setxor1d(x, y, assume_unique=True).tobytes() for x, y in own], pa.binary())], ["hub", "node", "label", "n", "unlike"])

    return run


def spanning(percent: int):
    """Enough of the links between a group's components to connect what is linked.

    x and y differ in what one of them alone doesn't share with the hub, so the size of x - y is known exactly from their
    differences with it, and only shared differences need counting.
    """

    def run(table: pa.Table) -> pa.Table:
        x, y = sides_of(table)
        label, n, node = (table.column(c).to_numpy() for c in ("label", "n", "node"))
        sets = [np.frombuffer(b, np.uint64) for b in table.column("unlike").to_pylist()]
        sizes = np.array([len(u) for u in sets])
        tokens, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, rows = tokens[order], rows[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)])
        ends = np.r_[first[1:], len(tokens)][: len(first)]
        place_x, place_y = np.full(len(sets), -1), np.full(len(sets), -1)
        place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
        shared = np.zeros((len(x), len(y)), np.int32)
        for a, b in zip(first[ends - first > 1], ends[ends - first > 1], strict=True):
            u, v = place_x[rows[a:b]], place_y[rows[a:b]]
            shared[np.ix_(u[u >= 0], v[v >= 0])] += 1
        total = n[x][:, None] + n[y][None, :]
        both = (total - sizes[x][:, None] - sizes[y][None, :]) // 2 + shared
        linked = (100 * both >= percent * (total - both)) & (label[x][:, None] != label[y][None, :])
        out: list[tuple[int, int]] = []
        known = {int(k): int(k) for k in label}

        def top(k: int) -> int:
            while known[k] != k:
                known[k] = known[known[k]]
                k = known[k]
            return k

        for i in np.flatnonzero(linked.any(1)):
            partners = np.flatnonzero(linked[i])
            _, one = np.unique(label[y[partners]], return_index=True)
            for j in partners[one]:
                p, q = top(int(label[x[i]])), top(int(label[y[j]]))
                if p != q:
                    known[p] = q
                    out.append((int(node[x[i]]), int(node[y[j]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, rows: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; sets link at percent / 100 similarity or more."""
    threshold = percent / 100
    bands = bands_for(threshold, rows, miss)
    steps = least_matches(threshold, bands * rows, 4 * rows, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"), "text")
    rows_of = settle(docs.mapInArrow(sketch(bands, rows, size), "doc_id long, text_hash long, n long, h1 long, h2 long, bands array<long>, signature binary"), "sketches")
    grouped = rows_of.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    placed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    live = settle(placed.join(shared, "bucket"), "buckets")
    degree = live.groupBy("node").agg(F.sum("members").alias("degree"))
    hubs = live.join(degree, "node").groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("hub_n")), F.struct("degree", "node")).alias("h")).select("bucket", "h.*")
    met = settle(live.join(hubs, "bucket").select("bucket", "node", "n", "hub", "hub_n"), "hubs")
    release(live)
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")  # else the sets can't reach it
    starred = met.filter((F.col("node") != F.col("hub")) & alike).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    likely = settle(prune(starred, classes, steps), "likely")

    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = settle(texts_of(docs, classes, ends, size), "texts")
    links = settle(confirm(likely, texts, percent, size), "links")
    release(likely, texts)
    labels = connected_components(links)

    # What the hubs left: members of torn buckets, by hub. Signatures show who may still have a partner, then sets decide.
    named = met.join(labels, "node", "left").select("bucket", "hub", "node", F.coalesce("label", "node").alias("label"))
    torn = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket")
    stars = settle(named.join(torn, "bucket").filter("node <> hub").select("hub", "node", "label").distinct(), "stars")
    release(met)
    signed = stars.join(classes.select("node", "signature"), "node").select("hub", "node", "label", "signature")
    open_ = settle(in_blocks(signed, stars, block).applyInArrow(plausible(steps), "hub long, node long, label long").distinct(), "open")
    ends = open_.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    texts = settle(texts_of(docs, classes, ends, size), "texts")
    sides = [texts.select(F.col("node").alias(x), F.col("text").alias(y)) for x, y in (("hub", "left"), ("node", "right"))]
    apart_from_hub = open_.join(sides[1], "node").join(sides[0], "hub").select("hub", "node", "label", "left", "right").mapInArrow(differences(size), "hub long, node long, label long, n long, unlike binary")
    first, links = links, settle(links.unionByName(in_blocks(apart_from_hub, open_, block).applyInArrow(spanning(percent), "a long, b long")), "links")
    release(first, stars, open_, texts)
    labels = connected_components(links)

    held = classes.select("h1", "h2", "node", "k").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = held.groupBy("label").agg(F.min("k").alias("lowest"))
    known = held.join(lowest, "label").select("h1", "h2", F.when(F.col("lowest") < LAST, F.col("lowest")).alias("component_id"), F.col("label").alias("component"))
    alone = rows_of.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"), "text_hash")
    return rows_of.filter("n > 0").join(known, ["h1", "h2"]).select("doc_id", "n", "component_id", "component", "text_hash").unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component", "text_hash",
    )


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each group of near copies: that of the smallest id.

    Rows without words all stay. Equal rows of one id are one group, so one of them stays.
    """
    chosen = near_duplicates(docs, percent).filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("_tidemark_id"), F.col("c.text_hash").alias("_tidemark_same"))
    hashed = docs.withColumn("_tidemark_hash", F.xxhash64(text_of(docs)))
    has_words = F.length(F.btrim(text_of(docs), F.lit(ASCII_SPACE))) > 0
    kept = hashed.filter(has_words).join(chosen, hashed["doc_id"].eqNullSafe(chosen["_tidemark_id"]) & (F.col("_tidemark_hash") == F.col("_tidemark_same")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_tidemark_hash"]).unionByName(hashed.filter(~has_words)).select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, at a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir), percent=85).select("doc_id", "n_shingles", "component_id", "kept")
