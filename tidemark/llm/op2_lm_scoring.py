"""LM scoring by masked pseudo-likelihood.

A word is predicted from the three words at either side: embeddings, one per side and divided by the distance, are summed and
go through a tanh layer, and a hierarchical softmax over a Huffman tree gives the probability of the word itself. The tree is
canonical: in order of their codes leaves are in order of depth too, so a batch that is sorted once goes down the tree level by
level in plain slices, and rows that pass one node stand together. The
vocabulary has every word with at least sqrt(N) / 32 occurrences among the corpus's N words, so it grows with the corpus. A
rarer word is an escape leaf of the tree and then its spelling, byte by byte, by a trigram counted over all rarer words; so
each has a probability of its own. Only as a neighbour does a rarer word share its embedding with others, by a hash bucket.
A document's score is the sum of the log-probabilities of all its words.

Training passes over all documents, and hands on their ids and the scores of their rarer words, so that scoring need not read
texts again: each partition runs Adagrad over its own texts from the common network, and each row of
the network moves by the mean over the partitions that touched it. Changes are summed in blocks of rows by a shuffle, so the
driver sees one network. Network and vocabulary are sent to all workers and grow about as the root of the corpus.

Cases: null and empty texts have no words and score 0; equal texts score equally; bytes that are no UTF-8 count as replacement
characters; an empty corpus gives an empty result; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, portions, settle

SHARE, BUCKETS, WIDTH, STEPS, RATE = 32, 1024, 16, 1, 0.05
REACH, BATCH, BLOCK, TOP = 3, 10_000, 1024, 5
#: Bytes of text worked on at once, and different words that a task counts before it hands them on.
SLICE, COUNTED = 500_000, 500_000


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs without ASCII white space, in UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def split(texts: list[str]) -> pa.Array:
    """The words of each text as a list, with empty ones at a text's ends; Arrow's white space is that of words_of."""
    lowered = pa.array([t.lower().encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
    return pc.ascii_split_whitespace(lowered.view(pa.large_string()))


def different_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of all texts, the number of the one at each place, and how many words each text has."""
    parted = split(texts)
    coded = parted.flatten().view(pa.large_binary()).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    at, ends = coded.indices.to_numpy(), parted.offsets.to_numpy()
    if b"" in words:
        none = words.index(b"")
        full = at != none
        at, ends = at[full], np.concatenate([[0], np.cumsum(full)])[ends]
        at = at - (at > none)
        del words[none]
    return words, at, np.diff(ends).astype(np.int64)


def counted_words(docs: DataFrame) -> DataFrame:
    """(w, n): how often each word, in UTF-8, occurs in all documents; settled, as it is read three times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []

        def summed_up() -> pa.Table:
            return pa.concat_tables(seen).group_by("w", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["w", "n"])

        for batch in batches:
            for _, texts in portions(batch, SLICE):
                counts = split(texts).flatten().view(pa.large_binary()).value_counts()
                seen.append(pa.table({"w": counts.field("values").cast(pa.binary()), "n": counts.field("counts")}).filter(pc.field("w") != b""))
                if sum(map(len, seen)) > 2 * COUNTED:
                    seen = [summed_up()]
                    if len(seen[0]) > COUNTED:
                        yield from seen.pop().to_batches()
        if seen:
            yield from summed_up().to_batches()

    return settle(docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")


def vocabulary(counted: DataFrame, frequent: int | None) -> tuple[list[tuple[bytes, int]], int]:
    """Words with sqrt(N) / SHARE occurrences or more (or the `frequent` most frequent) and their counts, and how many other words occur."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    ordered = counted.orderBy(F.desc("n"), "w")
    held = ordered.limit(frequent) if frequent is not None else ordered.filter(F.col("n") >= max(2, math.ceil(math.sqrt(total) / SHARE)))
    words = [(bytes(r["w"]), r["n"]) for r in held.collect()]
    return words, total - sum(n for _, n in words)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (two bytes before, byte or end) for every byte and the end of all words, and how many each word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    # A word is preceded by two zero bytes; its end is symbol 256.
    line = np.frombuffer(b"\0\0" + b"\0\0\0".join(words) + b"\0", np.uint8).astype(np.int32)
    ends = np.cumsum(sizes + 2) - 1
    line[ends] = 256
    own = np.ones(len(line), bool)
    own[ends[:-1] + 1] = own[ends[:-1] + 2] = False
    return ((line[:-2] * 256 + line[1:-1]) * 257 + line[2:])[own[2:]], sizes


class Spelling:
    """Log-probabilities of a byte or the end after two bytes, from the counts of codes; a dense table, made where it is used."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts, self.table = codes, counts, None

    def __getstate__(self) -> dict:
        return {"codes": self.codes, "counts": self.counts, "table": None}

    def dense(self) -> np.ndarray:
        if self.table is None:
            table = np.full(256 * 256 * 257, 0.02, np.float32)
            table[self.codes] += self.counts.astype(np.float32)
            table = table.reshape(-1, 257)
            table /= table.sum(1, keepdims=True, dtype=np.float64).astype(np.float32)
            self.table = np.log(table, out=table).reshape(-1)
        return self.table

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word's spelling."""
        if not words:
            return np.zeros(0)
        code, sizes = trigrams(words)
        return np.add.reduceat(self.dense()[code].astype(float), np.cumsum(sizes) - sizes)


def spelling(counted: DataFrame, words: list[bytes]) -> Spelling:
    """The spelling of all words outside the vocabulary."""
    known = set(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist(), strict=True) if w not in known]
            if rows:
                code, sizes = trigrams([w for w, _ in rows])
                own, at = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.bincount(at, np.repeat(np.array([n for _, n in rows], float), sizes)), pa.float64())], ["code", "n"])

    rows = counted.mapInArrow(run, "code long, n double").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Spelling(rows.column("code").to_numpy(), rows.column("n").to_numpy())


class Ids(dict):
    """Word to id: 0 is the end mark, frequent words follow, then hash buckets."""

    def __init__(self, words: list[bytes], buckets: int) -> None:
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self.low, self.buckets, self.size = len(words) + 1, buckets, len(words) + 1 + buckets

    def __missing__(self, word: bytes) -> int:
        return self.low + zlib.crc32(word) % self.buckets

    def split(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The ids of words, and those outside the vocabulary."""
        own = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        outside = own < 0
        rare = list(compress(words, outside.tolist()))
        own[outside] = self.low + np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % self.buckets
        return own, rare


def framed(texts: list[str], ids: Ids) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Ids of all texts with REACH end marks at either side of each, the texts' lengths, their different words outside the vocabulary, and which of these stands at each place of one.

    A word that occurs again in the texts is looked up once.
    """
    words, at, lengths = different_words(texts)
    own, rare = ids.split(words)
    codes = own[at]
    flat = np.zeros(len(codes) + REACH * (len(texts) + 1), np.int64)
    flat[np.arange(len(codes)) + REACH * (1 + np.repeat(np.arange(len(texts)), lengths))] = codes
    return flat, lengths, rare, (np.cumsum(own >= ids.low) - 1)[at[codes >= ids.low]]


Network = dict[str, np.ndarray]


# The dense softmax over pairs of neighbours; its gradient stays tested, scores come from the tree.


def fresh(size: int, width: int) -> Network:
    draw = np.random.default_rng(7)
    return {"left": draw.normal(0, 0.3, (size, width)), "right": draw.normal(0, 0.3, (size, width)), "bias": np.zeros(width), "out": draw.normal(0, 0.1, (size, width)), "base": np.zeros(size)}


def forward(net: Network, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and log-probabilities of every word in the contexts."""
    size = len(net["base"])
    hidden = np.tanh(net["left"][contexts // size] + net["right"][contexts % size] + net["bias"])
    z = hidden @ net["out"].T + net["base"]
    z -= z.max(1, keepdims=True)
    return hidden, z - np.log(np.exp(z).sum(1, keepdims=True))


def gradient(net: Network, contexts: np.ndarray, counts: np.ndarray) -> tuple[float, Network]:
    """Log-likelihood of the counts and its gradient."""
    size = len(net["base"])
    hidden, logs = forward(net, contexts)
    error = counts - counts.sum(1, keepdims=True) * np.exp(logs)
    inner = (error @ net["out"]) * (1 - hidden**2)
    out = {"left": np.zeros_like(net["left"]), "right": np.zeros_like(net["right"]), "bias": inner.sum(0), "out": error.T @ hidden, "base": error.sum(0)}
    np.add.at(out["left"], contexts // size, inner)
    np.add.at(out["right"], contexts % size, inner)
    return float((counts * logs).sum()), out


def depths(counts: list[int]) -> np.ndarray:
    """Depth of each leaf in a Huffman tree of the counts."""
    size = len(counts)
    heap = [(max(n, 1), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * size, np.int64)
    for node in range(size, 2 * size - 1):
        (n, x), (m, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (n + m, node))
    depth = np.zeros(2 * size, np.int64)
    for node in range(2 * size - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:size]


def sortable(size: int) -> type:
    """The type of numbers below size that sorts fastest: short ones are sorted by radix."""
    return np.uint16 if size <= 65_536 else np.int64


class Tree:
    """Canonical Huffman tree of leaves by their counts: the nodes from the root to each leaf, and +1 or -1 for the side taken."""

    def __init__(self, counts: list[int]) -> None:
        self.length = depths(counts)
        weight = np.maximum(np.array(counts, float), 1)
        order = np.lexsort((-weight, self.length))
        #: Place of each leaf in order of code, which is also that of depth.
        self.rank = np.zeros(len(counts), sortable(len(counts)))
        self.rank[order] = np.arange(len(counts))
        codes, code, last = [], 0, 0
        for n in self.length[order].tolist():
            code, last = code << (n - last), n
            codes.append(code)
            code += 1
        self.start = np.cumsum(self.length) - self.length
        self.nodes, self.signs = np.zeros(int(self.length.sum()), np.int64), np.zeros(int(self.length.sum()), np.float32)
        priors, made = [], 0
        for depth in range(int(self.length.max(initial=0))):
            deep = [(leaf, c) for leaf, c in zip(order.tolist(), codes, strict=True) if self.length[leaf] > depth]
            leaves = np.array([leaf for leaf, _ in deep])
            above = [c >> int(self.length[leaf] - depth) for leaf, c in deep]
            side = np.array([1.0 if c >> int(self.length[leaf] - depth - 1) & 1 == 0 else -1.0 for leaf, c in deep], np.float32)
            own = np.cumsum([0, *(a != b for a, b in zip(above, above[1:], strict=False))])
            self.nodes[self.start[leaves] + depth], self.signs[self.start[leaves] + depth] = made + own, side
            both = [np.bincount(own, weight[leaves] * (side == s)) for s in (1, -1)]
            priors.append(np.log(both[0] / both[1]))
            made += int(own[-1]) + 1
        #: How many nodes, the first, stand at depths below TOP.
        self.top = sum(len(p) for p in priors[:TOP])
        self.prior = np.concatenate([*priors, np.zeros(0 if priors else 1)]).astype(np.float32)


def beginning(size: int, tree: Tree, width: int) -> Network:
    """Embeddings of either side, and weights of the tree's nodes; before training a word has its share of the corpus."""
    out = np.zeros((len(tree.prior), width + 1), np.float32)
    out[:, width] = tree.prior
    return {"near": np.random.default_rng(7).normal(0, 0.3, (size, 2 * width)).astype(np.float32), "out": out}


def segments(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of at most BATCH places with their neighbours at either side."""
    for at in range(REACH, len(codes) - REACH, BATCH):
        yield codes[at - REACH : min(at + BATCH, len(codes) - REACH) + REACH]


def gains(net: Network, tree: Tree, part: np.ndarray, back: bool) -> tuple[np.ndarray, Network]:
    """Log-probabilities of a stretch's words (an escape for those outside the vocabulary), or with `back` their gradient by row.

    The first levels, whose few nodes nearly all words pass, are one product of matrices; further down each level takes its own rows.
    """
    width, m = net["out"].shape[1] - 1, len(part) - 2 * REACH
    near = net["near"].take(part, 0)
    z = np.zeros((m, width), np.float32)
    for k in range(1, REACH + 1):
        z += (near[REACH - k : REACH - k + m, :width] + near[REACH + k : REACH + k + m, width:]) * np.float32(1 / k)
    own = part[REACH : REACH + m]
    place = np.flatnonzero(own)
    leaf = np.minimum(own[place], len(tree.length)) - 1
    order = np.argsort(tree.rank[leaf], kind="stable")
    place, leaf = place[order], leaf[order]
    length, start = tree.length[leaf], tree.start[leaf]
    if not len(place) or not length[-1]:
        return np.zeros(len(place)), {}
    hidden = np.ones((len(place), width + 1), np.float32)
    np.tanh(z.take(place, 0), out=hidden[:, :width])
    sums = np.zeros(len(place))
    top, first = net["out"][: tree.top], np.arange(len(place)) * tree.top
    product = (hidden @ top.T).reshape(-1)
    errors = np.zeros(product.shape, np.float32) if back else None
    rows, values, inner = [], [], None
    for depth in range(int(length[-1])):
        low = int(np.searchsorted(length, depth, "right"))
        at = start[low:] + depth
        nodes, signs = tree.nodes.take(at), tree.signs.take(at)
        if depth < TOP:
            cells = first[low:] + nodes
            x = product.take(cells) * signs
        else:
            seen, weights = hidden[low:], net["out"].take(nodes, 0)
            x = np.einsum("ij,ij->i", seen, weights) * signs
        if not back:
            sums[low:] += np.minimum(x, 0) - np.log1p(np.exp(-np.abs(x)))
            continue
        with np.errstate(over="ignore"):  # an infinite power is an error of 0
            error = signs / (1 + np.exp(x))
        if depth < TOP:
            errors[cells] = error
            continue
        if inner is None:
            inner = errors.reshape(-1, tree.top) @ top[:, :width]
            scaled = np.zeros((len(place), width + 1 + (width + 1) % 2), np.float32)
        inner[low:] += np.einsum("i,ij->ij", error, weights[:, :width])
        new = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        rows.append(nodes[new])
        np.multiply(error[:, None], seen, out=scaled[low:, : width + 1])
        values.append(run_sums(scaled[low:], new)[:, : width + 1])
    if not back:
        logs = np.empty(len(place))
        logs[order] = sums
        return logs, {}
    errors = errors.reshape(-1, tree.top)
    inner = errors @ top[:, :width] if inner is None else inner
    spread = np.zeros((m, width), np.float32)
    spread[place] = inner * (1 - hidden[:, :width] ** 2)
    grad = np.zeros_like(near)
    for k in range(1, REACH + 1):
        shared = spread * np.float32(1 / k)
        grad[REACH - k : REACH - k + m, :width] += shared
        grad[REACH + k : REACH + k + m, width:] += shared
    return sums[:0], {"near": summed(part, grad), "out": (np.concatenate([np.arange(tree.top), *rows]), np.concatenate([errors.T @ hidden, *values]))}


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at starts; two columns of 32 bits are added as one complex number, which takes half the time."""
    if values.dtype != np.float32 or values.shape[1] % 2:
        return np.add.reduceat(values, starts)
    return np.add.reduceat(values.view(np.complex64), starts).view(np.float32)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values of equal rows."""
    order = np.argsort(rows.astype(sortable(int(rows.max(initial=0)) + 1)), kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[starts], run_sums(values.take(order, 0), starts)


#: The model that this worker process has unpacked last, by name.
_unpacked: dict[str, tuple] = {}


def unpacked(name: str, sent) -> tuple:
    if name not in _unpacked:
        _unpacked.clear()
        _unpacked[name] = sent.value
    return _unpacked[name]


def train(docs: DataFrame, words: list[bytes], buckets: int, tree: Tree, width: int, steps: int, rate: float) -> Network:
    """Passes over all documents; after each the network moves by the mean of the partitions' moves, row by row."""
    return train_and_encode(docs, words, buckets, tree, width, steps, rate, None)[0]


def train_and_encode(docs: DataFrame, words: list[bytes], buckets: int, tree: Tree, width: int, steps: int, rate: float, spelled: Spelling | None) -> tuple[Network, DataFrame | None]:
    """The trained network, and with `spelled` (doc_id, codes, n_tokens, spelled) of every document from the first pass."""
    net = beginning(len(words) + 1 + buckets, tree, width)
    names = sorted(net)

    def moved(sent, name):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old, words, tree, spelled = unpacked(name, sent)
            now, power, ids = {k: v.copy() for k, v in old.items()}, {k: np.full_like(v, 1e-8) for k, v in old.items()}, Ids(words, buckets)
            for batch in batches:
                for at, texts in portions(batch, SLICE):
                    codes, n, rare, of = framed(texts, ids)
                    for part in segments(codes):
                        for k, (rows, g) in gains(now, tree, part, True)[1].items():
                            seen = power[k].take(rows, 0) + g * g
                            power[k][rows] = seen
                            now[k][rows] = now[k].take(rows, 0) + np.float32(rate) * g / np.sqrt(seen)
                    if spelled is not None:
                        yield encoded(batch.column("doc_id").slice(at, len(texts)), codes, n, spelled.score(rare)[of], ids.low)
            for i, k in enumerate(names):
                for at in range(0, len(now[k]), BLOCK):
                    delta = now[k][at : at + BLOCK] - old[k][at : at + BLOCK]
                    if delta.any():
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), pa.array([delta.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())], MOVED)

        return run

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for i, at, delta in zip(*(batch.column(c).to_pylist() for c in ("table", "at", "delta")), strict=True):
                values = np.frombuffer(delta, np.float32).reshape(-1, 2 * width if names[i] == "near" else width + 1).astype(float)
                own = total.setdefault((i, at), [np.zeros_like(values), np.zeros((len(values), 1))])
                own[0] += values
                own[1] += values.any(1, keepdims=True)
        for (i, at), (values, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), pa.array([(values / np.maximum(n, 1)).astype(np.float32).tobytes()], pa.binary())], ["table", "at", "delta"])

    kinds, texts_of = "table int, at long, delta binary", None
    for step in range(steps):
        sent = docs.sparkSession.sparkContext.broadcast((net, words, tree, spelled if step == 0 else None))
        made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(moved(sent, uuid.uuid4().hex), f"{kinds}, n_tokens long, spelled double")
        if spelled is not None and step == 0:
            made = settle(made, "moved")
            texts_of = made.filter("table = -1").select(F.col("at").alias("doc_id"), F.col("delta").alias("codes"), "n_tokens", "spelled")
        rows = made.filter("table >= 0").select("table", "at", "delta").repartition("table", "at").mapInArrow(together, kinds).collect()
        net = {k: v.copy() for k, v in net.items()}
        for r in rows:
            own = net[names[r["table"]]]
            values = np.frombuffer(r["delta"], np.float32).reshape(-1, own.shape[1])
            own[r["at"] : r["at"] + len(values)] += values
    return net, texts_of


MOVED = ["table", "at", "delta", "n_tokens", "spelled"]


def encoded(ids: pa.Array, codes: np.ndarray, n: np.ndarray, spelled: np.ndarray, low: int) -> pa.RecordBatch:
    """Rows (table -1, id, codes as 32-bit integers, number of words, summed scores of spellings) of the framed texts."""
    ends = REACH + np.cumsum(n + REACH) - REACH
    small = codes.astype(np.int32)
    blobs = [small[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
    of = np.repeat(np.arange(len(n)), n)[codes[codes > 0] >= low]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), -1), pa.int32()), ids, pa.array(blobs, pa.binary()), pa.array(n, pa.int64()), pa.array(np.bincount(of, spelled, len(n)).astype(float))], MOVED)


SCORED = "doc_id long, n_tokens long, log_score double, mean_log_score double"


def scored(ids: pa.Array, codes: np.ndarray, n: np.ndarray, spelled: np.ndarray, net: Network, tree: Tree) -> pa.RecordBatch:
    """Summed and mean log-probabilities of framed texts, given the sums of their spellings."""
    total = spelled.astype(float)
    if n.any():
        logs = np.concatenate([gains(net, tree, part, False)[0] for part in segments(codes)])
        some = np.flatnonzero(n)
        total[some] += np.add.reduceat(logs, (np.cumsum(n) - n)[some])
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(total), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_tokens", "log_score", "mean_log_score"])


def score_documents(docs: DataFrame, words: list[bytes], buckets: int, tree: Tree, net: Network, spelled: Spelling) -> DataFrame:
    """Summed and mean conditional log-probability of every whole text under any model."""
    sent, name = docs.sparkSession.sparkContext.broadcast((net, words, tree, spelled)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words, tree, spelled = unpacked(name, sent)
        ids = Ids(words, buckets)
        for batch in batches:
            for at, texts in portions(batch, SLICE):
                codes, n, rare, which = framed(texts, ids)
                of = np.repeat(np.arange(len(n)), n)[codes[codes > 0] >= ids.low]
                yield scored(batch.column("doc_id").slice(at, len(texts)), codes, n, np.bincount(of, spelled.score(rare)[which], len(n)), net, tree)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def score_encoded(texts: DataFrame, tree: Tree, net: Network) -> DataFrame:
    """The same from (doc_id, codes, n_tokens, spelled)."""
    sent, name = texts.sparkSession.sparkContext.broadcast((net, tree)), uuid.uuid4().hex
    pad = bytes(4 * REACH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tree = unpacked(name, sent)
        for batch in batches:
            n, spelled = (batch.column(c).to_numpy() for c in ("n_tokens", "spelled"))
            at = 0
            while at < len(n):
                end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), SLICE // 4, "right")) + at)
                blobs = batch.column("codes").slice(at, end - at).to_pylist()
                codes = np.frombuffer(pad + b"".join(b + pad for b in blobs), np.int32).astype(np.int64)
                yield scored(batch.column("doc_id").slice(at, end - at), codes, n[at:end], spelled[at:end], net, tree)
                at = end

    return texts.select("doc_id", "codes", "n_tokens", "spelled").mapInArrow(run, SCORED)


def score_corpus(docs: DataFrame, frequent: int | None = None, buckets: int = BUCKETS, width: int = WIDTH, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """Train on all documents, then score all documents."""
    counted = counted_words(docs)
    held, others = vocabulary(counted, frequent)
    words, tree = [w for w, _ in held], Tree([n for _, n in held] + [others])
    net, texts = train_and_encode(docs, words, buckets, tree, width, max(1, steps), rate, spelling(counted, words))
    return score_encoded(texts, tree, net)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of all documents."""
    return score_corpus(documents(spark, sf_dir))
