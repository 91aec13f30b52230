"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lowers case, maps homoglyphs to Latin letters and digit substitutions back to the letters they stand for, and
turns everything that is no letter into blanks. The lexicon holds whole words and word beginnings; it is learned from
labelled rows outside the held-out fifth, at most `sample` of each label (those with the smallest hash of doc_id), and
has at most `terms` entries. Hits inside an exception phrase don't count. The sum of the weights over one plus the
logarithm of the text's length goes through a logistic curve fitted on the same sample.

Cases: null and empty texts have no hits and get the curve's value at 0; without labelled rows of both kinds, or without a term that tells them
apart, every score is 0;
equal texts get equal scores; bytes that are no UTF-8 count as replacement characters; an empty table gives an empty result; other columns are
ignored; texts are never cut.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, portions, settle

SAMPLE, TERMS = 10_000, 500
#: Bytes of text looked at together.
SLICE = 4_000_000
#: A term must occur in this many texts of the toxic sample and in this share of it, and be this many times likelier there.
LEAST, SUPPORT, LIFT = 6, 0.01, 12.0
PREFIXES = range(4, 10)
#: The intercept's upper bound: a text without hits is never predicted toxic.
NO_HIT = -0.1
# Homoglyphs (Cyrillic, Greek) by the Latin letter they resemble.
HOMOGLYPHS = {"a": "аα", "c": "сϲ", "e": "еε", "h": "һ", "i": "іι", "j": "ј", "k": "кκ", "m": "м", "n": "п", "o": "оοσ", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ"}
# Digits that stand for letters. l and 1 share the class of i, as 1 stands for both.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
# Harmless phrases that contain likely terms.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "pond scum", "clown fish", "class clown", "sore loser", "stupid question", "worthless check", "not stupid", "not worthless", "no idiot")
BETWEEN = re.compile(r"(?<=[^\W_])[@$](?=[^\W_])")
OUT = "doc_id long, held_out boolean, score double, predicted int, hits long, n_words long"


class Folding(dict):
    """Code point to code point, filled on demand: letters stay, what resembles a letter becomes it, the rest is blank."""

    def __init__(self) -> None:
        super().__init__({ord(x): ord(k) for k, v in HOMOGLYPHS.items() for x in v} | {ord(k): ord(v) for k, v in DIGITS.items()})
        self |= {0xFF41 + i: self.get(0x61 + i, 0x61 + i) for i in range(26)}

    def __missing__(self, code: int) -> int:
        self[code] = out = code if chr(code).isalpha() else 0x20
        return out


FOLDING = Folding()


def fold(text: str | None) -> str:
    """Folded words, with one blank around each."""
    low = (text or "").lower()
    if "@" in low or "$" in low:
        low = BETWEEN.sub(lambda m: "a" if m[0] == "@" else "s", low)
    return f" {' '.join(low.translate(FOLDING).split())} "


def candidates(line: str) -> set[str]:
    """Words with a blank at either side, and word beginnings with a blank before."""
    out: set[str] = set()
    for w in set(line.split()):
        if len(w) >= 3:
            out.add(f" {w[:24]} " if len(w) <= 24 else f" {w[:24]}")
        out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def machine(weights: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in EXCEPTIONS:
        found.add_word(fold(phrase), (len(fold(phrase)), None))
    for term, weight in weights.items():
        if term not in found:
            found.add_word(term, (len(term), weight))
    found.make_automaton()
    return found


def measure(found, line: str) -> tuple[int, float]:
    """Number and weight of the hits outside exception phrases."""
    hits: list[tuple[int, float]] = []
    harmless: list[tuple[int, int]] = []
    for end, (length, weight) in found.iter(line):
        if weight is None:
            harmless.append((end - length + 1, end))
        else:
            hits.append((end - length + 1, weight))
    if harmless:
        harmless.sort()
        starts, reach = [a for a, _ in harmless], list(accumulate((b for _, b in harmless), max))
        hits = [h for h in hits if not ((i := bisect_right(starts, h[0])) and h[0] < reach[i - 1])]
    return len(hits), sum(w for _, w in hits)


def n_words(line: str) -> int:
    """Words of a folded text."""
    return line.count(" ") - 1 if len(line) > 2 else 0


def strength(weight: float, words: int) -> float:
    return weight / (1 + math.log1p(words / 100))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Distinct texts of at most `sample` training rows of each label, with the label; settled, as it is read three times."""
    train = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0").select("doc_id", "toxic").distinct()
    few = [train.filter(f"toxic = {k}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    held = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id").filter("text IS NOT NULL")
    return settle(held.groupBy(F.sha2("text", 256).alias("same")).agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text")).select("toxic", "text"), "toxicity-sample")


def counts(docs: DataFrame) -> DataFrame:
    """Number of documents with each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for _, texts in portions(batch, SLICE):
                for text in texts:
                    total.update(candidates(fold(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> dict:
    """Weights of the lexicon and the logistic curve, from the bounded sample alone."""
    seen = sampled(docs, labels, sample)
    sizes = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {"weights": {}, "curve": None}
    support = max(LEAST, SUPPORT * sizes[1])
    frequent = counts(seen.filter("toxic = 1")).filter(F.col("n") >= support)
    both = frequent.join(counts(seen.filter("toxic = 0")).select("term", F.col("n").alias("clean")), "term", "left").select("term", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    # The bound is a little lower than the one below, which decides.
    strong = both.filter((F.col("n") + 0.5) / (sizes[1] + 1) >= 0.999 * LIFT * (F.col("clean") + 0.5) / (sizes[0] + 1)).collect()
    toxic, clean = {r["term"]: r["n"] for r in strong}, {r["term"]: r["clean"] for r in strong}
    weights: dict[str, float] = {}
    for term in sorted(toxic, key=lambda t: (len(t), t)):
        lift = ((toxic[term] + 0.5) / (sizes[1] + 1)) / ((clean.get(term, 0) + 0.5) / (sizes[0] + 1))
        if lift >= LIFT and not any(term[:n] in weights for n in range(2, len(term))):
            weights[term] = math.log(lift)
    weights = dict(sorted(weights.items(), key=lambda x: (-toxic[x[0]] * x[1], x[0]))[:terms])
    if not weights:
        return {"weights": {}, "curve": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine(weights)
        for batch in batches:
            for at, texts in portions(batch, SLICE):
                own = [strength(measure(found, x)[1], n_words(x)) for x in map(fold, texts)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, len(own)), pa.array(own, pa.float64())], ["toxic", "x"])

    points = seen.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, x double").groupBy("toxic", F.round("x", 4).alias("x")).count().collect()
    return {"weights": weights, "curve": logistic([(r["x"], r["toxic"], r["count"]) for r in points])}


def logistic(points: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method, on (x, label, count)."""
    import numpy as np

    x, y, n = (np.array(v, float) for v in zip(*sorted(points), strict=True))
    a, b = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (n * (y - p)) - ridge * n.sum() * b
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * n.sum() * np.eye(2), g)
        b += step
        if abs(step).max() < 1e-9:
            break
    return min(float(b[0]), NO_HIT), float(b[1])


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """Score and verdict on every whole text."""
    said = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(said)
        found = machine(known["weights"])
        a, b = known["curve"] or (-math.inf, 0.0)
        for batch in batches:
            for at, texts in portions(batch, SLICE):
                rows = []
                for line in map(fold, texts):
                    words = n_words(line)
                    hits, weight = measure(found, line)
                    z = a + b * strength(weight, words)
                    rows.append((1 / (1 + math.exp(-max(-500.0, z))), hits, words))
                score, hits, words = zip(*rows, strict=True)
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "held_out", "score", "predicted", "hits", "n_words"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold.

    Null and empty texts have no hits and stay; equal texts go or stay together; an empty table stays empty.
    """
    said, place = json.dumps(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(said)
        found = machine(known["weights"])
        a, b = known["curve"] or (-math.inf, 0.0)
        least = math.log(threshold / (1 - threshold))
        for batch in batches:
            clean = [a + b * strength(measure(found, x)[1], n_words(x)) < least for _, texts in portions(batch, SLICE, place) for x in map(fold, texts)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
