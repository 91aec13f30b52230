"""Quality rules, natively: base counts of a text, and a hashed n-gram log-likelihood ratio between two multinomials.

Words and word pairs hash into a fixed number of buckets. One multinomial is counted over all documents, the other over a
trusted target: rows labelled good, a sample bounded by `trusted_rows` (those with the smallest hash of doc_id). A
document's score is the mean over its n-grams of log p_target / p_raw, and every document is held against the same fixed
threshold; nothing is drawn at random. The table of ratios has as many entries as there are buckets, whatever the input.

Repeated three-word windows are found by sorting the windows' 64-bit hashes inside the row, so a long text costs n log n
and no text is shuffled.

Cases: null and empty texts have no words, fail the base rules and score 0; without trusted rows every ratio is 0; a
repeated row counts as often as it stands; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, documents, let, text_of

SYMBOLS = "#*$%&|<>"
BUCKETS = 8192
TRUSTED_ROWS = 20_000
#: Pseudo-counts that draw a bucket's target count to what the raw corpus leads to expect: rare buckets say little.
SMOOTHING = 20.0
THRESHOLD = -0.04
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """The bucket of every word and of every word with its successor (the last one with an end mark)."""
    size = F.lit(buckets).cast("long")
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, size).cast("int")),
        F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.coalesce(F.get(hashes, i + 1), F.lit(0).cast("long"))), size).cast("int")),
    )


def repeated_words(hashes: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more, given the words' hashes."""

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def repeated(ordered: Column) -> Column:
        same = lambda s, i: (F.get(ordered, i - 1)["h"] == s["h"]) | (F.get(ordered, i + 1)["h"] == s["h"])
        return covered(F.sort_array(F.transform(F.filter(ordered, same), lambda s: s["at"])))

    windows = F.transform(
        F.slice(hashes, F.lit(1), F.size(hashes) - 2),
        lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("at")),
    )
    return F.when(F.size(hashes) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), repeated))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` ids labelled good, by the smallest hashes: a bounded sample that follows from the ids alone."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """log p_target / p_raw of every bucket, the target's count smoothed towards the raw corpus."""
    bucket = let(words_of(text_of(docs)), lambda w: let(hashes_of(w), lambda h: ngram_buckets(h, buckets)))
    held = docs.join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    counts = held.select("trusted", F.explode(bucket).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    whole = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    filled = whole.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "target")))
    rows = filled.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("each")).select(
        F.when(F.col("targets") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(
            F.transform("each", lambda x: F.log((x["target"] + SMOOTHING) / (x["raw"] * F.col("targets") / F.col("raws") + SMOOTHING)))
        ).alias("ratios")
    )
    return rows.first()["ratios"]


def apply_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, the length-normalised log-likelihood ratio and the verdict on every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = F.lit(ratio_table(docs, trusted_ids(labels, trusted_rows), buckets))
    text = text_of(docs)

    def measured(words: Column) -> Column:
        def inner(h: Column) -> Column:
            total = F.aggregate(ngram_buckets(h, buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
            return F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"), F.when(F.size(h) > 0, total / (2 * F.size(h))).otherwise(F.lit(0.0)).alias("log_ratio"))

        return let(hashes_of(words), inner)

    found = docs.select(
        "doc_id", let(words_of(text), measured).alias("m"), without(text, ASCII_SPACE).cast("long").alias("word_chars"),
        (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"),
    ).select("doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.log_ratio")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the quality verdict of all documents."""
    return apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
