"""Benchmark decontamination, natively, by template canonicalisation.

A text becomes template tokens: numbers, names (capitalised words inside a sentence) and units (after a number) become typed
placeholders, other words are lower-cased. Windows of five tokens with at least three plain words are hashed and joined
with the benchmark's. A document leaks an item if it holds at least `cover` of the item's distinct windows and the slots
agree, both ways: wherever the item has one value behind a placeholder, the document has one value too, and wherever the document
has one, the item has. So an item is also caught
when its numbers, names and units were replaced throughout, but not where only the pattern of a table recurs. Every window
of an item keeps its place and values: slots are held against those at the aligned places of the document, one occurrence of the item at a
time, and the best one counts; and once against those of all places.

Items with fewer than five template tokens, or without a window of three plain words, are found by their whole sequence of
words, numbers and signs as it stands, wherever a document holds it.

The benchmark's windows are broadcast only if counted to be at most `broadcast_rows`; beyond that the join shuffles.

Cases: null and empty texts have no windows; a text or item with fewer than five tokens is one window; items without words,
numbers and signs of arithmetic are never found; equal rows are reported once; ties are kept; an empty table gives an empty result; other columns are
ignored; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, let, settle, text_of

WINDOW, PLAIN, COVER, AGREE = 5, 3, 0.8, 0.8
BROADCAST_ROWS = 1_000_000
# Units of measure, money and time.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "pound", "pounds", "cent", "cents", "percent", "meter", "meters", "metre", "metres", "mile", "miles", "degree", "degrees", "kb", "mb", "gb", "hz", "kw", "w", "v")
# A capitalised word inside a sentence, a number, a unit after a number; marks that stand for them, and what parts tokens.
NAME = r"(?<=[\p{L}\p{N},;:)] )\p{Lu}[\p{Ll}\p{M}]+"
NUMBER = r"[0-9]+(?:[.,:][0-9]+)*"
UNIT = rf"(?<=# {{1,4}})({'|'.join(UNITS)})\b"
MARKS = {"@n": NAME, "#": NUMBER, "@u": UNIT}
FILLED = {"@n": "names", "#": "numbers", "@u": "units"}
# Tokens of short items, which are compared as they stand, and how many of them a document is first searched for.
LITERAL = r"[\p{L}\p{M}\p{N}]+(?:[.,:]\p{N}+)*|[-+*/=<>%^×÷−]"
LEAD = 3
GAP = r"[^\p{L}\p{M}#@]+"


def template(text: Column) -> tuple[Column, dict[str, Column]]:
    """Template tokens, and for each mark the text from which its values are taken, in order."""
    line = F.translate(text, "#@", "  ")
    sources = {"@n": line}
    line = F.lower(F.regexp_replace(line, NAME, " @n "))
    sources["#"] = line
    line = F.regexp_replace(line, NUMBER, " # ")
    sources["@u"] = line
    line = F.regexp_replace(line, UNIT, " @u ")
    return F.filter(F.split(line, GAP), lambda t: t != ""), sources


def cut(tokens: Column, make) -> Column:
    """make(first place) for every window; a short sequence is one window, an empty one has none."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.greatest(F.size(tokens) - WINDOW, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, make)


def window_hashes(text: Column) -> Column:
    """Hashes of the template windows of a text."""
    tokens, _ = template(text)
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: cut(h, lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(WINDOW)))))


def windows(text: Column) -> Column:
    """Array of (hash, slots, pos) of the windows with enough plain words; slots are the values behind a window's marks, in order."""
    tokens, sources = template(text)
    values = F.struct(tokens.alias("tokens"), *(F.transform(F.regexp_extract_all(sources[m], F.lit(p), F.lit(0)), F.lower).alias(FILLED[m]) for m, p in MARKS.items()))

    def whole(v: Column) -> Column:
        marks = F.struct(*(F.filter(F.sequence(F.lit(0), F.size(v["tokens"])), lambda i: F.get(v["tokens"], i) == mark).alias(k) for mark, k in FILLED.items()))  # noqa: B023  called at once

        def typed(places: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                value = F.lit(None).cast("string")
                for mark, k in FILLED.items():
                    value = F.when(t == mark, F.get(v[k], F.array_position(places[k], i).cast("int") - 1)).otherwise(value)
                return F.struct(t.alias("t"), value.alias("v"))

            return let(F.transform(v["tokens"], one), made)

        return let(marks, typed)

    def made(tokens: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(tokens, i + 1, F.lit(WINDOW))
            slots = F.transform(F.filter(part, lambda s: s["v"].isNotNull()), lambda s: s["v"])
            return F.struct(F.xxhash64(F.transform(part, lambda s: F.xxhash64(s["t"]))).alias("hash"), F.size(part).alias("size"), slots.alias("slots"), i.alias("pos"))

        return F.filter(cut(tokens, one), lambda w: w["size"] - F.size(w["slots"]) >= F.least(F.lit(PLAIN), F.size(tokens)))

    return let(values, whole)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, pos, hash, slots, n_windows, n_places), one row per window of an item; n_windows counts distinct hashes."""
    each = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.explode(windows(text_of(benchmark))).alias("w")).select("item_id", "w.pos", "w.hash", "w.slots").distinct()
    return each.join(each.groupBy("item_id").agg(F.countDistinct("hash").alias("n_windows"), F.count(F.lit(1)).alias("n_places")), "item_id")


KEYS = ("doc_id", "text_hash", "item_id")


def agreements(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per group the smaller of two shares of slots: those whose document value mostly stands for their item value, and those
    whose item value mostly stands behind their document value. Equal texts have 1. pairs has an array s of both values."""
    told = pairs.select(*keys, F.explode_outer("s").alias("s")).groupBy(*keys, F.col("s.item_slots").alias("value"), F.col("s.slots").alias("other")).agg(F.count("s").alias("n"))
    sides = told.select(*keys, "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("value").alias("of")), F.struct(F.lit(1).alias("side"), F.col("other").alias("of")))).alias("v"))
    each = sides.groupBy(*keys, "v").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    shares = each.groupBy(*keys, F.col("v.side").alias("side")).agg(F.coalesce(F.sum("best") / F.sum("n"), F.lit(1.0)).alias("share"))
    return shares.groupBy(*keys).agg(F.min("share").alias("agreement"))


def aligned(met: DataFrame, cover: float) -> DataFrame:
    """The best agreement of any one occurrence that covers enough of an item's places.

    An occurrence is a group of hits at the same distance from the document's start and the item's, or, as words may be put
    in or left out, at distances within a fifth of the item; there each place of the item takes one hit, first
    one with the same values, then the one of the least distance. Bands overlap by half.
    """
    offset, band = F.col("at") - F.col("pos"), F.greatest(F.lit(2), F.ceil((1 - cover) * F.col("n_places")))
    spans = F.array(*(F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("k")) for kind, k in enumerate((offset, F.floor(offset / band), F.floor(offset / band + 0.5)))))
    each = met.withColumn("offset", offset).withColumn("other", F.col("slots") != F.col("item_slots")).withColumn("span", F.explode(spans))
    best = each.groupBy(*KEYS, "n_places", "span", "pos").agg(F.min(F.struct("other", "offset", "item_slots", "slots")).alias("b"))
    hits = best.groupBy(*KEYS, "n_places", "span").agg(F.count(F.lit(1)).alias("found"), F.flatten(F.collect_list(F.arrays_zip("b.item_slots", "b.slots"))).alias("s"))
    return agreements(hits.filter(F.col("found") >= cover * F.col("n_places")), *KEYS, "span").groupBy(*KEYS).agg(F.max("agreement").alias("agreement"))


def literal(text: Column) -> Column:
    """Hashes of words, numbers and signs of arithmetic, as they stand but for case."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(LITERAL), F.lit(0)), lambda t: F.xxhash64(t))


def runs(hashes: Column, size: Column) -> Column:
    """Hashes of all runs of `size` tokens."""
    places = F.when(F.size(hashes) >= size, F.sequence(F.lit(0), F.size(hashes) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i + 1, size)))


def short_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, whole, lead, start) of items with fewer than five template tokens or no window of enough plain words."""
    text = text_of(benchmark)
    few = (F.size(template(text)[0]) < WINDOW) | (F.size(windows(text)) == 0)
    each = benchmark.filter(few).select(F.col("item_id").cast("long").alias("item_id"), literal(text).alias("h")).filter("item_id IS NOT NULL AND size(h) > 0")
    lead = F.least(F.size("h"), F.lit(LEAD))
    return each.select("item_id", F.size("h").alias("n"), F.xxhash64("h").alias("whole"), lead.alias("lead"), F.xxhash64(F.slice("h", F.lit(1), lead)).alias("start")).distinct()


def find_short(keyed: DataFrame, benchmark: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """(doc_id, item_id, text_hash) of documents that hold a short item as it stands; None without such items.

    Documents are cut into runs of at most LEAD tokens once; only those that hold an item's start are cut at its own length.
    """
    items = settle(short_items(benchmark), "short")
    leads = sorted(r["lead"] for r in items.select("lead").distinct().collect())
    if not leads:
        return None
    side = F.broadcast if items.count() <= broadcast_rows else lambda x: x.hint("shuffle_merge")

    def led(hashes: Column, k: int) -> Column:
        return F.transform(runs(hashes, F.lit(k)), lambda x: F.struct(F.lit(k).alias("lead"), x.alias("start")))

    starts = let(literal(F.col("text")), lambda h: F.array_distinct(F.concat(*(led(h, k) for k in leads))))
    seen = keyed.select("doc_id", "text_hash", F.explode(starts).alias("s")).select("doc_id", "text_hash", "s.lead", "s.start")
    close = seen.join(side(items.select("lead", "start", "n").distinct()), ["lead", "start"]).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("same"), "n").distinct()
    held = keyed.join(close, keyed["doc_id"].eqNullSafe(close["id"]) & (keyed["text_hash"] == close["same"]))
    cuts = held.select("doc_id", "text_hash", "n", F.explode(let(literal(F.col("text")), lambda h: F.array_distinct(runs(h, F.col("n"))))).alias("whole"))
    return cuts.join(side(items.select("n", "whole", "item_id")), ["n", "whole"]).select("doc_id", "item_id", "text_hash").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, agree: float = AGREE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, coverage, agreement, text_hash) of every document that leaks an item."""
    items = settle(benchmark_windows(benchmark), "benchmark")
    small = items.count() <= broadcast_rows
    side = F.broadcast if small else lambda x: x.hint("shuffle_merge")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    seen = keyed.select("doc_id", "text_hash", F.explode(window_hashes(F.col("text"))).alias("hash"))
    met = seen.join(side(items.select("hash", "item_id", "n_windows").distinct()), "hash").groupBy("doc_id", "text_hash", "item_id", "n_windows", "hash").agg(F.lit(1))
    covered = settle(met.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= cover * F.col("n_windows")), "covered")
    # Only texts that hold enough of an item with slots are looked at again, for the values in them.
    open_items = items.filter(F.size("slots") > 0).select("item_id").distinct()
    wanted = covered.join(open_items, "item_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("same")).distinct()
    held = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["id"]) & (keyed["text_hash"] == wanted["same"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    filled = settle(held.select("doc_id", "text_hash", F.explode(windows(F.col("text"))).alias("w")).select("doc_id", "text_hash", "w.hash", "w.slots", F.col("w.pos").alias("at")), "filled")
    whole = items.filter(F.size("slots") > 0).groupBy("item_id", "hash").agg(F.min("slots").alias("item_slots"))
    pooled = agreements(filled.join(side(whole), "hash").select(*KEYS, F.arrays_zip("item_slots", "slots").alias("s")), *KEYS)
    placed = aligned(filled.join(side(items.join(open_items, "item_id", "left_semi").select("hash", "item_id", "pos", "n_places", F.col("slots").alias("item_slots"))), "hash"), cover)
    slots = pooled.unionByName(placed).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("same"), F.col("item_id").alias("item")).agg(F.max("agreement").alias("agreement"))
    found = covered.join(slots, covered["doc_id"].eqNullSafe(slots["id"]) & (covered["text_hash"] == slots["same"]) & (covered["item_id"] == slots["item"]), "left")
    leaks = found.select("doc_id", "item_id", (F.col("found") / F.col("n_windows")).alias("coverage"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"), "text_hash").filter(F.col("agreement") >= agree)
    exact = find_short(keyed, benchmark, broadcast_rows)
    if exact is None:
        return leaks
    both = leaks.unionByName(exact.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("agreement"), "text_hash"))
    return both.groupBy("doc_id", "item_id", "text_hash").agg(F.max("coverage").alias("coverage"), F.max("agreement").alias("agreement")).select(*leaks.columns)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item.

    Ids and hashes of leaking rows are broadcast only if counted to be at most `broadcast_rows`, so no text is shuffled; beyond
    that the join shuffles. Rows with null or empty texts stay; equal rows go or stay together; an empty table stays empty.
    """
    found = find_leaks(docs, benchmark, broadcast_rows=broadcast_rows)
    leaks = settle(found.select(F.col("doc_id").alias("_tidemark_leaked"), F.col("text_hash").alias("_tidemark_same")).distinct(), "leaks")
    side = F.broadcast(leaks) if leaks.count() <= broadcast_rows else leaks.hint("shuffle_merge")
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("_tidemark_leaked")) & (F.xxhash64(text_of(docs)) == F.col("_tidemark_same")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items, with the items."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
