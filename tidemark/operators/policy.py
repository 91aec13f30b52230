"""Schedules, token buckets, streaks, guards and monitoring figures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.sources.shared import settle

#: Requests that one task looks at.
BLOCK = 250_000


def scheduled_rates(times: DataFrame, rules: DataFrame, base: tuple[int, int]) -> DataFrame:
    """Global and per-peer rate for each (slot, day, minute): the first rule that matches, else the base rates.

    rules: (rule_idx, days array, begin, end, global_rate, peer_rate). A rule names days, so times meet only the rules of
    their weekday; the rules of a day are few and any of them may match.
    """
    daily = rules.select("rule_idx", "begin", "end", F.struct("global_rate", "peer_rate").alias("rates"), F.explode(P.days_of(F.col("days"))).alias("day"))
    listed = daily.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("rule_idx", "begin", "end", "rates"))).alias("rules"))
    hit = F.get(F.filter("rules", lambda r: P.in_minutes(F.col("minute"), r["begin"], r["end"])), F.lit(0))
    met = times.join(listed, "day", "left").withColumn("rates", hit["rates"])
    return met.select("slot", "day", "minute", F.coalesce("rates.global_rate", F.lit(base[0])).alias("global_rate"), F.coalesce("rates.peer_rate", F.lit(base[1])).alias("peer_rate"))


def policy_ticks(ticks: DataFrame, rules: DataFrame, base: tuple[int, int]) -> DataFrame:
    """Rates at each tick (node, slot, day, minute, has_space, said), and who holds the node paused after it.

    The guard pauses a node while there is no space and lets go by itself; an operator's pause (said = 'pause') stays until they
    say 'resume', and is never lifted by the guard. said is null at most ticks, and what was said last holds.
    """
    w = Window.partitionBy("node").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    told = F.last("said", ignorenulls=True).over(w)
    paused = F.when(told == "pause", "operator").when(~F.col("has_space"), "guard").otherwise("none")
    rated = scheduled_rates(ticks.select("slot", "day", "minute").distinct(), rules, base).select("slot", "global_rate", "peer_rate")
    return ticks.select("node", "slot", paused.alias("paused")).join(rated, "slot")


def _in_blocks(requests: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> tuple[DataFrame, int]:
    """Rows with the number _b of their block, which never falls in the given order, and how many blocks there are.

    Blocks are ranges of (keys, order) of about BLOCK rows, so requests of one moment may fall into several. They are
    settled, as the numbers are those of the tasks that wrote them.
    """
    n = -(-requests.count() // BLOCK)
    if n <= 1:
        return requests.withColumn("_b", F.lit(0)), 1
    return settle(requests.repartitionByRange(n, *keys, *order).withColumn("_b", F.spark_partition_id()), "blocks"), n


def token_bucket(requests: DataFrame, rate: float, keys: tuple[str, ...] = ("key",), ticks: int = 1) -> DataFrame:
    """Wait in seconds before each request (key, t, seq, amount in bytes) at `rate` bytes a second, 0 for no limit; t counts `ticks` a second.

    Credit grows with time up to a second's worth, and debt is admitted: left = min(burst, left + growth) - amount. Unrolled this
    is the running sum of growth - amount and the running minimum of burst - amount - that sum: no fold. Sums are exact decimals, in
    millionths of a byte, so they may be taken in blocks: a task looks at the requests of a block, and only a row for each
    block, with its sum and its minimum, is summed by key.
    """
    if rate == 0:
        return requests.withColumn("wait", F.lit(0.0))
    exact = lambda c: c.cast("decimal(38,6)")
    micros = F.col("t").cast("long") if ticks == 1_000_000 else F.round(F.col("t") * (1_000_000 / ticks)).cast("long")
    speed = F.lit(Decimal(str(rate))).cast("decimal(18,6)")
    cost = exact(F.col("amount").cast("decimal(25,6)") * F.lit(1_000_000).cast("decimal(8,0)"))
    burst = exact(F.lit(Decimal(str(rate)) * 1_000_000))
    blocks, n = _in_blocks(requests, keys, ("t", "seq"))
    by = [*keys, "_b"]
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    told = blocks.withColumn("_cost", cost).withColumn("_at", micros)
    sums = told.groupBy(*by).agg(exact(F.sum("_cost")).alias("_spent"), F.min("_at").alias("_low"))
    starts = sums.select(*by, F.coalesce(exact(F.sum("_spent").over(earlier)), exact(F.lit(0))).alias("_before"), F.coalesce(F.min("_low").over(every), F.lit(0)).alias("_first"))
    told = _met(told.repartition(n, *by) if n > 1 else told, starts, by)
    grown = exact((F.coalesce("_at", "_first") - F.col("_first")).cast("decimal(19,0)") * speed)
    told = told.withColumn("_sum", exact(grown - F.col("_before") - exact(F.sum("_cost").over(upto))))
    told = told.withColumn("_least", F.min(exact(burst - F.col("_cost") - F.col("_sum"))).over(upto))
    if n > 1:
        told = settle(told.drop("_before", "_first", "_cost", "_at"), "summed")
        lows = told.groupBy(*by).agg(F.min("_least").alias("_lowest"))
        told = _met(told, lows.select(*by, F.min("_lowest").over(earlier).alias("_lowest")), by)
        told = told.withColumn("_least", F.least("_least", "_lowest"))
    left = exact(F.col("_sum") + F.col("_least"))
    return told.select(*requests.columns, F.greatest(F.lit(0.0), -left.cast("double") / F.lit(float(rate) * 1e6)).alias("wait"))


def _met(rows: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what is known of their block; a key may be null."""
    named = blocks.select(*(F.col(c).alias(f"_at_{i}") for i, c in enumerate(by)), *(c for c in blocks.columns if c not in by))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{i}"))
    return rows.join(named, same).drop(*(f"_at_{i}" for i in range(len(by))))


def two_buckets(requests: DataFrame, global_rate: float, peer_rate: float) -> DataFrame:
    """Requests of peers (peer, t in microseconds, seq, amount) that pass a global bucket and then, when that lets them through, their peer's; wait is the sum.

    The global bucket is one sequence of all requests by nature; it is judged in blocks as any other.
    """
    through = token_bucket(requests.withColumn("_all", F.lit(0)), global_rate, ("_all",), 1_000_000).withColumnRenamed("wait", "global_wait").drop("_all")
    at_peer = through.withColumn("asked", F.col("t")).withColumn("t", F.col("t") + F.ceil(F.col("global_wait") * 1_000_000))
    out = token_bucket(at_peer, peer_rate, ("peer",), 1_000_000).withColumnRenamed("wait", "peer_wait")
    return out.withColumn("wait", F.col("global_wait") + F.col("peer_wait")).withColumn("t", F.col("asked")).drop("asked")


def streaks(series: DataFrame, flag: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive rows (key, t) for which flag holds: gaps and islands."""
    marked = series.withColumn("_f", F.coalesce(flag, F.lit(False)))
    w = Window.partitionBy("key").orderBy("t")
    island = F.sum((~F.col("_f")).cast("int")).over(w)
    return marked.withColumn("_i", island).filter("_f").groupBy("key", "_i").agg(F.count(F.lit(1)).alias("length"), F.min("t").alias("begin"), F.max("t").alias("end")).filter(F.col("length") >= least).drop("_i")


def rising_streaks(series: DataFrame, value: str, least: int) -> DataFrame:
    """Runs of strictly increasing values."""
    w = Window.partitionBy("key").orderBy("t")
    return streaks(series.withColumn("_up", F.col(value) > F.lag(value).over(w)), F.col("_up"), least)


def backoff(attempts: DataFrame, seed: int, floor: float = 0.25, base: float = 0.5, cap: float = 15.0) -> DataFrame:
    """A delay for each attempt n, uniform between the floor and the smaller of cap and base * 2^n."""
    top = F.greatest(F.lit(floor), F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.col("n"))))
    return attempts.withColumn("delay", F.lit(floor) + F.rand(seed) * (top - floor)).withColumn("most", top)


def p95(values: DataFrame, value: str, at_once: int = 1_000_000) -> DataFrame:
    """The element at index n * 95 / 100 of the sorted values, nulls left out.

    Approximate percentiles on either side of the rank, whose error is bounded, narrow the values down until at most `at_once` are
    left to sort; so no task sees more, whatever the number of values.
    """
    part, low, accuracy = values.select(F.col(value).alias("p95")).filter(F.col(value).isNotNull()), 0, 10_000
    n = part.count()
    rank, m = min(n * 95 // 100, max(0, n - 1)), n
    while m > at_once:
        share = (rank - low) / m
        a, b = part.agg(F.percentile_approx("p95", [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)], accuracy)).first()[0]
        if a == b:
            return part.filter(F.col("p95") == a).limit(1)
        counted = part.agg(F.count_if(F.col("p95") < a), F.count_if(F.col("p95").between(a, b))).first()
        part, low, m = part.filter(F.col("p95").between(a, b)), low + counted[0], counted[1]
    return part.orderBy("p95").offset(rank - low).limit(1)


def early_median(series: DataFrame, value: str, first: int = 10) -> DataFrame:
    """Median of a key's first readings, the window being the feature."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("t"))
    return series.withColumn("_n", n).filter(F.col("_n") <= first).groupBy("key").agg(F.median(value).alias("median"))


def deltas(series: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("t")
    return series.withColumn("delta", F.col(value) - F.lag(value).over(w))


def live_copy_ratio(index: DataFrame) -> DataFrame:
    """Copies among the live files; null without live files. One row."""
    live, kept = F.count_if(~F.col("tombstone")), F.count_if(~F.col("tombstone") & P.is_copy(F.col("path")))
    return index.agg(kept.alias("copies"), live.alias("live")).withColumn("ratio", F.when(F.col("live") > 0, F.col("copies") / F.col("live")))


def space_guard(disks: DataFrame, least: int, percent: float) -> DataFrame:
    return disks.withColumn("admitted", P.has_space(F.col("available"), F.col("capacity"), F.col("incoming"), least, percent))
