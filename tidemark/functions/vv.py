"""Version vectors as MAP<STRING,BIGINT> columns: absent counts as 0, and zeros are never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(vv: Column) -> Column:
    return F.map_filter(vv, lambda _, n: n > 0)


def get(vv: Column, node: Column) -> Column:
    return F.coalesce(F.element_at(vv, node), F.lit(0).cast("long"))


def increment(vv: Column, node: Column) -> Column:
    return F.map_concat(F.map_filter(vv, lambda k, _: k != node), F.map_from_arrays(F.array(node), F.array(get(vv, node) + 1)))


def is_empty(vv: Column) -> Column:
    return F.size(vv) == 0


def exceeds(a: Column, b: Column) -> Column:
    """Some counter of a is larger than b's."""
    return F.exists(F.map_keys(a), lambda k: F.element_at(a, k) > get(b, k))


def covers(a: Column, b: Column) -> Column:
    """a dominates or equals b.

    Not written as ~exceeds(b, a): inside a lambda over both, the optimiser takes exceeds(a, b) and exceeds(b, a) for the
    same expression, as it tells outer lambda variables apart by position only.
    """
    return F.forall(F.map_keys(b), lambda k: F.element_at(b, k) <= get(a, k))


def compare(a: Column, b: Column) -> Column:
    """dominates, dominated, equal or concurrent."""
    more, less = exceeds(a, b), ~covers(a, b)
    return F.when(more & less, "concurrent").when(more, "dominates").when(less, "dominated").otherwise("equal")


def dominates(a: Column, b: Column) -> Column:
    """a is strictly above b."""
    return exceeds(a, b) & covers(a, b)


def merge(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def key(vv: Column) -> Column:
    """Sorted entries: comparable, joinable and hashable, which maps are not."""
    return F.array_sort(F.map_entries(vv))


def text(vv: Column) -> Column:
    """node:counter, in order of node, joined by commas."""
    return F.array_join(F.transform(key(vv), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


def merged_by(df: DataFrame, keys: list[str], vv: str = "vv") -> DataFrame:
    """The merge of all vectors of each key: maxima by (key, node), which combine before the shuffle."""
    peaks = df.select(*keys, F.explode(vv).alias("node", "n")).filter("n > 0").groupBy(*keys, "node").agg(F.max("n").alias("n"))
    merged = peaks.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias(vv))
    return df.select(*keys).distinct().join(merged, keys, "left").withColumn(vv, F.coalesce(vv, F.create_map().cast("map<string,bigint>")))


def from_pairs(df: DataFrame, keys: list[str], node: str, counter: str) -> DataFrame:
    """Vectors from (node, counter) rows: zeros go, of repeated nodes the largest counter stays."""
    peaks = df.filter(F.col(counter) > 0).groupBy(*keys, node).agg(F.max(counter).cast("long").alias("n"))
    return peaks.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(node), F.col("n"))))).alias("vv"))
