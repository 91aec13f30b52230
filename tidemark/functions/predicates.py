"""Predicates that decide which rows an operator may see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.digest import MARKER

STAGING = ".staging-"
# Kinds that are replicated, and error classes.
REPLICABLE = ("regular", "symlink", "fifo", "char", "block")
PERMANENT = ("too_large", "unsafe_path", "bad_manifest", "unsupported_kind", "hash_mismatch")
NONE = ("none", "")


def is_live(tombstone: Column) -> Column:
    return ~tombstone


def is_staging(path: Column) -> Column:
    return F.contains(F.substring_index(path, "/", -1), F.lit(STAGING))


def is_replicable(kind: Column) -> Column:
    return kind.isin(*REPLICABLE)


def is_safe_path(path: Column) -> Column:
    """Not empty, not absolute, and without parent components; dots and empty components are dropped first, as path parsing does."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce((F.length(path) > 0) & ~F.startswith(path, F.lit("/")) & (F.size(parts) > 0) & ~F.exists(parts, lambda p: p == ".."), F.lit(False))


def is_text_path(path: Column) -> Column:
    """Valid UTF-8 and not empty; path is binary."""
    return F.is_valid_utf8(path.cast("string")) & (F.length(path) > 0)


def within_cap(size: Column, cap: int) -> Column:
    return size <= cap


def is_copy(path: Column) -> Column:
    return F.contains(path, F.lit(f".{MARKER}-"))


def error_class(error: Column) -> Column:
    """ok, quarantine (will never succeed) or retry."""
    return F.when(error.isNull() | error.isin(*NONE), "ok").when(error.isin(*PERMANENT), "quarantine").otherwise("retry")


def has_space(available: Column, capacity: Column, incoming: Column, least: int, percent: float) -> Column:
    """What stays free after the write is at least the guard; unknown capacity fails closed."""
    guard = F.greatest(F.lit(float(least)), capacity * percent / 100)
    return F.coalesce(available - guard >= incoming, F.lit(False))


def ack_in_bounds(ack_origin: Column, own_origin: Column, up_to: Column, sent: Column) -> Column:
    """An ack counts only for one's own operations and not beyond what was sent."""
    return (ack_origin == own_origin) & (up_to <= sent)


def pushed_by_origin(origin: Column, peer: Column) -> Column:
    return origin == peer


# Names of the days from 0 for Sunday, and of groups of days.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
GROUPS = {"all": (0, 1, 2, 3, 4, 5, 6), "weekday": (1, 2, 3, 4, 5), "weekend": (0, 6)}


def days_of(words: Column) -> Column:
    """Numbers of the days that an array of names of days or groups stands for; unknown words stand for none."""
    table = F.create_map(*(x for word, days in (GROUPS | {d: (i,) for i, d in enumerate(DAYS)}).items() for x in (F.lit(word), F.array(*map(F.lit, days)))))
    return F.array_distinct(F.flatten(F.transform(words, lambda word: F.coalesce(F.element_at(table, word), F.array().cast("array<int>")))))


def in_minutes(minute: Column, begin: Column, end: Column) -> Column:
    """Half-open range of a day's minutes that may wrap at midnight; equal ends match nothing."""
    return F.when(begin <= end, (minute >= begin) & (minute < end)).otherwise((minute >= begin) | (minute < end))
