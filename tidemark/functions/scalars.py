"""Scalar functions on paths, codes, rates and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the operation types and names of the states.
OP_TYPES = {"write": 0, "delete": 1, "rename": 2}
LIFECYCLE = ("joining", "syncing", "active")
KINDS = {"regular": 0, "symlink": 1, "fifo": 2, "char": 3, "block": 4}
LANE_BYTES = 262_144


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(prefix: Column, child: Column) -> Column:
    return F.when(prefix == "", child).otherwise(F.concat(prefix, F.lit("/"), child))


def cas_path(hash_: Column) -> Column:
    return F.concat(F.substring(hash_, 1, 2), F.lit("/"), hash_)


def short_id(x: Column) -> Column:
    return F.substring(x, 1, 8)


def is_hex(x: Column, width: int) -> Column:
    return x.rlike(f"^[0-9a-f]{{{width}}}$")


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(x: Column, width: int | None = None) -> Column:
    """Bytes of hexadecimal digits of either case; null if malformed, of odd length or not `width` bytes."""
    good = x.rlike("^([0-9a-fA-F]{2})*$") & (F.lit(True) if width is None else F.length(x) == 2 * width)
    return F.when(good, F.unhex(x))


def state_code(state: Column) -> Column:
    """Place of a lifecycle state; null for an unknown name."""
    return F.when(state.isin(*LIFECYCLE), F.array_position(F.array(*map(F.lit, LIFECYCLE)), state).cast("int") - 1)


def state_name(code: Column) -> Column:
    return F.when((code >= 0) & (code < len(LIFECYCLE)), F.element_at(F.array(*map(F.lit, LIFECYCLE)), code + 1))


def op_code(op_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for kind, code in OP_TYPES.items():
        out = F.when(op_type == kind, code).otherwise(out)
    return out


def op_name(code: Column) -> Column:
    """An unknown code is corruption and gives null."""
    out = F.lit(None).cast("string")
    for kind, number in OP_TYPES.items():
        out = F.when(code == number, kind).otherwise(out)
    return out


def kind_code(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, code in KINDS.items():
        out = F.when(kind == k, code).otherwise(out)
    return out


def rate(text: Column) -> Column:
    """Bytes a second from a number with a decimal suffix k, m or g; null if malformed."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^([0-9]+)([kmg]?)$", 1)
    suffix = F.regexp_extract(low, r"^([0-9]+)([kmg]?)$", 2)
    factor = F.when(suffix == "k", 10**3).when(suffix == "m", 10**6).when(suffix == "g", 10**9).otherwise(1)
    return F.when(number != "", number.cast("long") * factor)


def minute_of_day(text: Column) -> Column:
    """HH:MM as minutes; null outside 00:00 to 24:00 or if malformed."""
    h, m = F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})$", 1), F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})$", 2)
    value = F.when(h != "", h.cast("int") * 60 + m.cast("int"))
    return F.when((value <= 1440) & (m.cast("int") < 60), value)


def mode_bits(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o7777))


def is_hole(data: Column) -> Column:
    """All bytes are zero."""
    return F.hex(data).rlike("^(00)*$")


def most_chunks(cap: Column | int) -> Column:
    return F.floor((F.lit(cap) if isinstance(cap, int) else cap) / 4096) + 2


def lane(size: Column, threshold: int = LANE_BYTES) -> Column:
    return F.when(size <= threshold, "priority").otherwise("bulk")


def relative(path: Column, root: Column) -> Column:
    """The path below root, or null if it is not below."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))
