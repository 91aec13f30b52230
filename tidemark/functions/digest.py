"""Digests of canonical strings: every field carries its length, null is a dash, so no two field lists share a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "conflict"
NO_META = "-"
ZEROS = "0" * 64


def field(x: Column) -> Column:
    text = x.cast("string")
    return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))


def canonical(*columns: Column) -> Column:
    return F.concat(*map(field, columns))


def digest(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def op_id(origin: Column, seq: Column) -> Column:
    return digest(F.lit("op"), origin, seq)


def fresh_uuid(origin: Column, seq: Column, path: Column) -> Column:
    """Identity of a file that an operation brings into being."""
    return F.substring(digest(F.lit("uuid"), origin, seq, path), 1, 32)


def migrated_uuid(path: Column) -> Column:
    """Identity for rows that were written before identities existed: it follows from the path alone."""
    return F.substring(digest(F.lit("uuid-of"), path), 1, 32)


def meta_hash(*fields: Column) -> Column:
    """Digest of all metadata fields, or a constant where there is no metadata (the first field is null)."""
    return F.when(fields[0].isNull(), F.lit(NO_META)).otherwise(digest(F.lit("meta"), *fields))


def naming_hash(kind: Column, mode: Column, rdev: Column, target: Column, xattrs: Column) -> Column:
    """Digest of what names a copy: times and owners stay out. xattrs: canonical string of the sorted pairs."""
    return digest(F.lit("name"), kind, mode, rdev, target, xattrs)


def xattr_text(xattrs: Column) -> Column:
    """Canonical string of ARRAY<STRUCT<k,v>>, sorted by k."""
    return F.array_join(F.transform(F.array_sort(xattrs), lambda x: F.concat(field(F.hex(x["k"])), field(F.hex(x["v"])))), "")


def leaf_hash(path: Column, tombstone: Column, content: Column, uuid: Column, meta: Column, vv_text: Column) -> Column:
    """Mode and size stay out."""
    return digest(F.lit("leaf"), path, tombstone.cast("int"), content, uuid, meta, vv_text)


def copy_path(path: Column, content: Column, naming: Column) -> Column:
    """<stem>.<marker>-<16 hex><.ext>: only the last dot of the name starts an extension, a leading dot doesn't."""
    folder, name = F.regexp_extract(path, r"^(.*/)?([^/]*)$", 1), F.regexp_extract(path, r"^(.*/)?([^/]*)$", 2)
    tag = F.concat(F.lit(f".{MARKER}-"), F.substring(digest(content, naming), 1, 16))
    has_ext = name.rlike(r"^.+\.[^.]*$")
    stem = F.when(has_ext, F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 1)).otherwise(name)
    return F.concat(folder, stem, tag, F.when(has_ext, F.regexp_extract(name, r"^(.+)(\.[^.]*)$", 2)).otherwise(""))


def copy_uuid(path: Column) -> Column:
    return F.substring(digest(F.lit("copy"), path), 1, 32)


def copy_vv(path: Column) -> Column:
    """A copy's vector has one counter of a synthetic origin that follows from its path."""
    return F.map_from_arrays(F.array(F.substring(digest(F.lit("copy-origin"), path), 1, 32)), F.array(F.lit(1).cast("long")))


def certificate_fingerprint(der: Column) -> Column:
    return F.sha2(der, 256)
