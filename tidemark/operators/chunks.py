"""Content plane: chunking, manifests, stores, missing chunks, assembly and dedup figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_MIN, CHUNK_AVG, CHUNK_MAX = 4096, 16384, 65536
PAGE = 4096


def fixed_chunks(files: DataFrame, size: int, whole: bool = False) -> DataFrame:
    """(file, idx, hash, len, body) of every chunk; an empty file has none. files: (file, content).

    Text is cut by characters, binary by bytes, in one pass over each file: rows carry a chunk, not the file. With `whole` every row
    has the hash of its whole file as well, from the same pass.
    """
    kind = files.schema["content"].dataType.simpleString()
    chunks = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    if kind == "binary":  # a character for each byte
        chunks = F.transform(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda c: F.encode(c, "ISO-8859-1"))
    total = [F.sha2("content", 256).alias("file_hash")] if whole else []
    each = files.select("file", *total, F.posexplode(chunks).alias("idx", "body"))
    return each.select("file", "idx", F.sha2("body", 256).alias("hash"), F.length("body").alias("len"), "body", *(["file_hash"] if whole else []))


def gear_table(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: gear hashing with normalised chunking, as published by Xia et al.

    The rolling hash depends on the last 64 bytes only, so it is computed for all places by doubling; what is left
    to do in order is to choose the next cut among the places whose hash has the masked bits zero.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = gear_table()[np.frombuffer(data, np.uint8)]
    shift = 1
    while shift < 64:
        older = np.concatenate([np.zeros(min(shift, n), np.uint64), h[:-shift]]) if n > shift else np.zeros(n, np.uint64)
        h = h + (older << np.uint64(shift))
        shift *= 2
    bits = max(1, average.bit_length() - 1)
    top = lambda k: np.uint64(((1 << k) - 1) << (64 - k))
    strict, loose = np.flatnonzero((h & top(bits + 2)) == 0), np.flatnonzero((h & top(max(1, bits - 2))) == 0)
    ends, begin = [], 0
    while begin < n:
        if n - begin <= least:
            ends.append(n)
            break
        normal, last = min(begin + average, n), min(begin + most, n)
        i = np.searchsorted(strict, begin + least)
        end = last
        if i < len(strict) and strict[i] < normal:
            end = int(strict[i]) + 1
        else:
            j = np.searchsorted(loose, max(normal, begin + least))
            if j < len(loose) and loose[j] < last:
                end = int(loose[j]) + 1
        ends.append(end)
        begin = end
    return ends


def content_chunks(files: DataFrame, least: int = CHUNK_MIN, average: int = CHUNK_AVG, most: int = CHUNK_MAX) -> DataFrame:
    """(file, idx, hash, len, body) of content-defined chunks; files: (file, content as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                data = content.as_py() or b""
                ends = cut_points(data, least, average, most)
                bodies = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(ends), batch.column("file").type), pa.array(range(len(ends)), pa.int32()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(bodies, pa.binary())], ["file", "idx", "len", "body"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "content").mapInArrow(run, f"file {kind}, idx int, len long, body binary").withColumn("hash", F.sha2("body", 256))


def manifests(chunks: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Chunk count and total length of each file."""
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("len").alias("total_len"))


def offsets(chunks: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))


def complete(headers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ordered chunk lists of the manifests that have all their chunks; a partial manifest counts as absent. headers: (file, chunk_count)."""
    have = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash", "len"))).alias("chunks"))
    met = headers.join(have, "file", "left").filter(F.coalesce("n", F.lit(0)) == F.col("chunk_count"))
    return met.select("file", "chunk_count", F.coalesce("chunks", F.array().cast("array<struct<idx:int,hash:string,len:int>>")).alias("chunks"))


def manifest_page(chunks: DataFrame, file: object, begin: int, count: int = PAGE) -> DataFrame:
    """A page of a manifest, which is the feature; never more than the cap."""
    return chunks.filter((F.col("file") == file) & (F.col("idx") >= begin) & (F.col("idx") < begin + min(count, PAGE)))


def store(have: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks to add: verified against their hash, each once, and not stored yet."""
    good = new.filter(F.sha2("body", 256) == F.col("hash")).dropDuplicates(["hash"])
    return good.join(have.select("hash"), "hash", "left_anti")


def verify_store(chunks: DataFrame) -> DataFrame:
    """Stored chunks with a flag for corrupt ones, which are quarantined."""
    return chunks.withColumn("corrupt", F.sha2("body", 256) != F.col("hash"))


def missing(chunks: DataFrame, have: DataFrame) -> DataFrame:
    return chunks.select("hash", "len").dropDuplicates(["hash"]).join(have.select("hash"), "hash", "left_anti")


def fetch_plan(chunks: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct chunks that are there already and that must be fetched, in number and bytes."""
    marked = chunks.select("hash", "len").dropDuplicates(["hash"]).join(have.select("hash").distinct().withColumn("here", F.lit(True)), "hash", "left")
    here = F.coalesce("here", F.lit(False))
    return marked.agg(F.count_if(here).alias("hits"), F.count_if(~here).alias("fetches"), F.coalesce(F.sum(F.when(~here, F.col("len"))), F.lit(0)).alias("fetch_bytes"))


def assemble(chunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Content of each file from its ordered chunks, with the number of chunks; files that lack a chunk don't appear."""
    met = chunks.select("file", "idx", "hash").join(bodies.select("hash", "body"), "hash")
    built = met.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("c"))
    whole = chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return built.join(whole, "file").filter(F.size("c") == F.col("n")).select("file", "n", F.array_join(F.transform("c", lambda x: x["body"]), "").alias("content"))


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["hash"]).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("len").alias("n_bytes"))


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """How much is referenced and how much must be stored; counted by hash first, so a hot chunk is one row."""
    each = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("len"))
    return each.agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.col("len")).alias("ref_bytes"), F.sum("len").alias("stored_bytes"))


def validate_manifest(chunks: DataFrame, largest: int, cap: int, page: int | None = None) -> DataFrame:
    """Verdict on every file's manifest, the first that holds: a chunk that is of another file hash than asked for (columns
    file_hash and asked, if there), a chunk of bad size, a total beyond the cap, a page that is empty between others, or ok.

    Lengths are positive or the manifest is bad, so a running total goes beyond the cap if the sum does.
    """
    other = F.bool_or(~F.col("file_hash").eqNullSafe(F.col("asked"))) if {"file_hash", "asked"} <= set(chunks.columns) else F.lit(False)
    pages = F.count_distinct(F.floor(F.col("idx") / page)) < F.floor(F.max("idx") / page) + 1 if page else F.lit(False)
    judged = chunks.groupBy("file").agg(other.alias("other"), F.bool_or((F.col("len") <= 0) | (F.col("len") > largest)).alias("bad_size"), (F.sum(F.greatest("len", F.lit(0))) > cap).alias("too_large"), pages.alias("empty_page"))
    verdict = F.when(F.col("other"), "other_file").when(F.col("bad_size"), "bad_size").when(F.col("too_large"), "too_large").when(F.col("empty_page"), "empty_page").otherwise("ok")
    return judged.select("file", verdict.alias("verdict"))


def validate_listing(children: DataFrame, page: int, longest: int, budget: int) -> DataFrame:
    """Verdict on every listed folder: too many entries, a name of bad length, or names beyond the byte budget."""
    return children.groupBy("prefix").agg(
        F.when(F.count(F.lit(1)) > page, "too_many").when(F.bool_or(~F.octet_length("name").between(1, longest)), "bad_name").when(F.sum(F.octet_length("name")) > budget, "too_large").otherwise("ok").alias("verdict")
    )


def tree_digest(files: DataFrame, at_once: int = 100_000) -> DataFrame:
    """One digest of a set of (file, hash): lines of buckets in order are hashed, and hashes of buckets again, by two digits a level.

    A bucket has the files whose hash starts with the same digits: two, or more if there are over `at_once` files for each.
    """
    digits, n = 2, files.count()
    while n > at_once * 16**digits:
        digits += 2
    line = F.concat("hash", F.lit("  "), F.col("file").cast("string"), F.lit("\n"))
    level = files.select(F.substring("hash", 1, digits).alias("bucket"), line.alias("line")).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("h"))
    for shorter in range(digits - 2, -1, -2):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "")
        upper = level.withColumn("upper", F.substring("bucket", 1, shorter))
        level = upper.groupBy("upper").agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("upper", "bucket") if shorter else level.agg(F.sha2(joined, 256).alias("digest"))
    return level
