"""Secret scans, natively: strong patterns stand alone, weak ones only with their complementary parts nearby.

Three base kinds (assign, access, hex) are reported wherever they match. Weak candidates (an identifier that is assigned
under a telling name, a value assigned under a weak name, an endpoint) are parts of a credential: a weak secret counts
when an identifier is in its scope, a weak identifier when a secret is, an endpoint when both are. Scope is a distance in
code points. The link is an interval join: spans go into bins as wide as the scope and meet in equal bins of the same
row; spans of one kind don't overlap, so a bin holds a bounded number of them.

Positions come from Java's own leftmost non-overlapping replacement: each match is put between two marks that no pattern
matches, the text is split at the marks, and lengths are summed.

Cases: null and empty texts have no spans; equal rows are kept apart by a row number; an empty table gives an empty
result; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, let, settle, text_of

SCOPE = 256
#: Pieces that are added up in one go; even, so that every block starts outside a match.
BLOCK = 512
#: Rows with spans, and their spans, up to which they are broadcast to the texts: some 100 MB.
BROADCAST_ROWS, BROADCAST_SPANS = 500_000, 2_000_000
# The base patterns.
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
PATTERNS = {"assign": f"{ASSIGN_HEAD}{VALUE}", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{32,}"}
# Weak parts of a credential.
WEAK = {
    "weak_id": rf"""(?i:access_?key(?:_?id)?|client_?id|account|user_?name|login|user)["']?\x20*[:=]\x20*["']?{VALUE}""",
    "weak_secret": rf"""(?i:private_?key|secret_?key|access_?secret|auth|credential|pwd|passphrase|signature)["']?\x20*[:=]\x20*["']?{VALUE}""",
    "endpoint": r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]+""",
}
KINDS = [*PATTERNS, *WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, pattern: str, valid) -> Column:
    """Start and end of the leftmost non-overlapping matches for which valid(match) holds; text is free of the marks.

    Pieces between marks are added up in blocks, as an array that grows by one copies itself: the work stays in proportion to
    the matches, however many a text has.
    """
    none = F.array().cast(SPAN)

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        grown = F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"] & valid(piece), grown).otherwise(a["out"]).alias("out"))

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("out")), step, lambda a: a["out"])

    def blocks(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda i: F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK)))

    def added(parts: Column) -> Column:
        sizes = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda n, piece: n + F.length(piece)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return let(starts, lambda at: F.flatten(F.transform(parts, lambda b, i: within(b, F.get(at, i)))))

    def found(pieces: Column) -> Column:
        return F.when(F.size(pieces) <= BLOCK, within(pieces, F.lit(0))).otherwise(let(blocks(pieces), added))

    pieces = F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "[\\x01\\x02]", -1)
    return F.when(text.rlike(pattern), let(pieces, found)).otherwise(none)


def scan_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every kind, one column each; values never leave the text."""
    marked = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("text_hash"), F.translate(text_of(docs), "\x01\x02", "\x03\x03").alias("text"))
    text = F.col("text")
    long_enough = {
        "assign": lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN_HEAD}({VALUE})$", 1)) >= 8,
        "access": lambda m: F.length(m) >= 16,
    }
    return marked.select("doc_id", "text_hash", *(spans(text, p, long_enough.get(k, lambda _: F.lit(True))).alias(k) for k, p in {**PATTERNS, **WEAK}.items()))


def link_parts(scanned: DataFrame, scope: int) -> DataFrame:
    """(row, kind, start, end) of the weak spans whose complementary parts stand within scope, by interval join."""
    some_weak = F.greatest(*(F.size(k) for k in WEAK)) > 0

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(ROLE[kind]).alias("role"), s["start"].alias("start"), s["end"].alias("end")))

    each = F.concat(*map(named, KINDS))
    parts = scanned.filter(some_weak).select("row", F.explode(each).alias("p")).select("row", "p.*")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = parts.filter(F.col("kind").isin(*WEAK)).select("*", bins(F.col("start") - scope, F.col("end") + scope).alias("bin"))
    other = parts.select("row", F.col("role").alias("with"), F.col("start").alias("from"), F.col("end").alias("to"), bins(F.col("start"), F.col("end")).alias("bin"))
    near = (F.col("role") != F.col("with")) & (F.greatest("start", "from") - F.least("end", "to") <= scope)
    met = weak.join(other, ["row", "bin"]).filter(near).groupBy("row", "kind", "role", "start", "end")
    has = met.agg(F.bool_or(F.col("with") == "id").alias("id"), F.bool_or(F.col("with") == "secret").alias("secret"))
    linked = F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return has.filter(linked).select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, base spans and all spans of every document; a span is (start, rank, kind, end), in order."""
    scanned = settle(scan_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("row", F.monotonically_increasing_id()), "spans")
    linked = link_parts(scanned, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))

    def listed(source: Column, kind: str | None) -> Column:
        def one(s: Column) -> Column:
            name = s["kind"] if kind is None else F.lit(kind)
            rank = F.array_position(F.lit(KINDS), name).cast("int")
            return F.struct(s["start"].alias("start"), rank.alias("rank"), name.alias("kind"), s["end"].alias("end"))

        return F.transform(source, one)

    base = F.concat(*(listed(F.col(k), k) for k in PATTERNS))
    more = F.coalesce(listed(F.col("linked"), None), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    return scanned.join(linked, "row", "left").select("doc_id", "text_hash", F.sort_array(base).alias("base"), F.sort_array(F.concat(base, more)).alias("all"))


def redact(docs: DataFrame, mark: str = "[SECRET]", broadcast_rows: int = BROADCAST_ROWS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """The rows of docs with every found span replaced by the mark, and n_chars, where it exists, counted anew.

    Spans are broadcast only if counted to be at most so many, in at most so many rows, so no text is shuffled; beyond that
    the join shuffles. Null and empty texts stay as they are; equal rows are redacted alike; an empty table stays empty.
    """
    spans_ = find_secrets(docs).filter(F.size("all") > 0)
    found = spans_.select(F.col("doc_id").alias("_tidemark_id"), F.col("text_hash").alias("_tidemark_same"), F.col("all").alias("_tidemark_spans")).dropDuplicates(["_tidemark_id", "_tidemark_same"])
    found = settle(found, "found")
    rows, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_tidemark_spans")), F.lit(0))).first()
    found = F.broadcast(found) if rows <= broadcast_rows and total <= broadcast_spans else found.hint("shuffle_merge")
    held = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_tidemark_id")) & (F.xxhash64(text_of(docs)) == F.col("_tidemark_same")), "left")
    text = docs["text"]

    # Each span with the furthest end before it: what lies between is kept, and a span that starts beyond it leaves a mark.
    def kept(ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.get(ends, i)
            return F.when(s["start"] >= before, F.concat(F.substring(text, before + 1, s["start"] - before), F.lit(mark))).otherwise("")

        return F.concat(F.array_join(F.transform("_tidemark_spans", piece), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    ends = F.aggregate("_tidemark_spans", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), s["end"]))))
    clean = let(ends, kept)
    out = held.withColumn("text", F.when(F.col("_tidemark_spans").isNotNull(), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_tidemark_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"]))
    return out.select(*docs.columns)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""

    def joined(x: str) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = find_secrets(documents(spark, sf_dir))
    counts = [F.aggregate("base", F.lit(0).cast("long"), lambda n, s: n + (s["kind"] == kind).cast("long")).alias(f"n_{kind}") for kind in PATTERNS]  # noqa: B023  called at once
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
