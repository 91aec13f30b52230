"""License scans: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions.

A text becomes lower-case words joined by single blanks (bytes, so only A-Z change); phrases are searched with a blank at
either side, so a hit is always a run of whole words, and overlapping hits all count. Where the words of an identifier tag
occur, the expression after the tag is parsed from the text itself.

An expression counts only if all it names are identifiers of known form or own references (LicenseRef-).

Cases: null and empty texts have no words, no labels, score 0 and null positions; bytes that are no UTF-8 count as replacement characters; rows are independent, so ties and repeated rows
need no care; an empty table gives an empty result; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, portions

# Phrases of the contract with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, label and weight of evidence.
NOTICES = {
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "isc license": ("isc", 0.8),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by nd": ("cc-by-nd", 0.9),
    "licensed under cc0": ("cc0", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("proprietary", 0.7),
}
BASE_WEIGHT = 0.9
# How freely a licence allows reuse, by the head of its identifier.
FREEDOM = {"mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "cc0": 1.0, "unlicense": 1.0, "bsl": 1.0, "zlib": 1.0, "cc": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "gpl": 0.2, "agpl": 0.1}
# Forms of licence identifiers, by family; other words after a tag are prose.
IDENTIFIERS = (
    r"mit(-0|-cmu|-feh|-modern-variant)?", r"isc", r"0bsd", r"bsd-[1-4]-clause(-[a-z0-9-]+)?", r"apache-[12]\.[01]", r"[al]?gpl-[123]\.[01](-only|-or-later|\+)?", r"mpl-[12]\.[01](-no-copyleft-exception)?",
    r"epl-[12]\.0", r"eupl-1\.[012]", r"cddl-1\.[01]", r"cc0-1\.0", r"cc-by(-nc)?(-sa|-nd)?-[1-4]\.[05](-[a-z]+)?", r"gfdl-1\.[123](-only|-or-later)?", r"bsl-1\.0", r"busl-1\.1", r"unlicense", r"wtfpl", r"zlib",
    r"artistic-[12]\.0(-perl|-cl8)?", r"afl-[123]\.[0-2]", r"osl-[123]\.[01]", r"ofl-1\.[01]", r"odbl-1\.0", r"pddl-1\.0", r"postgresql", r"python-2\.0(\.1)?", r"psf-2\.0", r"openssl", r"php-3\.01?", r"ruby", r"vim", r"x11", r"ncsa", r"curl",
    r"ms-(pl|rl)", r"upl-1\.0", r"unicode-(dfs-201[56]|3\.0)", r"sspl-1\.0", r"ecl-[12]\.0", r"w3c", r"xnet", r"zpl-[12]\.[01]", r"blueoak-1\.0\.0", r"hpnd", r"libpng(-2\.0)?", r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+",
)
IDENTIFIER = re.compile("|".join(f"(?:{x})" for x in IDENTIFIERS))
TAG = "spdx license identifier"
TAGGED = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)")
SYMBOL = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}
#: A-Z to a-z, every byte that is no word byte to a blank.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Bytes of text looked at together.
SLICE = 4_000_000
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, freedom double"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found: dict[str, list[tuple[str, str, float]]] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label, weight))
    found.setdefault(TAG, []).append(("tag", "", 0.0))
    machine = ahocorasick.Automaton()
    for phrase, what in found.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 1, what))
    machine.make_automaton()
    return machine


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order, None if the expression is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for symbol in SYMBOL.findall(expression):
        low = symbol.lower()
        if symbol == "(":
            if not operand_next:
                return None
            stack.append(symbol)
        elif symbol == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif operand_next:
            out.append(symbol)
            operand_next = False
        else:
            break  # prose after the expression
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def freedom(identifier: str) -> float:
    low = identifier.lower()
    return next((v for k, v in FREEDOM.items() if low == k or low.startswith(f"{k}-")), 0.0)


def evaluate(postfix: list[str]) -> tuple[list[str], float] | None:
    """Labels in the expression, and its freedom: `or` takes the better side, `and` the worse, `with` loosens a licence.

    None if it names something that is no licence identifier; what stands after `with` is an exception, not a licence.
    """
    stack: list[tuple[list[str], float]] = []
    for symbol in postfix:
        if symbol in RANK:
            (_, right), (left_labels, left) = (last := stack.pop()), stack.pop()
            if symbol == "with":
                stack.append((left_labels, min(1.0, left + 0.3)))
            else:
                stack.append((left_labels + last[0], max(left, right) if symbol == "or" else min(left, right)))
        else:
            stack.append(([symbol.lower()], freedom(symbol)))
    labels, value = stack[-1]
    return (labels, value) if all(IDENTIFIER.fullmatch(x) for x in labels) else None


def scan(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.translate(FOLD).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, "", None
    line = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    doubt, tagged, at, seen = 1.0, False, 0, 0
    for end, (length, what) in automaton().iter(line):
        for kind, label, weight in what:
            doubt *= 1 - weight
            if kind == "base":
                begin = end - length
                if begin >= at:
                    seen += line.count(" ", at, begin)
                else:
                    seen = line.count(" ", 0, begin)
                at = begin
                starts.append(seen)
                base.add(label)
            elif kind == "tag":
                tagged = True
            else:
                labels.add(label)
    expressions: list[str] = []
    free: float | None = None
    if tagged:
        for m in TAGGED.finditer(raw.lower()):
            said = m[1].decode(errors="replace")
            if (postfix := to_postfix(said)) and (known := evaluate(postfix)):
                own, value = known
                labels.update(own)
                expressions.append(" ".join(postfix))
                free = value if free is None else min(free, value)
                doubt *= 0.05
    ordered = ",".join(sorted(base | labels, key=str.encode))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ordered, 1 - doubt, ";".join(expressions), free


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels by phrase, notice and expression, and how sure the evidence is."""
    names = [x.split()[0] for x in OUT.split(", ")][1:]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in portions(batch, SLICE):
                columns = zip(*map(scan, texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, OUT)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return scan_licenses(documents(spark, sf_dir))
