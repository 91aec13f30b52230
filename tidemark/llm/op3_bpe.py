"""BPE encoding and decoding by tree concatenation.

A vocabulary file of a public tokenizer is used as it is. White space ends every pre-token, so a text is encoded run by run (a
plain text pre-token by pre-token), and short runs come from a cache of bounded bytes that is filled in batches. Text longer
than a leaf is halved down to leaves, anywhere, even inside a word, only not before a combining mark. All leaves of a portion,
and of unsplit runs that are too long for the cache all their pieces, are encoded together in parallel threads. Then the tree is gone up
level by level: windows around all joins of a level are encoded anew, together, and those grow that don't yet agree with both
sides. A window agrees if it holds a unit (a run, or a token of a run that is too long for the cache) with the same place and ids
as the left half has, and one as the right half has. Neighbouring tokens of a BPE encoding also encode so on their own, and
a sequence in which all neighbours do is the encoding of its text; so splicing at shared units gives exactly the encoding
of the whole. A window is never narrower than twice the longest special token, so one that a join cuts is whole in it.

Tokens decode to their strings with a space between any two, as the library has it for a vocabulary without a decoder.

A worker holds one codec per file for all its tasks. Units of a long text are kept in arrays: some 20 bytes each.

Cases: null and empty texts have no tokens and decode to the empty string; strings of special tokens in a text become those
tokens, as the library has it; bytes that are no UTF-8 count as replacement characters; repeated rows are encoded alike; an
empty table gives an empty result; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, portions

LEAF, WINDOW, CACHED_RUN = 16_384, 64, 96
#: Bytes of cached runs in a worker, dictionary entries included, and what an entry takes beside its run and ids.
CACHE_BYTES, ENTRY = 64_000_000, 100
#: Bytes of text for which results are made and handed on together.
SLICE = 500_000
RUN = re.compile(r"[^ \t-\r]+")
#: Pre-tokens of lower-cased plain text, and what makes a text not plain.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")
ODD = re.compile(r"[^ \t-\r!-&(-~À-ÖØ-öø-ÿ]")


class Units(NamedTuple):
    """Runs or tokens in order: where each begins and ends, where its ids begin (and the last's end), and all ids."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def part(self, low: int, high: int) -> Units:
        return Units(self.begin[low:high], self.end[low:high], self.first[low : high + 1] - self.first[low], self.ids[self.first[low] : self.first[high]])

    def key(self, i: int) -> tuple[int, int, bytes]:
        return int(self.begin[i]), int(self.end[i]), self.ids[self.first[i] : self.first[i + 1]].tobytes()


def in_a_row(parts: list[Units]) -> Units:
    """Parts of one text as one sequence."""
    sizes = [len(p.ids) for p in parts]
    shift = np.cumsum([0, *sizes[:-1]]).astype(np.int32)
    first = np.concatenate([*(p.first[:-1] + s for p, s in zip(parts, shift, strict=True)), np.array([sum(sizes)], np.int32)])
    return Units(np.concatenate([p.begin for p in parts]), np.concatenate([p.end for p in parts]), first, np.concatenate([p.ids for p in parts]))


def is_plain(text: str) -> bool:
    """Only letters, digits and signs of Latin-1 whose pre-tokens PIECE finds: no apostrophes, no beginnings of special tokens."""
    return "<|" not in text and not ODD.search(text)


def before_marks(text: str, at: int, low: int) -> int:
    """The place at or before `at` where no run of combining marks is cut, which normalisation reorders as a whole."""
    while low < at < len(text) and unicodedata.combining(text[at]):
        at -= 1
    return at


def after_marks(text: str, at: int, high: int) -> int:
    while at < high and unicodedata.combining(text[at]):
        at += 1
    return at


class Leaf(NamedTuple):
    """A piece of a text that is encoded on its own."""

    text: str
    at: int
    plain: bool

    def spans(self) -> Iterator[re.Match[str]]:
        return (PIECE if self.plain else RUN).finditer(self.text.lower() if self.plain else self.text)


class Join:
    """Two neighbouring parts of a text that are becoming one."""

    def __init__(self, text: str, plain: bool, low: int, middle: int, high: int, left: Units, right: Units, width: int) -> None:
        self.text, self.plain, self.low, self.middle, self.high, self.left, self.right, self.width = text, plain, low, middle, high, left, right, width

    def window(self) -> Leaf:
        self.a = before_marks(self.text, max(self.low, self.middle - self.width), self.low)
        self.b = after_marks(self.text, min(self.high, self.middle + self.width), self.high)
        return Leaf(self.text[self.a : self.b], self.a, self.plain)

    def agreed(self, fresh: Units) -> Units | None:
        """The units of both parts together, if the window shares one with each; else None, and the window grows."""
        left, right = self.left, self.right
        at = {fresh.key(k): k for k in range(len(fresh.begin))}
        head = (0, 0) if self.a == self.low else None
        i = len(left.begin) - 1
        while head is None and i >= 0 and left.begin[i] >= self.a:
            if (k := at.get(left.key(i))) is not None:
                head = (i, k)
            i -= 1
        tail = (len(right.begin), len(fresh.begin)) if self.b == self.high else None
        j = 0
        while tail is None and j < len(right.begin) and right.end[j] <= self.b:
            if (k := at.get(right.key(j))) is not None:
                tail = (j, k)
            j += 1
        if head is not None and tail is not None and head[1] <= tail[1]:
            return in_a_row([left.part(0, head[0]), fresh.part(head[1], tail[1]), right.part(tail[0], len(right.begin))])
        self.width *= 2
        return None


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, cached_run: int = CACHED_RUN, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if self.lib.decoder is not None:
            raise ValueError(f"{path}: only vocabularies without a decoder are read")
        self.lib.no_truncation()
        self.lib.no_padding()
        longest = max((len(t.content) for t in self.lib.get_added_tokens_decoder().values()), default=0)
        self.leaf, self.window, self.cached_run, self.cache_bytes = leaf, max(window, 2 * longest), cached_run, cache_bytes
        names = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]
        self.names, self.ends_word = pa.array(names, pa.string()), [t.endswith("</w>") for t in names]
        #: Two generations: what the younger lacks is moved up from the older, and the older is dropped when the younger is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def remember(self, run: str, ids: bytes) -> None:
        self.held += ENTRY + sys.getsizeof(run) + sys.getsizeof(ids)
        if self.held > self.cache_bytes // 2:
            self.young, self.old, self.held = {}, self.young, ENTRY + sys.getsizeof(run) + sys.getsizeof(ids)
        self.young[run] = ids

    def learn(self, runs: Iterable[str], plain: bool) -> None:
        """Put what is new among the runs into the cache, in parallel batches."""
        new = [r for r in set(runs) if r not in self.young and r not in self.old]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = self.words(part) if plain else [e.ids for e in self.lib.encode_batch(part, add_special_tokens=False)]
            for r, x in zip(part, ids, strict=True):
                self.remember(r, b"".join([i.to_bytes(4, "little") for i in x]))

    def words(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pre-tokens, encoded as lines of many: the last token of each is marked as the end of a word."""
        lines = [pieces[at : at + 500] for at in range(0, len(pieces), 500)]
        out: list[list[int]] = []
        for line, e in zip(lines, self.lib.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            found: list[list[int]] = [[]]
            for i in e.ids:
                found[-1].append(i)
                if self.ends_word[i]:
                    found.append([])
            if len(found) != len(line) + 1 or found.pop():
                found = [x.ids for x in self.lib.encode_batch(line, add_special_tokens=False)]
            out += found
        return out

    def look_up(self, run: str, plain: bool) -> bytes:
        found = self.young.get(run)
        if found is None:
            found = self.old.get(run)
            if found is None:
                self.learn([run], plain)
                return self.young[run]
            self.remember(run, found)
        return found

    def long_runs(self, runs: list[str]) -> Iterator[Units]:
        """Of each run a unit for each token, or for tokens that share a character; encoded in parallel threads."""
        for e in self.lib.encode_batch(runs, add_special_tokens=False):
            place = np.array(e.offsets, np.int32).reshape(-1, 2)
            reach = np.maximum.accumulate(place[:, 1]) if len(place) else place[:, 1]
            new = np.flatnonzero(np.r_[True, place[1:, 0] >= reach[:-1]][: len(place)])
            last = np.r_[new[1:], len(place)][: len(new)] - 1
            yield Units(place[new, 0], reach[last], np.r_[new, len(place)].astype(np.int32), np.array(e.ids, np.uint32))

    def together(self, leaves: list[Leaf]) -> list[Units]:
        """The units of all leaves, or of windows: new short runs are learned in one batch, long ones encoded in another."""
        for plain in (True, False):
            self.learn((m[0] for x in leaves if x.plain == plain for m in x.spans() if m.end() - m.start() <= self.cached_run), plain)
        long = dict.fromkeys(m[0] for x in leaves for m in x.spans() if m.end() - m.start() > self.cached_run)
        units = dict(zip(long, self.long_runs(list(long)), strict=True)) if long else {}
        return [self.units(x, units) for x in leaves]

    def units(self, leaf: Leaf, long: dict[str, Units]) -> Units:
        parts: list[Units] = []
        begin, end, ids = [], [], []

        def close() -> None:
            if begin or not parts:
                parts.append(Units(np.array(begin, np.int32) + leaf.at, np.array(end, np.int32) + leaf.at, np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32), np.frombuffer(b"".join(ids), np.uint32)))
                for x in (begin, end, ids):
                    x.clear()

        for m in leaf.spans():
            a, b = m.span()
            if b - a <= self.cached_run:
                begin.append(a)
                end.append(b)
                ids.append(self.young.get(m[0]) or self.look_up(m[0], leaf.plain))
            else:
                close()
                own, at = long[m[0]], leaf.at + a
                parts.append(Units(own.begin + at, own.end + at, own.first, own.ids))
        close()
        return in_a_row(parts)

    def cuts(self, text: str, low: int, high: int) -> list[int]:
        """Where the leaves of text[low:high] end, halved again and again."""
        if high - low <= self.leaf:
            return [high]
        middle = before_marks(text, (low + high) // 2, low)
        if middle == low:
            middle = after_marks(text, (low + high) // 2, high)
        return [high] if middle == high else [*self.cuts(text, low, middle), *self.cuts(text, middle, high)]

    def trees(self, texts: list[tuple[str, bool]]) -> list[Units]:
        """The units of whole texts: leaves in parallel, then level by level the joins of all texts in parallel."""
        ends = [self.cuts(t, 0, len(t)) for t, _ in texts]
        leaves = [Leaf(t[a:b], a, p) for (t, p), e in zip(texts, ends, strict=True) for a, b in zip([0, *e], e, strict=False)]
        units = iter(self.together(leaves))
        level = [[(a, b, next(units)) for a, b in zip([0, *e], e, strict=False)] for e in ends]
        del leaves
        while any(len(x) > 1 for x in level):
            made: dict[tuple[int, int], Units] = {}
            joins = {(k, i): Join(*texts[k], x[i][0], x[i][1], x[i + 1][1], x[i][2], x[i + 1][2], self.window) for k, x in enumerate(level) for i in range(0, len(x) - 1, 2)}
            while joins:
                fresh = self.together([j.window() for j in joins.values()])
                for (at, join), own in zip(list(joins.items()), fresh, strict=True):
                    if (both := join.agreed(own)) is not None:
                        made[at] = both
                        del joins[at]
            level = [[(x[i][0], x[i + 1][1], made[k, i]) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)] for k, x in enumerate(level)]
        return [x[0][2] for x in level]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        plain = [is_plain(t) for t in texts]
        runs: list[list[str] | None] = []
        for t, p in zip(texts, plain, strict=True):
            own = (PIECE.findall(t.lower()) if p else RUN.findall(t)) if len(t) <= self.leaf else None
            runs.append(None if own is None or own and len(max(own, key=len)) > self.cached_run else own)
        for kind in (True, False):
            self.learn({r for own, p in zip(runs, plain, strict=True) if own and p == kind for r in own}, kind)
        tree = [i for i, own in enumerate(runs) if own is None]
        out: list[bytes] = [b""] * len(texts)
        for i, units in zip(tree, self.trees([(texts[i], plain[i]) for i in tree]), strict=True):
            out[i] = units.ids.tobytes()
        for i, own in enumerate(runs):
            if own:
                young, p = self.young, plain[i]
                out[i] = b"".join([young.get(r) or self.look_up(r, p) for r in own])
        return out

    def decode(self, encoded: list[bytes]) -> pa.Array:
        """The text of each: the strings of its tokens with spaces between."""
        at = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
        strings = self.names.take(pa.array(np.frombuffer(b"".join(encoded), np.uint32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at), strings), " ")


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The codec of a worker process; that of a second file takes the first one's place."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded text of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for at, texts in portions(batch, SLICE):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.binary()), codec.decode(ids)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding and decoding of all documents."""
    import public_tokenizers

    out = encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
