"""Packing of documents into sequences of at most ``CAPACITY`` tokens: best-two-fit.

A bin is filled greedily: the longest unpacked document, then again and again the longest that fits the gap. Then its
smallest document is replaced by two unpacked documents that fit the expanded gap more tightly, if there are any.

Only lengths matter for that, and there are ``CAPACITY`` of them at most: ``plan`` works on the histogram of lengths,
of fixed size whatever the input, and uses a found bin as often as the counts allow (the next bin would be the same
one). The pieces are then numbered within their length, in salted groups, and look up their place by that number.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import mapped, pieces, saved, table, utf8

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0
#: Bytes that the words take which a Python worker remembers from task to task, about, and the longest such word.
REMEMBERED, LONGEST = 104 << 20, 64
#: Bytes that an entry takes beside its contents: two bytes objects and their place in a dict.
ENTRY = 130
#: Rows that share a salt within a length, about.
ROWS_PER_SALT = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    found = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: ASCII marks but the apostrophe, which may begin a token with letters.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_MARK = frozenset(_MARKS)


def _groups(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    return (words[i : i + size] for i in range(0, len(words), size))


class Encoder:
    """The tokenizer with a memory for words.

    No token of this vocabulary spans ASCII white space, so a text's ids are its words' ids. Capital letters are as small
    ones to it, and it always splits marks after a letter off, as one run; so a word is its lower-cased stem and the marks.
    Stems of ASCII letters are one word to it each, so many of them are encoded as one text.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.tokenizer = _tokenizer(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, words: set[bytes]) -> None:
        known, plain, made = self.known, set(), []
        for word in words:
            low = word.lower()
            if low[-1] in _IS_MARK and (stem := low.rstrip(_MARKS)) and (stem[-1:].isalpha() or stem[-1] > 127 and stem.decode()[-1].lower().isalpha()):
                made.append((word, stem, low[len(stem) :]))
                plain.add(stem)
                plain.add(made[-1][2])
            else:
                plain.add(low)
                if low != word:
                    made.append((word, low, b""))
        for some in _groups([w for w in plain if w not in known and w.isalpha()], 500):
            got = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids, place = np.array(got.ids, "<u4"), np.array(got.word_ids)
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(ids)]
            if len(cuts) == len(some) + 1:
                raw = ids.tobytes()
                known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, cuts, cuts[1:]))
        new = [w for w in plain if w not in known]
        for i in range(0, len(new), 5_000):
            some = new[i : i + 5_000]
            got = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            known.update(zip(some, [_bytes(e.ids) for e in got]))
        known[b""] = b""
        for word, stem, marks in made:
            known[word] = known[stem] + known[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit numbers."""
        parts = [t.split() for t in texts]
        new = {w for w in set().union(*parts) if w not in self.known}
        before = len(self.known)
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for w in [w for w in new if len(w) > LONGEST]:
            for own in (w, w.lower(), w.lower().rstrip(_MARKS)):
                self.known.pop(own, None)
        # from the end on: a dict keeps the order of insertion
        self.held += sum(len(w) + len(ids) + ENTRY for w, ids in islice(reversed(self.known.items()), len(self.known) - before))
        if self.held > REMEMBERED:  # words that came first are the frequent ones: the last half goes, which leaves room for others
            while self.held > REMEMBERED // 2:
                w, ids = self.known.popitem()
                self.held -= len(w) + len(ids) + ENTRY
        return out


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A text's ids are followed by the id ``END``.

    Null and empty texts have that one token. Ids of documents may be null or repeat; other columns are ignored.
    """

    def make():
        encoder = _encoder(vocabulary)
        end = np.array([END], "<u4").tobytes()

        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text", 2 << 20):
                found = encoder.encode(utf8(part.column("text")))
                crc, n = array("q"), np.empty(len(found), np.int64)
                for i, ids in enumerate(found):
                    ids += end
                    n[i], view = len(ids) // 4, memoryview(ids)
                    crc.extend(crc32(view[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity))
                del found
                per = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), per)
                number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = number * capacity
                columns = [number.astype(np.int32), start, np.minimum(capacity, n[row] - start), np.frombuffer(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *map(pa.array, columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, PIECES)


def _best_two(has: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """The two available lengths (counts in ``has``) with the largest sum above ``least`` that fits ``gap``."""
    sizes = np.flatnonzero(has[: gap + 1])
    if not len(sizes):
        return None
    longest = np.maximum.accumulate(np.where(has[: gap + 1] > 0, np.arange(min(gap + 1, len(has))), 0))
    other = longest[gap - sizes]
    # a length that is its own partner needs two documents; else the next shorter one
    alone = (other == sizes) & (has[sizes] < 2)
    other = np.where(alone, longest[np.maximum(sizes - 1, 0)], other)
    total = np.where(other > 0, sizes + other, 0)
    best = int(np.argmax(total))
    return (int(sizes[best]), int(other[best])) if total[best] > least else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins for the histogram ``counts`` (by length, from 0 to ``capacity``): (lengths of a bin, how many such bins)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    while left.any():
        own: list[int] = []
        gap = capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            own.append(int(fits[-1]))
            left[own[-1]] -= 1
            gap -= own[-1]
        if gap and len(own) > 1:
            smallest = own[-1]
            left[smallest] += 1
            if pair := _best_two(left, gap + smallest, smallest):
                own[-1:] = pair
                for x in pair:
                    left[x] -= 1
            else:
                left[smallest] -= 1
        sizes, need = np.unique(own, return_counts=True)
        again = int((left[sizes] // need).min())
        left[sizes] -= again * need
        out.append((own, again + 1))
    return out


class Places:
    """For every length: consecutive ranges of piece numbers, each with its bins and the offsets within a bin."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        self.of: dict[int, tuple[list, list]] = {}
        next_number: dict[int, int] = {}
        first_bin = 0
        for own, times in bins:
            at: dict[int, list[int]] = {}
            offset = 0
            for x in own:
                at.setdefault(x, []).append(offset)
                offset += x
            for x, offsets in at.items():
                starts, rows = self.of.setdefault(x, ([], []))
                starts.append(next_number.get(x, 0))
                rows.append((first_bin, offsets))
                next_number[x] = starts[-1] + times * len(offsets)
            first_bin += times
        self.bins = first_bin

    def find(self, length: int, number: int) -> tuple[int, int]:
        """(bin, offset) of the piece with that number among the pieces of that length."""
        starts, rows = self.of[length]
        k = int(np.searchsorted(starts, number, "right")) - 1
        first, offsets = rows[k]
        turn, slot = divmod(number - starts[k], len(offsets))
        return first + turn, offsets[slot]


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows as ``tokenized`` makes them) with sequence_id and offset; an empty table stays empty."""
    found = saved(found)
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    whole = int(counts[capacity])
    counts[capacity] = 0
    places = Places(plan(counts, capacity))
    salts = max(32, int(counts.sum()) // ROWS_PER_SALT)
    # Full pieces are sequences of their own and need no number among their like.
    full = found.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}) if whole else None
    rest = found.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece") + F.spark_partition_id(), F.lit(salts)))
    own = Window.partitionBy("length", "salt")
    sizes = rest.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = rest.withColumn("rank", F.row_number().over(own.orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("number"))

    def make():
        def step(batch: pa.RecordBatch):
            at = [places.find(x, n) for x, n in zip(batch.column("length").to_pylist(), batch.column("number").to_pylist())]
            cols = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return step

    placed = mapped(numbered, make, PIECES + ", sequence_id long, offset long")
    return placed.unionByName(full) if whole else placed


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(tokenized(table(spark, sf_dir, "documents")))
