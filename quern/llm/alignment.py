"""Alignment of two tokenizers over the same texts: bitsets of token ends.

Both tokenizers encode a text (with a space before it). The bytes at which a token of A ends are the set bits of one
packed bitset, those of B of another; their AND are the shared cuts. The popcount rank of a cut in either bitset is the
number of tokens before it, so two neighbouring cuts give the token ranges of a group, and the links are all pairs of a
group's tokens.

Neither tokenizer has a token, or looks at context, across a place where a space or line end follows a character that is
no white space (for B's vocabulary that is checked). A text is therefore cut there into units, and a unit that was seen
before is looked up. New units of many texts are put one after the other and aligned in one pair of bitsets.

How many documents hold an id pair is counted over the whole corpus: every batch of texts leaves, for each of
``FRAGMENTS`` hash fragments of the pairs, one blob with its pairs by document. Blobs are summed by task and then by a
group-by of pairs. Then blobs meet the counts of their fragment, which is dealt out with copies so that no task holds all
blobs of one; the results of the fragments are added up by document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pieces, released, saved, table

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
FRAGMENTS = 16
#: Spreads pairs over the fragments; its product with a pair (under 2**32) fits 63 bits.
SPREAD = 0x5851F42D
#: Bytes of blobs that share a copy of a fragment's counts, about.
SHARE = 256 << 20
#: Bytes that the units take which a Python worker remembers from task to task, about; what one takes beside its
#: contents; the longest such unit; and bytes of new units that are aligned at once.
REMEMBERED, ENTRY, LONGEST, JOINED = 96 << 20, 260, 48, 1 << 18
#: Links of a group that are written out one by one; larger groups are counted by distinct ids.
LISTED = 1 << 16
#: Pairs that a task sums before it hands them on.
SUMMED = 1 << 20

#: A unit ends where a space or line end follows a character that is no white space.
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_SPACE = "▁"


class Bits:
    """A packed bitset with rank: how many bits are set before a place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def places(self) -> np.ndarray:
        """Select: the set places, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared cuts, tokens of A up to each cut, tokens of B up to each cut) from the byte ends of all tokens."""
    size = int(a_ends[-1]) if len(a_ends) else 0
    a, b = Bits.at(a_ends, size + 1), Bits.at(b_ends, size + 1)
    cuts = (a & b).places()
    return cuts, a.rank(cuts + 1), b.rank(cuts + 1)


def _expanded(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair, times) of the links of all groups; a pair may come more than once."""
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    na, nb = a_to - a_from, b_to - b_from
    n = na * nb
    few = np.flatnonzero(n <= LISTED)
    group = np.repeat(few, n[few])
    k = np.arange(len(group)) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
    pair = a[a_from[group] + k // nb[group]] << 16 | b[b_from[group] + k % nb[group]]
    parts = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(n > LISTED).tolist():
        ua, ca = np.unique(a[a_from[g] : a_to[g]], return_counts=True)
        ub, cb = np.unique(b[b_from[g] : b_to[g]], return_counts=True)
        parts.append((np.full(len(ua) * len(ub), g), (ua[:, None] << 16 | ub[None]).ravel(), (ca[:, None] * cb[None]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their times."""
    if not len(key):
        return key, times
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(times[order], first)


@lru_cache(maxsize=1)
def _models(a_vocabulary: str, b_vocabulary: str):
    """(tokenizer A, tokenizer B, bytes of A's tokens, bytes of B's tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    where = lambda name: name if "/" in name else public_tokenizers.path(name)
    a = Tokenizer.from_file(where(a_vocabulary))
    a.encode_special_tokens = True  # their strings in a text are ordinary text
    b = sentencepiece.SentencePieceProcessor(model_file=where(b_vocabulary))
    # byte-level alphabet: visible characters stand for themselves, the other bytes for the characters from U+0100 on
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(seen))}
    a_bytes: list[bytes] = [b""] * a.get_vocab_size(with_added_tokens=True)
    for token, i in a.get_vocab(with_added_tokens=True).items():
        a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if "\n" in piece or _SPACE in piece.lstrip(_SPACE):
            raise ValueError(f"piece {i} goes across a cut between units")
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return a, b, a_bytes, b_bytes


class Aligner:
    """Aligned units of a Python worker, by number."""

    def __init__(self, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY):
        self.a, self.b, self.a_bytes, self.b_bytes = _models(a_vocabulary, b_vocabulary)
        self.a_size, self.b_size = (np.array([len(x) for x in xs]) for xs in (self.a_bytes, self.b_bytes))
        self.known: dict[str, int] = {}
        self.shown: list[bytes] = []
        # of every unit: tokens of A and B (-1: they differ from the text), groups, links, end of its pairs
        self.sizes, self.ends = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.held = 0

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for the text, which begins with a space; None where the bytes of B's differ from the text."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1)
        data = text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != data or b"".join(map(self.a_bytes.__getitem__, a)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _add(self, units: list[str]) -> None:
        """Align the units, joined behind one word that is cut off again."""
        found = self._encoded(" a" + "".join(units))
        if found is None and len(units) > 1:
            for unit in units:
                self._add([unit])
            return
        n = len(units)
        for unit in units:
            self.known[unit] = len(self.known)
        if found is None:
            self.shown.append(b"")
            self.sizes = np.concatenate([self.sizes, np.full((1, 4), -1)])
            self.ends = np.append(self.ends, self.ends[-1])
            return
        a, b = found
        cuts, a_to, b_to = groups(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        head = int(np.searchsorted(cuts, 2)) + 1
        a, b, cuts, a_to, b_to = a[a_to[head - 1] :], b[b_to[head - 1] :], cuts[head:], a_to[head:] - a_to[head - 1], b_to[head:] - b_to[head - 1]
        unit_to = np.searchsorted(cuts, 2 + np.cumsum([len(u.encode()) for u in units])) + 1  # groups up to the end of each unit
        unit_of = np.repeat(np.arange(n), np.diff(unit_to, prepend=0))
        group, pair, times = _expanded(a, b, a_to, b_to)
        key, times = _summed(unit_of[group] << 32 | pair, times)
        last = unit_to - 1
        links = np.diff(a_to, prepend=0) * np.diff(b_to, prepend=0)
        sizes = np.stack([np.diff(a_to[last], prepend=0), np.diff(b_to[last], prepend=0), np.diff(unit_to, prepend=0), np.add.reduceat(links, unit_to - np.diff(unit_to, prepend=0))], 1)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.searchsorted(key, np.arange(1, n + 1) << 32)])
        self.pairs, self.times = np.concatenate([self.pairs, (key & 0xFFFFFFFF).astype(np.uint32)]), np.concatenate([self.times, times.astype(np.int32)])
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        shown, i, j = [], 0, 0
        for x, y in zip(a_to.tolist(), b_to.tolist()):
            shown.append(f"{sa[i]}|{sb[j]}" if x == i + 1 and y == j + 1 else f"{','.join(sa[i:x])}|{','.join(sb[j:y])}")
            i, j = x, y
        i = 0
        for x in unit_to.tolist():
            self.shown.append(";".join(shown[i:x]).encode())
            i = x

    def _learn(self, units: set[str]) -> int:
        """Align unknown units; how many are known for good, the others are forgotten after the batch."""
        new = [u for u in units if u not in self.known]
        # a unit that ends in white space ends its text, and one with the mark for a space may spoil its neighbours
        single = {u for u in new if u[-1].isspace() or _SPACE in u or u[0] not in " \n"}
        keep, drop = [], []
        for u in new:
            (keep if len(u) <= LONGEST else drop).append(u)
        for units_ in (keep, drop):
            some, size = [], 0
            for u in units_:
                if u in single:
                    self._add([u])
                    continue
                some.append(u)
                size += len(u)
                if size > JOINED:
                    self._add(some)
                    some, size = [], 0
            if some:
                self._add(some)
        return len(self.known) - len(drop)

    def _cut(self, n: int) -> None:
        while len(self.known) > n:
            self.known.popitem()
        del self.shown[n:]
        self.sizes, self.ends = self.sizes[:n].copy(), self.ends[: n + 1].copy()
        self.pairs, self.times = self.pairs[: self.ends[-1]].copy(), self.times[: self.ends[-1]].copy()

    def aligned(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """([(n_a, n_b, n_groups, n_links, sha256 of the groups)] of the texts, and the distinct pairs: (text, pair, times))."""
        parts = [_UNIT.findall(" " + t) if t else [] for t in texts]
        before = len(self.known)
        stay = self._learn(set().union(*parts))
        n = np.array([len(p) for p in parts])
        unit = np.array([self.known[u] for p in parts for u in p], np.int64)
        doc = np.repeat(np.arange(len(parts)), n)
        own = self.sizes[unit] if len(unit) else np.zeros((0, 4), np.int64)
        spoilt = np.zeros(len(parts), bool)
        spoilt[doc[own[:, 0] < 0]] = True
        totals = np.zeros((len(parts), 4), np.int64)
        np.add.at(totals, doc, own)
        totals[spoilt] = 0
        rows, at = [], 0
        for i, p in enumerate(parts):
            digest = "" if spoilt[i] or not p else hashlib.sha256(b";".join(map(self.shown.__getitem__, unit[at : at + len(p)].tolist()))).hexdigest()
            rows.append((*totals[i].tolist(), digest))
            at += len(p)
        good = ~spoilt[doc]
        unit, doc = unit[good], doc[good]
        m = self.ends[unit + 1] - self.ends[unit]
        spot = np.repeat(self.ends[unit] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        key, times = _summed(np.repeat(doc, m) << 32 | self.pairs[spot].astype(np.int64), self.times[spot].astype(np.int64))
        self.held += sum(map(len, self.shown[before:stay])) + 8 * int(self.ends[stay] - self.ends[min(before, stay)]) + ENTRY * (stay - before)
        full = self.held > REMEMBERED  # units that came first are the frequent ones: the last half goes, which leaves room for others
        if full:
            stay //= 2
            self.held //= 2
        if stay < len(self.known):
            self._cut(stay)
        return rows, key >> 32, key & 0xFFFFFFFF, times


@lru_cache(maxsize=1)
def _aligner(a_vocabulary: str, b_vocabulary: str) -> Aligner:
    return Aligner(a_vocabulary, b_vocabulary)


def _fragment(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.int64) * SPREAD >> 28) % FRAGMENTS


def _packed(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Rows in the order of pair and document, as one compressed blob."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    n = np.diff(np.append(first, len(pair)))
    data = b"".join([np.array([len(first), len(pair)], "<u4").tobytes(), pair[first].astype("<u4").tobytes(), n.astype("<u4").tobytes(), doc.astype("<u2").tobytes(), times.astype("<u4").tobytes()])
    return np.array([len(data)], "<u4").tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, rows of each, documents, times)."""
    data = pa.decompress(blob[4:], decompressed_size=int(np.frombuffer(blob, "<u4", 1)[0]), codec="zstd", asbytes=True)
    pairs, rows = np.frombuffer(data, "<u4", 2).tolist()
    at = 8
    out = []
    for kind, count in (("<u4", pairs), ("<u4", pairs), ("<u2", rows), ("<u4", rows)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, batch long, fragment int, blob binary"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _made(docs: DataFrame, id_col: str, text_col: str, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """A row for every text, and the blobs of every batch of texts; ``row`` is 65,536 times the batch plus the text's place."""

    def batch_of(columns: list) -> pa.RecordBatch:
        n = len(next(c for c in columns if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if c is None else pa.array(c, kind) for c, kind in zip(columns, _KINDS)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_vocabulary, b_vocabulary)
        number = TaskContext.get().partitionId() << 24
        for given in batches:
            for part in pieces(given, "text", 2 << 20):
                rows, doc, pair, times = aligner.aligned(part.column("text").to_pylist())
                row = (number << 16) + np.arange(len(rows))
                yield batch_of([row, part.column("doc_id"), *([r[k] for r in rows] for k in range(5)), None, None, None])
                fragment = _fragment(pair)
                order = np.lexsort((doc, pair, fragment))
                cuts = np.searchsorted(fragment[order], np.arange(FRAGMENTS + 1))
                some = [(f, order[x:y]) for f, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                if some:
                    yield batch_of([None] * 7 + [[number] * len(some), [f for f, _ in some], [_packed(pair[o], doc[o], times[o]) for _, o in some]])
                number += 1
        released()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, _ROW)


def _pair_counts(blobs: DataFrame) -> DataFrame:
    """pair, n: documents that hold the pair linked, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            pair, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for blob in batch.column("blob"):
                pair, n, _, _ = _unpacked(blob.as_py())
                held.append((pair.astype(np.int64), n.astype(np.int64)))
                if sum(len(x) for x, _ in held) > SUMMED:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    if len(held[0][0]) > SUMMED // 2:
                        yield handed()
                        held = []
        if held:
            yield handed()
        released()

    return blobs.select("blob").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(blobs: DataFrame, counts: DataFrame, copies: int, parts: int) -> DataFrame:
    """row, n_best, count_sum: what the pairs of each fragment add to each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, pair, n, best = None, [], None, None, None
        for batch in batches:
            slots, blobs_ = batch.column("slot").to_numpy(), batch.column("blob")
            numbers = batch.column("batch").to_numpy()
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")]
            at = 0
            while at < len(slots):  # runs of one slot's counts, or one blob
                if slots[at] != own:
                    own, held, pair = slots[at], [], None
                if numbers[at] < 0:
                    end = at + int(np.argmax(np.append((slots[at:] != own) | (numbers[at:] >= 0), True)))
                    held.append([c[at:end] for c in columns])
                    at = end
                    continue
                if pair is None:
                    pair, n, best = (np.concatenate(x) for x in zip(*held))
                    pair, n, best = pair.astype(np.int64), n.astype(np.int64), best.astype(bool)
                    held = []
                its, rows, doc, times = _unpacked(blobs_[at].as_py())
                spot = np.repeat(np.searchsorted(pair, its.astype(np.int64)), rows)
                size = int(doc.max()) + 1
                total, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(total, doc, n[spot] * times)
                np.add.at(top, doc, best[spot] * times.astype(np.int64))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array((int(numbers[at]) << 16) + some, pa.int64()), pa.array(top[some], pa.int64()), pa.array(total[some], pa.int64())], names=["row", "n_best", "count_sum"])
                at += 1
        released()

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # the counts of a fragment come to each of its slots, before the blobs
    own = F.shiftright(F.col("pair") * F.lit(SPREAD).cast("long"), 28) % FRAGMENTS * copies
    told = counts.select(F.explode(F.sequence(own.cast("int"), (own + copies - 1).cast("int"))).alias("slot"), F.lit(-1).cast("long").alias("batch"), "pair", "n", "best", none("binary", "blob"))
    dealt = blobs.select((F.col("fragment") * copies + F.pmod(F.xxhash64("batch"), F.lit(copies))).cast("int").alias("slot"), "batch", none("long", "pair"), none("long", "n"), none("boolean", "best"), "blob")
    placed = told.unionByName(dealt).repartition(parts, "slot").sortWithinPartitions("slot", "batch", "pair")
    return placed.mapInArrow(run, "row long, n_best long, count_sum long")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens do not give back the text (with U+2581 in it, for one), have no tokens:
    zeros and an empty digest. Rows that repeat an id or a text each count as a document; ids may be null; other columns
    are ignored; an empty table gives an empty result. A very long text is one batch, its units are looked up as any.
    """
    spark = docs.sparkSession
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "400"}
    made = saved(_made(docs, id_col, text_col, a_vocabulary, b_vocabulary))
    rows = made.where(F.col("fragment").isNull()).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    blobs = made.where(F.col("fragment").isNotNull()).select("batch", "fragment", "blob")
    counts = saved(_pair_counts(blobs), **few)
    top = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has tokens, at most
    counts = counts.withColumn("a", F.shiftright("pair", 16)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    size = blobs.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = max(-(-2 * parts // FRAGMENTS), -(-size // (SHARE * FRAGMENTS)), 1)
    sums = saved(_looked_up(blobs, counts, copies, max(parts, FRAGMENTS * copies // 4)), **few).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
