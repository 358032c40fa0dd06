"""N-gram Jaccard self-join with vertical partitioning.

A text's set holds its distinct shingles of ``WIDTH`` words (64-bit hashes). Two texts are linked when
``100 * |x & y| >= percent * |x | y|``. Texts with the same set are one class; only classes are joined, named by a
128-bit digest of the set.

1. The global order of shingles (by hash) is cut into fragments. A piece of the texts numbers its classes and sends every
   fragment their segments, each class of a task once. A fragment counts in how many segments each of its shingles occurs
   and tells every piece which shingles of which class are shared (those of a class that several tasks have always are).
2. The partial counts are summed per class. A class that shares less than ``percent`` of its set has no partner and is
   done: only the others, the survivors, go on, each once.
3. Survivors are joined by prefixes of the order (document frequency, hash). A bucket (the survivors with one prefix
   shingle) is not expanded into pairs: its most central member, the leader, is compared with the others.
4. Members of a bucket that are linked to the leader are in one component. The other pairs of the bucket are found
   from the differences to the leader, D = (leader - x) + (x - leader): with L = leader and W(x) = b |L - x| + a |x - L|
   (percent = a / b in lowest terms, s = a + b)

       x, y linked   <=>   s |D(x) & D(y)| >= W(x) + W(y) - (b - a) |L|        x, L linked   <=>   W(x) <= (b - a) |L|

   so a pair that is not yet in one component must share difference shingles, and the join of step 3 is repeated on the
   differences within the leader's cluster (step 3 itself is the case of the empty leader). Buckets of a bounded size are
   then compared pair by pair. Nothing is left out: there is no cap on partners, candidates or buckets.
5. Components come from the links by propagating the least class with pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import gcd
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import forget, mapped, partition_keys, pieces, released, saved, saved_in_place, skew_join, small, table, utf8

WIDTH = 5
PERCENT = 80
#: Shingles that one fragment should hold, about; the number of fragments follows the input.
FRAGMENT_SHINGLES = 2_000_000
#: Pairs of one leader that meet its set in one task.
STAR_PAIRS = 250
#: In round r of step 4, buckets of at most so many times 2**r members are compared pair by pair, and never larger ones than
#: the second number; larger buckets have a leader, who leaves them, in every round.
PAIRWISE, MOST_PAIRWISE = 8, 256

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: A shingle and its document frequency, which only orders shingles: above ``MOST_DF`` it does so no more.
_ITEM = np.dtype([("h", "<u8"), ("df", "u1")])
MOST_DF = 255


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: dict[bytes, int] | None = None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; of the whole sequence if it has fewer words."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((_Words() if words is None else words).__getitem__, own), np.uint64, len(own))
    if len(h) < width:
        out = np.full(1, len(h), np.uint64)
        for x in h:
            out = _mixed(out * _MIX[0] + x)
        return out
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out *= _MIX[0]
        out ^= out >> np.uint64(32)
        out += h[k : len(h) - width + 1 + k]
    return np.unique(_mixed(out))


def signature(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


class Threshold:
    """``percent`` as a / b in lowest terms; all tests in whole numbers."""

    def __init__(self, percent: int):
        g = gcd(percent, 100)
        self.a, self.b = percent // g, 100 // g
        self.s = self.a + self.b

    def linked(self, overlap: int, n_x: int, n_y: int) -> bool:
        return self.s * overlap >= self.a * (n_x + n_y)

    def prefix(self, size: int, weight: int, leader: int) -> tuple[int, bool]:
        """(how many of ``size`` difference shingles are looked up, whether x is not linked to the leader)."""
        over = weight - (self.b - self.a) * leader
        need = max(1, -(-over // self.b)) if over > 0 else weight // self.s + 1
        return max(0, size - need + 1), over > 0


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), sig (digest of the set; null if empty), text_sha (SHA-256 of the text)."""

    def make():
        words = _Words()

        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                n, sig, sha = [], [], []
                for text in utf8(part.column("text")):
                    found = shingles(text, words, width)
                    n.append(len(found))
                    sig.append(signature(found) if len(found) else None)
                    sha.append(hashlib.sha256(text).digest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sha, pa.binary())], names=["doc_id", "n", "sig", "text_sha"])

        return step

    return mapped(docs, make, "doc_id long, n long, sig binary, text_sha binary")


_SENT = "dest long, fragment int, piece long, blob binary"
#: In place of a fragment: the digests and sizes of a piece's classes.
_CLASSES = -1


def _sent(dest: list[int], fragment: list[int], piece: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(fragment, pa.int32()), pa.array(piece, pa.int64()), pa.array(blobs, pa.binary())], names=["dest", "fragment", "piece", "blob"])


def _listed(number: np.ndarray, k: np.ndarray, items: np.ndarray) -> bytes:
    """Classes (rising numbers), how many items each has, and the items."""
    head = pa.compress(np.concatenate([np.diff(number, prepend=0), k]).astype("<u4").tobytes(), "lz4", asbytes=True)
    return np.array([len(number), len(head)], "<u4").tobytes() + head + items.tobytes()


def _unlisted(blob: bytes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, size = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    head = np.frombuffer(pa.decompress(blob[8 : 8 + size], 8 * m, "lz4", asbytes=True), "<u4")
    return np.cumsum(head[:m]), head[m:], np.frombuffer(blob, kind, -1, 8 + size)


def _segments(docs: DataFrame, width: int, deal: list[int]) -> DataFrame:
    """dest, fragment, piece, blob: the segments of a piece's classes in one fragment of the hash order.

    ``deal`` has the number that ``repartition`` sends to the task of each fragment.
    """

    def run(batches):
        fragments = len(deal)
        words = _Words()
        sent: set[bytes] = set()
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text"):
                sigs, sets = [], []
                for text in utf8(part.column("text")):
                    found = shingles(text, words, width)
                    if len(found) and (sig := signature(found)) not in sent:
                        sent.add(sig)
                        sigs.append(sig)
                        sets.append(found)
                if not sets:
                    continue
                n = np.array([len(x) for x in sets])
                every = np.concatenate(sets)
                del sets
                owner = np.repeat(np.arange(len(n)), n)
                # high 32 bits of the hash, scaled: fragments are ranges of the order
                at = ((every >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                every, owner, at = every[order], owner[order], at[order]
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                dest, names, blobs = [deal[piece % fragments]], [_CLASSES], [b"".join(sigs) + n.astype("<u4").tobytes()]
                for lo, hi in zip(cuts, cuts[1:]):
                    who, k = np.unique(owner[lo:hi], return_counts=True)
                    names.append(int(at[lo]))
                    dest.append(deal[names[-1]])
                    blobs.append(_listed(who, k, every[lo:hi]))
                for i in range(0, len(names), 256):
                    yield _sent(dest[i : i + 256], names[i : i + 256], [piece] * len(names[i : i + 256]), blobs[i : i + 256])
                piece += 1
        released()

    return docs.select("text").mapInArrow(run, _SENT)


def _fragment(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """piece, blob: the classes of every piece that have shared shingles in the fragment, with these. Empties ``held``."""
    names, numbers, counts, hashes = [], [], [], []
    while held:
        piece, blob = held.pop()
        number, k, own = _unlisted(blob, "<u8")
        names.append(piece)
        numbers.append(number)
        counts.append(k)
        hashes.append(own)
    sizes = np.array([len(x) for x in hashes])
    every = np.concatenate(hashes)
    del hashes
    order = np.argsort(every)
    sorted_ = every[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    del sorted_
    df = np.diff(np.append(starts, len(order)))
    many = df > 1
    at = order[np.repeat(many, df)]  # shared shingles only
    del order
    df = np.repeat(np.minimum(df[many], MOST_DF), df[many])
    back = np.argsort(at)
    at, df = at[back], df[back]
    items = np.zeros(len(at), _ITEM)
    items["h"], items["df"] = every[at], df
    del every
    cuts = np.searchsorted(at, np.append(0, np.cumsum(sizes)))
    begin = np.cumsum(sizes) - sizes
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if hi > lo:
            own = np.repeat(numbers[i], counts[i])[at[lo:hi] - begin[i]]
            who, k = np.unique(own, return_counts=True)
            yield names[i], _listed(who, k, items[lo:hi])


def _shared(segments: DataFrame, deal: list[int]) -> DataFrame:
    """dest, fragment, piece, blob: the shared shingles of a piece's classes in one fragment; the classes pass through."""

    def run(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for name, piece, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "piece", "blob"))):
                if name == _CLASSES:
                    yield _sent([deal[piece % len(deal)]], [name], [piece], [blob])
                else:
                    held.setdefault(name, []).append((piece, blob))
        for name in sorted(held):
            for piece, blob in _fragment(held.pop(name)):
                yield _sent([deal[piece % len(deal)]], [name], [piece], [blob])
        released()

    return segments.repartition(len(deal), "dest").select("fragment", "piece", "blob").mapInArrow(run, _SENT)


def _survivors(shared: DataFrame, deal: list[int], t: Threshold) -> DataFrame:
    """sig, n, items (by hash): the classes that share enough of their set to have a partner."""

    def run(batches):
        classes: dict[int, bytes] = {}
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for name, piece, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "piece", "blob"))):
                if name == _CLASSES:
                    classes[piece] = blob
                else:
                    held.setdefault(piece, []).append(blob)
        for piece in sorted(held):
            own = classes.pop(piece)
            m = len(own) // 20
            n = np.frombuffer(own, "<u4", m, 16 * m).astype(np.int64)
            found = [_unlisted(blob, _ITEM) for blob in held.pop(piece)]
            number, items = np.concatenate([np.repeat(x, k) for x, k, _ in found]), np.concatenate([x for *_, x in found])
            del found
            stays = np.bincount(number, minlength=m) * t.b >= n * t.a
            mine = stays[number]
            number, items = number[mine], items[mine]
            order = np.lexsort((items["h"], number))
            number, items = number[order], items[order]
            who, first = np.unique(number, return_index=True)
            raw, cuts, width = items.tobytes(), np.append(first, len(items)).tolist(), _ITEM.itemsize
            for at in range(0, len(who), 1_000):
                some = who[at : at + 1_000].tolist()
                blobs = [raw[a * width : b * width] for a, b in zip(cuts[at : at + len(some)], cuts[at + 1 : at + 1 + len(some)])]
                yield pa.RecordBatch.from_arrays([pa.array([own[16 * i : 16 * i + 16] for i in some], pa.binary()), pa.array(n[some], pa.int64()), pa.array(blobs, pa.binary())], names=["sig", "n", "items"])
        released()

    return shared.repartition(len(deal), "dest").select("fragment", "piece", "blob").mapInArrow(run, "sig binary, n long, items binary")


#: rest: shingles of the difference set from this one on; weight and leader as in ``Threshold.prefix``.
_POSTING = "anchor binary, token long, sig binary, rest long, weight long, leader long, unlinked boolean, central double"
_POSTING_KINDS = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())
_POSTING_NAMES = ["anchor", "token", "sig", "rest", "weight", "leader", "unlinked", "central"]


def _postings(anchor: bytes, sig: bytes, tokens: np.ndarray, keys: np.ndarray, alone: int, weight: int, leader: int, t: Threshold) -> list[tuple]:
    """The prefix of one difference set. ``alone``: its shingles that no other class has, the first of the order."""
    p, unlinked = t.prefix(len(tokens) + alone, weight, leader)
    if p <= alone:
        return []
    order = np.lexsort((tokens, keys))[: p - alone]
    central = float(keys.sum()) / (len(tokens) + alone)
    return [(anchor, x, sig, len(tokens) - i, weight, leader, unlinked, central) for i, x in enumerate(tokens[order].view(np.int64).tolist())]


def _first_postings(survivors: DataFrame, t: Threshold) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for r in batch.to_pylist():
                own = np.frombuffer(r["items"], _ITEM)
                rows += _postings(b"", r["sig"], own["h"], own["df"].astype(np.int64), r["n"] - len(own), t.a * r["n"], 0, t)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _POSTING_KINDS)], names=_POSTING_NAMES)

        return step

    return mapped(survivors, make, _POSTING)


def _candidates(postings: DataFrame, most: int, t: Threshold) -> DataFrame:
    """x, y, star: pairs to compare. Of large buckets the leader (x) with each member, of the others every pair."""
    key = ["anchor", "token"]
    # What two members can still share from their first common shingle on must reach what their weights ask for; the
    # lightest member of the bucket asks for the least.
    asked = lambda w, v, leader: w + v - (t.b - t.a) * leader
    lightest = postings.groupBy(*key).agg(F.min("weight").alias("least"), F.count("*").alias("members")).where("members > 1").drop("members")
    able = postings.join(lightest, key).where(F.col("rest") * t.s >= asked(F.col("weight"), F.col("least"), F.col("leader"))).drop("least")
    buckets = (
        able.groupBy(*key)
        .agg(F.count("*").alias("members"), F.max("unlinked").alias("some"), F.max_by("sig", F.struct("central", "sig")).alias("head"))
        .where("members > 1 and some")
        .drop("some")
    )
    member = able.join(buckets, key)
    star = member.where((F.col("members") > most) & (F.col("sig") != F.col("head"))).select(F.col("head").alias("x"), F.col("sig").alias("y")).distinct().withColumn("star", F.lit(True))
    if most < 2:
        return star
    # A bucket of a bounded size: every pair of it.
    groups = member.where(F.col("members") <= most).groupBy(*key).agg(F.collect_list(F.struct("sig", "rest", "weight", "leader", "unlinked")).alias("found"))
    group = F.sort_array("found")
    can = lambda p, q: (p["unlinked"] | q["unlinked"]) & (F.least(p["rest"], q["rest"]) * t.s >= asked(p["weight"], q["weight"], p["leader"]))
    pair = lambda p, q: F.struct(p["sig"].alias("x"), q["sig"].alias("y"))
    pairs = F.flatten(F.transform("group", lambda p, i: F.transform(F.filter(F.slice("group", i + 2, F.size("group")), lambda q: can(p, q)), lambda q: pair(p, q))))
    direct = groups.select(group.alias("group")).select(F.explode(pairs).alias("pair")).select("pair.x", "pair.y").distinct().withColumn("star", F.lit(False))
    return star.unionByName(direct)


def _compared(pairs: DataFrame, survivors: DataFrame, t: Threshold) -> DataFrame:
    """For every pair a row with ``linked``; for every star pair also the postings of the member's differences."""
    pairs = saved(pairs)
    of_x = survivors.select(F.col("sig").alias("x"), F.col("n").alias("n_x"), F.col("items").alias("i_x")).hint("merge")
    of_y = survivors.select(F.col("sig").alias("y"), F.col("n").alias("n_y"), F.col("items").alias("i_y")).hint("merge")
    # the pairs of a frequent leader are dealt out, STAR_PAIRS to a task, and its set is sent to each
    deals = saved(pairs.groupBy("x").agg(F.ceil(F.count("*") / STAR_PAIRS).cast("int").alias("deals")).where("deals > 1"))
    columns = ["x", "y", "star", "n_x", "i_x", "n_y", "i_y"]
    if deals.limit(1).count():
        deals = small(deals)
        many = pairs.join(deals, "x").withColumn("deal", F.pmod(F.hash("y"), F.col("deals"))).drop("deals").join(of_y, "y")
        sent = of_x.join(deals, "x").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        few = pairs.join(deals, "x", "left_anti").join(of_y, "y").join(of_x, "x")
        both = few.select(*columns).unionByName(many.join(sent, ["x", "deal"]).select(*columns))
    else:
        both = pairs.join(of_y, "y").join(of_x, "x").select(*columns)

    def make():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                rows, last, x = [], None, None
                for r in batch.slice(at, 500).to_pylist():
                    if r["x"] != last:
                        last, x = r["x"], np.frombuffer(r["i_x"], _ITEM)
                    y = np.frombuffer(r["i_y"], _ITEM)
                    _, in_x, in_y = np.intersect1d(x["h"], y["h"], assume_unique=True, return_indices=True)
                    rows.append((None, None, r["x"], None, None, None, t.linked(len(in_x), r["n_x"], r["n_y"]), None, r["y"]))
                    if not r["star"]:
                        continue
                    gone, more = np.ones(len(x), bool), np.ones(len(y), bool)
                    gone[in_x], more[in_y] = False, False
                    gone, more = x[gone], y[more]
                    # shingles that only the leader has are missing from every member
                    lone, alone = r["n_x"] - len(x), r["n_y"] - len(y)
                    top = int(x["df"].max(initial=1)) + 1
                    own = (crc32(r["x"]) << 32) + np.arange(lone, dtype=np.uint64)
                    tokens = np.concatenate([gone["h"], own.astype(np.uint64), more["h"]])
                    keys = np.concatenate([top - gone["df"].astype(np.int64), np.full(lone, top), more["df"].astype(np.int64)])
                    weight = t.b * (len(gone) + lone) + t.a * (len(more) + alone)
                    if len(tokens) + alone:
                        rows += [(*p, None) for p in _postings(r["x"], r["y"], tokens, keys, alone, weight, r["n_x"], t)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (*_POSTING_KINDS, pa.binary()))], names=[*_POSTING_NAMES, "other"])

        return step

    return mapped(both, make, _POSTING + ", other binary")


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the links (x, y) the least node of its component."""
    edges = saved(links.select("x", "y").union(links.select("y", "x")).distinct())
    label = saved(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    while True:
        near = skew_join(edges, label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = saved(label.join(near, "node").select("node", F.least("root", "near").alias("next"), "root"))
        # pointer jumping: the root of the root
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = saved(skew_join(step, jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


def _resolved(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(sets as ``_sets`` makes them, root of every class that has a partner: sig, root) for ``docs`` (doc_id, text)."""
    t = Threshold(percent)
    spark = docs.sparkSession
    sets = saved(_sets(docs, width))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT_SHINGLES))
    deal = partition_keys(spark, fragments)
    # placed by sig, once: the joins of every round find them there
    shared = saved(_shared(_segments(docs.where("doc_id is not null"), width, deal), deal))
    forget(spark)  # the segments are the largest shuffle
    survivors = saved_in_place(_survivors(shared, deal, t).repartition(fragments, "sig").dropDuplicates(["sig"]))
    del shared
    forget(spark)

    links = None
    postings = _first_postings(survivors, t)
    most = 1
    while True:
        pairs = _candidates(postings, most, t)
        out = saved(_compared(pairs, survivors, t))
        found = saved(out.where("other is not null and unlinked").select(F.col("sig").alias("x"), F.col("other").alias("y")))
        links = found if links is None else links.union(found)
        del pairs
        forget(spark)
        postings = out.where("token is not null").drop("other")
        if postings.limit(1).count() == 0:
            break
        most = PAIRWISE if most == 1 else min(2 * most, MOST_PAIRWISE)
    return sets, components(links).withColumnRenamed("node", "sig")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Texts without words (null, empty) have an empty set and are linked with nothing. Rows without an id have a null
    component and link nothing. Rows that repeat an id are compared like others. Other columns are ignored; an empty
    table gives an empty result.
    """
    sets, roots = _resolved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent, width)
    named = saved(sets.where("sig is not null and doc_id is not null").select("sig", "doc_id", "n"))
    named_by = _named(named.select("sig", F.col("doc_id").alias("first")), roots)
    named = skew_join(named, named_by, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    alone = sets.where("sig is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone)


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """sig and the least ``first`` of its component, for the classes with a partner and those of several rows; a class of one
    row without a partner is a component of its own. ``rows`` has sig and first."""
    classes = rows.groupBy("sig").agg(F.min("first").alias("first"), F.count("*").alias("members"))
    linked = saved(classes.join(roots, "sig").select("sig", "root", "first"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    copies = classes.where("members > 1").join(roots, "sig", "left_anti").select("sig", "first")
    return saved(skew_join(linked.drop("first"), firsts, "root").select("sig", "first").unionByName(copies))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays in every component: that with the least id.

    Rows are told apart by id and whole text: of rows with the least id of a component and different texts that with the
    least digest stays, and of equal rows one. Rows without an id or without words stay. Columns may have any names.
    """
    sets, roots = _resolved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), PERCENT, WIDTH)
    row = F.struct("doc_id", "sig", "text_sha")
    rows = saved(sets.where("sig is not null and doc_id is not null").select("sig", "doc_id", "text_sha"))
    met = skew_join(rows, _named(rows.select("sig", row.alias("first")), roots), "sig", "left").where("first is not null")
    met = met.select(F.col("doc_id").alias("q_id"), F.col("text_sha").alias("q_sha"), (row != F.col("first")).alias("q_gone"))
    met = saved(met.groupBy("q_id", "q_sha").agg(F.max("q_gone").alias("q_gone"), F.count("*").alias("q_n")))
    marks = ["q_id", "q_sha"]
    # the columns of docs travel in a struct, so their names cannot clash
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256))
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"), F.col(f"`{id_col}`").cast("long").alias("q_id"), sha.alias("q_sha"))
    kept = every.join(small(met.where("q_gone").select(*marks)), marks, "left_anti")
    again = met.where("not q_gone and q_n > 1").select(*marks)
    if again.limit(1).count():  # equal rows
        again = small(again)
        kept = kept.join(again, marks, "left_anti").unionByName(kept.join(again, marks, "left_semi").dropDuplicates(marks))
    return kept.select("q_row.*")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS found FROM d
), classes AS (
  SELECT min(doc_id) AS low, found FROM s WHERE len(found) > 0 GROUP BY found
), each AS (
  SELECT low, len(found) AS n, unnest(found) AS g FROM classes
), links AS (
  SELECT a.low AS x, b.low AS y FROM each a JOIN each b ON a.g = b.g AND a.low < b.low
  GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT low AS node, low AS root FROM classes
  UNION
  SELECT r.node, e.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) e ON e.x = r.root
), lowest AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.found) AS n_shingles, coalesce(l.root, s.doc_id) AS component_id
FROM s LEFT JOIN classes c ON s.found = c.found LEFT JOIN lowest l ON l.node = c.low
"""
