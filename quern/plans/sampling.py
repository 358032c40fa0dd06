"""Active sampling: the greedy fixpoint that takes the document with the fewest rules.

Every partition starts with its most representative document, the seed, which does not count as taken. Each round adds
the last chosen document to the statistics, counts the rules of every document against them, and takes the document with
the fewest (then with the smaller df sum, then the greater number). A document that was taken before ends the partition.

One run of rounds serves all partitions. Its state is two tables in the shared folder, written every ``SAVE_EVERY`` rounds:
the documents with their rule counts, and the counts of every itemset of the chosen documents by partition and itemset.
Most rounds read neither. A look at the documents brings the ``LEAD`` first of every partition, the next one's key as a bound
on all others, and the counts of the leading documents' itemsets. With them the driver takes round after round: a chosen
document is one of the leaders, so the counts of its itemsets are at hand, and with them the rules of the other leaders. The
first leader is the first of all as long as it comes before the bound, less what the documents chosen since can have taken
from a document's rules; then it is time for the next look.

A look reads the last version of the documents and adds up, for each, the changes of its itemsets' rules since then. Counts
that earlier leaders shared with the new ones are kept, others come from the last version and the documents chosen since. The
driver holds the leaders with their itemsets' counts (up to ``SETS`` a partition, or one document), and the documents chosen
since the last version with the itemsets whose rules they changed.

Rounds are committed as files in ``log``, those between two looks or versions together; a run that is started again with
the same ``log`` goes on behind the last committed round.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bitmaps as B
from ..operators.rules import antecedents
from ..sources.storage import Folder, shared_dir

log_ = logging.getLogger(__name__)

#: Rounds after which the tables are written.
SAVE_EVERY = 1024
#: Documents of a partition that a look brings, and itemsets that they may have in all. Both change how often the documents
#: are read, not what is chosen.
LEAD, SETS = 1024, 1 << 20
#: Itemsets that are looked up at once, and entries of a table of changes.
_AT_ONCE, _TABLE = 1 << 22, 1 << 25

_PICKS = "part int, step int, doc_idx long, rules long, repeated boolean"
_STATE = "part int, doc_idx long, label int, ids array<long>, df_sum long, rules long"
_KEYS = ["part", "s1", "s2", "s3"]


def _valid(counts: np.ndarray, single: np.ndarray, min_conf: float, min_sup: int) -> np.ndarray:
    """How many classes form a rule with each itemset; ``counts`` has the classes in its first dimension."""
    n = counts.sum(0)
    ratio = np.divide(counts, n, out=np.zeros(counts.shape), where=n > 0).astype(np.float32)
    return ((ratio >= np.float32(min_conf)) & (n > 0) & (single | (n >= min_sup))).sum(0)


def _numbers(items: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The places of ids in ``items`` (sorted), from 1; 0 for others."""
    if not len(items):
        return np.zeros(ids.shape, np.int64)
    at = np.minimum(np.searchsorted(items, ids), len(items) - 1)
    return np.where(items[at] == ids, at + 1, 0)


def _keys(numbers: np.ndarray, base: int, sizes: range) -> np.ndarray:
    """A number for each subset of each row of ``numbers`` (from 1, under ``base``), by size; 0 where a member is 0.

    Subsets of less members have lesser numbers: those of one member are under ``base``.
    """
    docs, k = numbers.shape
    out = []
    for size in sizes:
        if k >= size:
            places = B._places(k, size, 0, comb(k, size) - 1)
            key, held = np.zeros((docs, len(places)), np.int64), np.ones((docs, len(places)), bool)
            for member in places.T:
                key = key * base + numbers[:, member]
                held &= numbers[:, member] > 0
            out.append(key * held)
    return np.concatenate(out, 1) if out else np.zeros((docs, 0), np.int64)


def _members(keys: np.ndarray, base: int) -> np.ndarray:
    """Three members (0: none) of each of the ``_keys``, a row for each place."""
    three, two = keys // base // base, keys // base % base
    first = np.where(three > 0, three, np.where(two > 0, two, keys))
    return np.stack([first, np.where(three > 0, two, np.where(two > 0, keys % base, 0)), np.where(three > 0, keys % base, 0)])


def _key(members: np.ndarray, base: int) -> np.ndarray:
    """The inverse of ``_members``."""
    first, second, third = members
    return np.where(third > 0, (first * base + second) * base + third, np.where(second > 0, first * base + second, first))


def _distinct(keys: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys in order, the place of each key there); keys are under ``end``."""
    if end > _AT_ONCE:
        return np.unique(keys, return_inverse=True)
    there = np.zeros(end, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[keys]


def _by_length(start: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the same number of ids, where row i has those from ``start[i]``."""
    n = np.diff(start)
    for k in np.unique(n):
        yield np.flatnonzero(n == k)


class Changes:
    """Itemsets of a partition (rows of s1, s2, s3) and by how much the number of their rules has changed."""

    def __init__(self, sets: np.ndarray, delta: np.ndarray, sizes: range):
        self.sizes, self.items = sizes, np.unique(sets[sets > 0])
        self.base = len(self.items) + 1
        keys, same = np.unique(_key(_numbers(self.items, sets), self.base), return_inverse=True)
        net = np.bincount(same.ravel(), delta, len(keys)).astype(np.int64)
        self.keys, self.net = keys[net != 0], net[net != 0]
        self.table = None

    def sums(self, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """What the rules of documents change by, whose ids are one after the other in ``flat``."""
        out = np.zeros(len(start) - 1, np.int64)
        if not len(self.keys):
            return out
        if self.table is None and self.base ** (self.sizes.stop - 1) <= _TABLE:
            self.table = np.zeros(self.base ** (self.sizes.stop - 1), np.int32)
            self.table[self.keys] = self.net
        numbers = _numbers(self.items, flat)
        for rows in _by_length(start):
            k = int(start[rows[0] + 1] - start[rows[0]])
            step = max(1, _AT_ONCE // max(1, sum(comb(k, size) for size in self.sizes)))
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                keys = _keys(numbers[start[own][:, None] + np.arange(k)], self.base, self.sizes)
                if self.table is not None:
                    out[own] = self.table[keys].sum(1)
                else:
                    spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    out[own] = np.where(self.keys[spot] == keys, self.net[spot], 0).sum(1)
        return out


class Known:
    """Documents of a partition (doc_idx, label, ids) with the counts of all their itemsets by class."""

    def __init__(self, docs: list[tuple[int, int, list[int]]], sizes: range, classes: int):
        self.docs, self.sizes = docs, sizes
        start = np.cumsum([0, *(len(ids) for _, _, ids in docs)])
        flat = np.concatenate([np.zeros(0, np.int64), *(np.array(ids, np.int64) for _, _, ids in docs)])
        self.items = np.unique(flat)
        self.base = len(self.items) + 1
        numbers = np.searchsorted(self.items, flat) + 1
        held: list = [None] * len(docs)
        for rows in _by_length(start) if docs else ():
            k = start[rows[0] + 1] - start[rows[0]]
            for row, keys in zip(rows.tolist(), _keys(numbers[start[rows][:, None] + np.arange(k)], self.base, sizes)):
                held[row] = keys
        self.start = np.cumsum([0, *map(len, held)])
        self.keys, self.flat = _distinct(np.concatenate([np.zeros(0, np.int64), *held]), self.base ** (sizes.stop - 1))
        self.single = self.keys < self.base
        self.counts = np.zeros((classes, len(self.keys)), np.int64)
        self.place = {doc: i for i, (doc, _, _) in enumerate(docs)}

    def missing(self, before: Known | None) -> np.ndarray:
        """Take the counts that ``before`` has; the places of the other itemsets."""
        if before is None or not len(before.keys) or not len(self.keys):
            return np.arange(len(self.keys))
        members = _members(self.keys, self.base)
        numbers = np.where(members > 0, _numbers(before.items, self.items[np.maximum(members - 1, 0)]), 0)
        there = ((numbers > 0) | (members == 0)).all(0)
        keys = _key(numbers, before.base)
        at = np.minimum(np.searchsorted(before.keys, keys), len(before.keys) - 1)
        there &= before.keys[at] == keys
        self.counts[:, there] = before.counts[:, at[there]]
        return np.flatnonzero(~there)

    def sets(self, places: np.ndarray) -> np.ndarray:
        """s1, s2, s3 of itemsets, a row for each of the three."""
        members = _members(self.keys[places], self.base)
        return np.where(members > 0, self.items[np.maximum(members - 1, 0)], 0) if len(self.items) else members

    def ready(self, min_conf: float, min_sup: int) -> None:
        """The counts are all there."""
        self.min_conf, self.min_sup = min_conf, min_sup
        self.valid = _valid(self.counts, self.single, min_conf, min_sup)

    def add(self, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """Count a document that was chosen: (places of the itemsets whose rules change, by how much)."""
        at = self.place[doc]
        own = self.flat[self.start[at] : self.start[at + 1]]
        self.counts[self.docs[at][1], own] += 1
        new = _valid(self.counts[:, own], self.single[own], self.min_conf, self.min_sup)
        delta = new - self.valid[own]
        self.valid[own] = new
        return own[delta != 0], delta[delta != 0]


class Leaders:
    """The first documents of a partition, their rules kept up to date, and a bound on the keys of all others."""

    def __init__(self, known: Known, df_sums: list[int], rules: list[int], bound: tuple[int, int, int] | None):
        self.known, self.rules, self.df_sums = known, np.array(rules, np.int64), df_sums
        self.bound = bound  # rules, df_sum, -doc_idx of the next one; None: there are no others
        self.lost = 0
        order = sorted(range(len(df_sums)), key=lambda i: (df_sums[i], -known.docs[i][0]))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.holders = np.repeat(np.arange(len(order)), np.diff(known.start))[np.argsort(known.flat, kind="stable")]
        self.ends = np.cumsum(np.bincount(known.flat, minlength=len(known.keys)))

    def add(self, places: np.ndarray, delta: np.ndarray) -> None:
        end = self.ends[places]
        start = np.where(places > 0, self.ends[places - 1], 0)
        spot, _ = B.ranges(start, end)
        np.add.at(self.rules, self.holders[spot], np.repeat(delta, end - start))
        self.lost += int(-np.minimum(delta, 0).sum())

    def first(self) -> tuple[int, int, list[int], int] | None:
        """doc_idx, label, ids and rules of the partition's first document; None where another may come before it."""
        at = int(np.argmin(self.rules * len(self.rules) + self.place))
        (doc, label, ids), rules = self.known.docs[at], int(self.rules[at])
        if self.bound is not None and not (rules < self.bound[0] - self.lost or self.lost == 0 and (rules, self.df_sums[at], -doc) <= self.bound):
            return None
        return doc, label, ids, rules


class _Run:
    def __init__(self, spark: SparkSession, folder: Folder, sizes: range, min_conf: float, min_sup: int, classes: int, lead: int):
        self.spark, self.folder, self.sizes, self.min_conf, self.min_sup, self.classes, self.lead = spark, folder, sizes, min_conf, min_sup, classes, lead
        self.known: dict[int, Known] = {}
        self.leaders: dict[int, Leaders] = {}

    # -- the two tables

    def open(self, version: int) -> None:
        """Work on the tables of a version: ``docs`` and ``counts``."""
        self.version = version
        self.since: dict[int, list[tuple[int, list[int]]]] = {}  # label, ids
        self.changed: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # itemsets, by how much their rules change
        self.docs = self.spark.read.schema(_STATE).parquet(self.folder.path(f"docs-{version}"))
        self.counts = self.spark.read.schema(self._counts_schema()).parquet(self.folder.path(f"counts-{version}"))

    def _counts_schema(self) -> str:
        return "part int, s1 long, s2 long, s3 long, " + ", ".join(f"n_c{c} long" for c in range(self.classes))

    def begin(self, docs: DataFrame) -> dict:
        """Write the first version; what was read, as Spark observed it while it wrote."""
        seen = Observation()
        # by number: each look goes through all itemsets of the documents, which a few small files would leave to a few tasks
        docs = docs.repartition(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "part", "doc_idx")
        docs.observe(seen, F.count("*").alias("rows_read"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("items_read")).write.mode("overwrite").parquet(self.folder.path("docs-0"))
        self.spark.createDataFrame([], self._counts_schema()).write.mode("overwrite").parquet(self.folder.path("counts-0"))
        return seen.get

    def save(self, step: int) -> None:
        """Write the tables as they are after ``step`` rounds; the version counts once it is committed."""
        self._mapped().write.mode("overwrite").parquet(self.folder.path(f"docs-{step}"))
        chosen = self.spark.createDataFrame([(part, ids, label) for part, xs in self.since.items() for label, ids in xs], "part int, ids array<long>, label int")
        rows = B.subset_rows(chosen.select("part", F.monotonically_increasing_id().alias("doc_idx"), "ids"), self.sizes)
        label = chosen.select(F.monotonically_increasing_id().alias("doc_idx"), "label")
        new = rows.join(F.broadcast(label), "doc_idx").select(*_KEYS, *((F.col("label") == c).cast("long").alias(f"n_c{c}") for c in range(self.classes)))
        names = [f"n_c{c}" for c in range(self.classes)]
        self.counts.unionByName(new).groupBy(*_KEYS).agg(*(F.sum(c).alias(c) for c in names)).write.mode("overwrite").parquet(self.folder.path(f"counts-{step}"))
        self.folder.commit(f"version-{step}", {})
        before = self.version
        self.open(step)
        for name in ("docs", "counts"):
            self.folder.delete(f"{name}-{before}")

    # -- rounds

    def add(self, picks: dict[int, tuple[int, int, list[int]]]) -> None:
        """Chosen documents (by partition: doc_idx, label, ids), which are known, with what they change."""
        for part, (doc, label, ids) in picks.items():
            places, delta = self.known[part].add(doc)
            self.since.setdefault(part, []).append((label, ids))
            if len(places):
                self.changed.setdefault(part, []).append((self.known[part].sets(places), delta))
            if part in self.leaders:
                self.leaders[part].add(places, delta)

    def know(self, docs: dict[int, list[tuple[int, int, list[int]]]]) -> None:
        """Have the counts of these documents' itemsets by partition, and of no others."""
        known = {part: Known(own, self.sizes, self.classes) for part, own in docs.items()}
        missing = {part: x.missing(self.known.get(part)) for part, x in known.items()}
        asked = {part: (x.items, x.base, x.keys[missing[part]]) for part, x in known.items() if len(missing[part])}
        for part, spot, n in self._counted(asked):
            known[part].counts[:, missing[part][spot]] += n
        for part, (items, base, keys) in asked.items():
            for label, ids in self._since(part):
                spot = _spots(_keys(_numbers(items, ids), base, self.sizes).ravel(), keys)
                known[part].counts[label, missing[part]] += np.bincount(spot[spot >= 0], minlength=len(keys))
        for x in known.values():
            x.ready(self.min_conf, self.min_sup)
        self.known, self.leaders = known, {}

    def _since(self, part: int) -> Iterator[tuple[int, np.ndarray]]:
        """(label, ids of some documents in rows) of those chosen since the last version."""
        alike: dict[tuple[int, int], list] = {}
        for label, ids in self.since.get(part, []):
            alike.setdefault((label, len(ids)), []).append(ids)
        for (label, k), every in alike.items():
            step = max(1, _AT_ONCE // max(1, sum(comb(k, size) for size in self.sizes)))
            for at in range(0, len(every), step):
                yield label, np.array(every[at : at + step], np.int64).reshape(-1, k)

    def _counted(self, asked: dict[int, tuple[np.ndarray, int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, places among the keys that are asked for, counts by class) from the last version of the counts."""
        if not self.version or not asked:
            return
        names = [f"n_c{c}" for c in range(self.classes)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, sets = batch.column("part").to_numpy(), np.stack([batch.column(c).to_numpy() for c in _KEYS[1:]])
                for p, (items, base, keys) in asked.items():
                    rows = np.flatnonzero(part == p)
                    numbers = _numbers(items, sets[:, rows])
                    spot = np.where(((numbers > 0) | (sets[:, rows] == 0)).all(0), _spots(_key(numbers, base), keys), -1)
                    hit = spot >= 0
                    if hit.any():
                        own = batch.take(pa.array(rows[hit]))
                        yield pa.RecordBatch.from_arrays([own.column("part"), pa.array(spot[hit]), *(own.column(c) for c in names)], names=["part", "spot", *names])

        found = self.counts.mapInArrow(run, "part int, spot long, " + ", ".join(f"{c} long" for c in names)).toArrow()
        part, spot, n = found.column("part").to_numpy(), found.column("spot").to_numpy(), np.stack([found.column(c).to_numpy() for c in names])
        for p in np.unique(part).tolist():
            yield p, spot[part == p], n[:, part == p]

    def _mapped(self, most: int | None = None) -> DataFrame:
        """The documents with their rules as they are now; of every partition at least the ``most`` first."""
        changes = {part: Changes(np.concatenate([sets for sets, _ in xs], 1), np.concatenate([delta for _, delta in xs]), self.sizes) for part, xs in self.changed.items()}
        for part, x in changes.items():  # what has been added up need not be added up again
            self.changed[part] = [(x.items[_members(x.keys, x.base) - 1] * (_members(x.keys, x.base) > 0), x.net)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                part, ids = batch.column("part").to_numpy(), batch.column("ids")
                rules = batch.column("rules").to_numpy().copy()
                start = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                for p, x in changes.items():
                    rows = np.flatnonzero(part == p)
                    if len(rows):
                        spot, first = B.ranges(start[rows], start[rows + 1])
                        rules[rows] += x.sums(np.append(first, len(spot)), flat[spot])
                out = pa.Table.from_batches([batch.set_column(batch.schema.get_field_index("rules"), "rules", pa.array(rules))])
                if most:
                    held = _firsts(out if held is None else pa.concat_tables([held, out]), most)
                else:
                    yield from out.to_batches()
            if held is not None:
                yield from held.combine_chunks().to_batches()

        return self.docs.mapInArrow(run, _STATE)

    def look(self, parts: list[int]) -> None:
        """Bring the leading documents of every partition."""
        lead, by = self.lead, Window.partitionBy("part").orderBy("rules", "df_sum", F.desc("doc_idx"))
        rows = self._mapped(lead + 1).where(F.col("part").isin(parts)).withColumn("place", F.row_number().over(by)).where(F.col("place") <= lead + 1)
        found: dict[int, list] = {}
        for r in rows.toArrow().to_pylist():
            found.setdefault(r["part"], []).append(r)
        bounds = {}
        for part, own in found.items():
            own.sort(key=lambda r: r["place"])
            sets = np.cumsum([sum(comb(len(r["ids"]), size) for size in self.sizes) for r in own])
            kept = min(lead, max(1, int(np.searchsorted(sets, SETS, "right"))))
            bounds[part] = (own[kept]["rules"], own[kept]["df_sum"], -own[kept]["doc_idx"]) if len(own) > kept else None
            found[part] = own[:kept]
        self.know({part: [(r["doc_idx"], r["label"], r["ids"]) for r in own] for part, own in found.items()})
        self.leaders = {part: Leaders(self.known[part], [r["df_sum"] for r in own], [r["rules"] for r in own], bounds[part]) for part, own in found.items()}


def _spots(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The places of keys in ``among`` (sorted, not empty); -1 for others."""
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def _firsts(docs: pa.Table, most: int) -> pa.Table:
    """The ``most`` first of each partition."""
    part, rules, df_sum, doc = (docs.column(c).to_numpy() for c in ("part", "rules", "df_sum", "doc_idx"))
    order = np.lexsort((-doc, df_sum, rules, part))
    _, first, n = np.unique(part[order], return_index=True, return_counts=True)
    return docs.take(pa.array(order[np.arange(len(order)) - np.repeat(first, n) < most]))


def _logged(folder: Folder) -> list[dict]:
    """The committed rounds, in order."""
    out = []
    for k in sorted(int(x[6:-5]) for x in folder.names() if x.startswith("round-") and x.endswith(".json")):
        found = folder.read(f"round-{k}")
        out += found.get("rounds", [found])  # older logs have a file for each round
    return out


def selective_sampling(docs: DataFrame, sums: DataFrame, min_conf: float = 0.001, min_sup: int = 1, max_rule_size: int = 4, classes: int = 2, rounds: int | None = None, log: str | None = None, lead: int = LEAD) -> DataFrame:
    """part, step, doc_idx, rules, repeated: the documents in the order they were taken; step 0 is the seed.

    ``docs`` has part, doc_idx, label, items; ``sums`` part, doc_idx, df_sum. The last row of a converged partition has
    ``repeated``: the document whose second choice ended it, which is not taken again. ``rounds`` stops early. ``log`` is a
    folder that all executors share; a run with a log that holds committed rounds goes on from there. Without it, a folder
    of its own is used and deleted in the end. ``lead`` (see ``LEAD``) changes only the time. A document's subsets (of up to three items) are held at once.
    """
    spark: SparkSession = docs.sparkSession
    folder = Folder(spark, log or f"{shared_dir(spark)}/sampling-{uuid.uuid4().hex}")
    run = _Run(spark, folder, antecedents(max_rule_size), min_conf, min_sup, classes, lead)
    done = folder.read("begun")
    if done is None:  # what an earlier start left unfinished is written again
        own = docs.select("part", "doc_idx", "label", "items")
        ids = B.with_ids(own, B.item_ids(own), ["part", "doc_idx"])
        rows = own.drop("items").join(ids, ["part", "doc_idx"], "left").join(sums.select("part", "doc_idx", "df_sum"), ["part", "doc_idx"])
        seen = run.begin(rows.select(F.col("part").cast("int").alias("part"), F.col("doc_idx").cast("long").alias("doc_idx"), F.col("label").cast("int").alias("label"), F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.col("df_sum").cast("long").alias("df_sum"), F.lit(0).cast("long").alias("rules")))
        row = F.struct("doc_idx", "label", "ids")
        run.open(0)
        seeds = {r["part"]: r["x"] for r in run.docs.groupBy("part").agg(F.max_by(row, F.struct("df_sum", "doc_idx")).alias("x")).collect()}
        folder.commit("begun", {"seen": seen, "seeds": [[part, x["doc_idx"], x["label"], x["ids"]] for part, x in sorted(seeds.items())]})
        done = folder.read("begun")
    picks = {part: (doc, label, ids) for part, doc, label, ids in done["seeds"]}
    out = [(part, 0, doc, 0, False) for part, (doc, _, _) in picks.items()]
    taken: dict[int, set[int]] = {part: set() for part in picks}
    run.open(folder.last("version"))
    logged = _logged(folder)
    again: dict[int, dict[int, tuple]] = {part: {doc: (doc, label, ids)} for part, (doc, label, ids) in picks.items()} if not run.version else {}
    for found in logged[max(run.version - 1, 0) :]:  # the version lacks what its last round took
        for part, doc, label, ids, _ in found["picks"]:
            again.setdefault(part, {})[doc] = (doc, label, ids)
    run.know({part: list(own.values()) for part, own in again.items()})
    step, began = 0, time.monotonic()
    held: list[dict] = []

    def commit() -> None:
        if held:
            folder.commit(f"round-{step}", {"rounds": held})
            held.clear()

    while picks and (rounds is None or step < rounds):
        if step >= run.version:  # what is before is in the tables
            run.add(picks)
        if step < len(logged):
            found = logged[step]
        else:
            start = time.monotonic()
            best = {part: run.leaders[part].first() if part in run.leaders else None for part in picks}
            looked = None in best.values()
            if looked:
                commit()
                run.look(sorted(picks))
                best = {part: run.leaders[part].first() for part in picks}
            found = {"seconds": time.monotonic() - start, "looked": looked, "picks": [[part, *x] for part, x in sorted(best.items())]}
            held.append(found)
        step += 1
        picks = {}
        for part, doc, label, ids, rules in found["picks"]:
            repeated = doc in taken[part]
            if repeated:
                log_.info("partition %s converged after %s rounds, %.1f s", part, step, time.monotonic() - began)
            out.append((part, step, doc, rules, repeated))
            if not repeated:
                taken[part].add(doc)
                picks[part] = (doc, label, ids)
        if step - run.version >= SAVE_EVERY and picks:
            commit()
            run.save(step)
    commit()
    if log is None:
        folder.delete("")
    return spark.createDataFrame(out, _PICKS)


def partition_summary(picks: DataFrame) -> DataFrame:
    """part, iterations (documents taken, a repeated seed included), repeated_idx (the document that ended the partition)."""
    return picks.groupBy("part").agg(F.count_if(~F.col("repeated")).alias("iterations"), F.max(F.when(F.col("repeated"), F.col("doc_idx"))).alias("repeated_idx"))


def diagnostics(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """metric, part, value of a run over ``docs`` (part, doc_idx, label, items): documents, items and rounds of every partition,
    documents taken there, and (part -1) all documents and the size of the reduced set."""
    metric = lambda name, rows, value: rows.groupBy("part").agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "part", "value")
    every = lambda name, rows: rows.select(F.lit(-1).alias("part"), "doc_idx").transform(lambda x: metric(name, x, F.count_distinct("doc_idx")))
    taken = picks.where(~F.col("repeated"))
    out = metric("documents", docs, F.count("*")).unionByName(metric("items", docs, F.sum(F.size("items")))).unionByName(metric("rounds", picks, F.max("step")))
    return out.unionByName(metric("taken", taken, F.count_distinct("doc_idx"))).unionByName(every("documents", docs)).unionByName(every("reduced", taken))


def measured(spark: SparkSession, log: str) -> DataFrame:
    """metric, value of the run with this log: rows and items that it read, rounds, the seconds that they took, and the
    rounds that looked at the documents."""
    folder = Folder(spark, log)
    found = _logged(folder)
    seconds = sum(x["seconds"] for x in found)
    seen = folder.read("begun")["seen"]
    return spark.createDataFrame([*((k, float(v)) for k, v in sorted(seen.items())), ("rounds", float(len(found))), ("seconds", seconds), ("looks", float(sum(x.get("looked", True) for x in found)))], "metric string, value double")


def reduced_set(picks: DataFrame) -> DataFrame:
    """doc_idx: the documents taken in any partition, each once."""
    return picks.where(~F.col("repeated")).select("doc_idx").distinct()
