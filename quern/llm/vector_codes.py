"""Vector codes: product quantisation fitted by the filtering form of Lloyd's algorithm.

Every component x becomes floor(256 * x), every vector is cut into ``PARTS`` equal consecutive parts, and every part
position has a codebook of ``ENTRIES`` entries at most. Each partition of the table builds kd-trees over its parts, one
for each position and block of ``BLOCK`` vectors; a node caches the number and the sum of its points and their bounding
box. A round walks the trees from the root, all nodes of a level at once: of the entries that may still be the nearest of
a node's points it keeps those that no other entry beats over the whole box. A node with one entry left is assigned at
once, with its cached sum and count; only leaves with several look at single points. All of it is exact integer
arithmetic, so ties go to the lower entry as they would point by point.

The trees are built once and saved; a round sends the executors the codebooks (``PARTS * ENTRIES`` entries, of fixed
size) and gets back sums and counts of every entry, added up by task and then by a group-by.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, saved, settings, skew_join, small, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that share a tree, at most, and points of a leaf.
BLOCK, LEAF = 4096, 16
#: Integer components are held within +-``LIMIT``, so that squared distances fit 64 bits.
LIMIT = 1 << 24
#: Blocks in one Arrow batch.
_FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}


@dataclass
class Tree:
    """A kd-tree over the rows of ``points``; the points of node i are ``order[start[i]:end[i]]``, its children ``left[i]``
    and ``left[i] + 1`` (-1: a leaf)."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all ranges one after the other, where each range begins there)."""
    n = end - start
    first = np.cumsum(n) - n
    return np.repeat(start - first, n) + np.arange(n.sum()), first


def kd_tree(points: np.ndarray) -> Tree:
    """Level by level: nodes with more than ``LEAF`` points, not all equal, are cut at the median of their widest dimension."""
    order = np.arange(len(points))
    start, end = np.array([0]), np.array([len(points)])
    levels, nodes = [], 0
    while len(start):
        rows, first = _ranges(start, end)
        own = points[order[rows]]
        low, high, total = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), np.add.reduceat(own.astype(np.int64), first)
        wide = high - low
        cut = (end - start > LEAF) & (wide.max(1) > 0)
        nodes += len(start)
        levels.append((start, end, np.where(cut, nodes + 2 * (np.cumsum(cut) - 1), -1), low, high, total))
        s, e, axis = start[cut], end[cut], wide[cut].argmax(1)
        if not len(s):
            break
        rows, _ = _ranges(s, e)
        node = np.repeat(np.arange(len(s)), e - s)
        order[rows] = order[rows[np.lexsort((points[order[rows], axis[node]], node))]]
        middle = s + (e - s) // 2
        start, end = np.stack([s, middle], 1).ravel(), np.stack([middle, e], 1).ravel()
    return Tree(points, order, *(np.concatenate(x) for x in zip(*levels)))


def _beaten(low: np.ndarray, high: np.ndarray, entries: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every box the open entry nearest to its middle, and the entries that one beats at every point of the box.

    Entry z loses to s over the whole box if it loses at the corner that lies farthest towards z; of a draw the lower one wins.
    """
    far = np.where(open_, ((2 * entries[None] - (low + high)[:, None]) ** 2).sum(-1), np.iinfo(np.int64).max)
    best = far.argmin(1)
    near = entries[best][:, None]
    corner = np.where(entries[None] > near, high[:, None], low[:, None])
    gap = ((entries[None] - corner) ** 2 - (near - corner) ** 2).sum(-1)
    return best, (gap > 0) | ((gap == 0) & (np.arange(len(entries)) > best[:, None]))


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of every point, sums and counts of every entry)."""
    out = np.empty(len(tree.points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    nodes, open_ = np.array([0]), np.ones((1, len(entries)), bool)
    while len(nodes):
        best, beaten = _beaten(tree.low[nodes].astype(np.int64), tree.high[nodes].astype(np.int64), entries, open_)
        open_ = open_ & ~beaten
        left = tree.left[nodes]
        whole, leaf = open_.sum(1) == 1, left < 0
        done = nodes[whole]
        np.add.at(sums, best[whole], tree.total[done])
        np.add.at(counts, best[whole], tree.end[done] - tree.start[done])
        rows, _ = _ranges(tree.start[done], tree.end[done])
        out[tree.order[rows]] = np.repeat(best[whole], tree.end[done] - tree.start[done])
        single = nodes[leaf & ~whole]
        if len(single):
            rows, _ = _ranges(tree.start[single], tree.end[single])
            points = tree.points[tree.order[rows]].astype(np.int64)
            far = ((points[:, None] - entries[None]) ** 2).sum(-1)
            still = np.repeat(open_[leaf & ~whole], tree.end[single] - tree.start[single], axis=0)
            own = np.where(still, far, np.iinfo(np.int64).max).argmin(1)
            out[tree.order[rows]] = own
            np.add.at(sums, own, points)
            np.add.at(counts, own, 1)
        more = ~leaf & ~whole
        nodes = np.stack([left[more], left[more] + 1], 1).ravel()
        open_ = np.repeat(open_[more], 2, axis=0)
    return out, sums, counts


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """q_id, q_label (a text, also for no label), q_x (integer components) of the vectors that count."""
    v, value = F.col(f"`{vector_col}`"), lambda x: x.cast("double")
    good = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), value(x) * 256))).cast("int"))
    label = F.coalesce(F.concat(F.lit("="), F.col(f"`{label_col}`").cast("string")), F.lit(""))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("q_id"), label.alias("q_label"), whole.alias("q_x"))


def _forest(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors of a partition: their ids and labels, and the pickled trees of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            got = pa.Table.from_batches(held).combine_chunks()
            x = got.column("q_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), parts, width // parts).astype(np.int32)
            trees = [kd_tree(np.ascontiguousarray(x[:, i])) for i in range(parts)]
            ids, labels = got.column("q_id").to_pylist(), got.column("q_label").to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([pickle.dumps(trees, 5)], pa.binary())], names=["ids", "labels", "trees"])

        n = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, BLOCK - n)
                at, n = at + some.num_rows, n + some.num_rows
                held.append(some)
                if n == BLOCK:
                    yield block()
                    held, n = [], 0
        if held and n:
            yield block()
        released()

    return rows.where(F.size("q_x") == width).mapInArrow(run, "ids array<long>, labels array<string>, trees binary")


def _round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; the driver gets one row for each used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            for blob in batch.column("trees"):
                for tree, entries, (sums, counts) in zip(pickle.loads(blob.as_py()), books, found):
                    _, s, n = assigned(tree, entries)
                    sums += s
                    counts += n
        rows = [(part, entry, d, int(sums[entry, d]), int(counts[entry])) for part, (sums, counts) in enumerate(found) for entry in np.flatnonzero(counts).tolist() for d in range(sums.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.int64()] * 2)] if rows else [pa.array([], t) for t in [pa.int32()] * 3 + [pa.int64()] * 2], names=["part", "entry", "dim", "s", "n"])
        released()

    sums = forest.select("trees").mapInArrow(run, "part int, entry int, dim int, s long, n long").groupBy("part", "entry", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r["part"]][r["entry"], r["dim"]] = r["s"] // r["n"]
    return out


def _codes(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """q_id, q_label, code, error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for ids, labels, blob in zip(batch.column("ids"), batch.column("labels"), batch.column("trees")):
                code, error = [], 0
                for tree, entries in zip(pickle.loads(blob.as_py()), books):
                    own = assigned(tree, entries)[0]
                    code.append(digits[own])
                    error = error + ((tree.points.astype(np.int64) - entries[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(["".join(x) for x in zip(*code)], pa.string()), pa.array(error, pa.int64())], names=["q_id", "q_label", "code", "error"])
        released()

    return forest.mapInArrow(run, "q_id long, q_label string, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Null vectors, those with a null or non-finite component, and those whose length is no positive multiple of ``parts``
    or differs from that of the usable vector with the smallest id are left out. Codebooks start as the parts of the
    ``entries`` smallest ids (at most 256, two hex digits); null ids come last, of equal ids the smaller vector comes
    first; with fewer vectors the codebooks are smaller. Components beyond 65,536 count as that. ``label_error`` is null
    if it does not fit 64 bits. Repeated rows are all coded; an empty table gives an empty result; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = _usable(vectors, id_col, vector_col, label_col, parts)
    first = rows.select("q_x").orderBy(F.col("q_id").asc_nulls_last(), "q_x").limit(1).collect()
    width = len(first[0]["q_x"]) if first else parts
    seeds = rows.where(F.size("q_x") == width).orderBy(F.col("q_id").asc_nulls_last(), "q_x").limit(entries).select("q_x").collect()
    start = np.array([r["q_x"] for r in seeds], np.int64).reshape(-1, parts, width // parts)
    books = [start[:, i].copy() for i in range(parts)]
    forest = saved(_forest(rows, width, parts), **_FEW)
    with settings(forest.sparkSession, **_FEW):
        for _ in range(rounds):
            books = _round(forest, books)
    found = saved(_codes(forest, books), **_FEW)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    errors = saved(found.groupBy("q_label").agg(F.try_sum("error").alias("label_error")))
    few = small(errors)
    both = found.join(few, "q_label") if few is not errors else skew_join(found, errors, "q_label")
    return both.select(F.col("q_id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    nearest = lambda k: f"""near{k} AS (
  SELECT p.r, p.label, p.vec_id, p.part, p.v, arg_min(struct_pack(e := c.entry, d := {_SQUARES}), ({_SQUARES}, c.entry)) AS x FROM parts p JOIN book{k} c ON c.part = p.part GROUP BY ALL
)"""  # noqa: E731
    moved = lambda k: f"""mean{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT part, x.e AS entry, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM near{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL
), book{k + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""  # noqa: E731
    rounds = ", ".join(f"{nearest(k)}, {moved(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)
), book0 AS (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= {ENTRIES}), {rounds}, {nearest(ROUNDS)},
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
codes AS (SELECT r, vec_id, label, string_agg(printf('%02x', x.e), '' ORDER BY part) AS code, sum(x.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, digest
"""


_SQUARES = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
ORACLE_SQL = _oracle()
