"""Language-model scores: a hidden Markov model trained by Baum-Welch, next to an add-one unigram model.

Tokens are the words of a text in lower case (A-Z only) and one end token. All counts are exact, over every training
row, with any number of distinct words, and every word has emissions of its own in each state:

* the *head*, the ``HEAD`` most frequent words of all training rows, has numbers; its counts are vectors that add up;
* all other words, the *tail*, go to fragments by their hash. A fragment numbers its words, sums their counts over all
  rows and answers each piece of text with the sums of the piece's words: the plain counts first, then, after every
  round, the expected counts of all states but the last, which has the rest of the plain count.

The head's vectors are cut into slices and added up in two steps, for groups of tasks first, so no task adds up those of all.

So the size of the head changes only the cost. Words that no training row has share one add-one count. Baum-Welch counts
are summed over partitions, all training rows in each round. There are ``ROUNDS`` rounds at most, and no further one once a
round has gained less than ``LEAST_GAIN`` over the one before. The score is the exact likelihood of the
whole text by the scaled forward recursion.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import fold, partition_keys, pieces, released, saved, saved_in_place, table, utf8
from .hmm import Counts, Hmm, log_likelihood

log_ = logging.getLogger(__name__)

#: Words with numbers of their own, at most. A fixed size, whatever the input; it changes the cost, not the result.
HEAD = 1 << 17
STATES = 4
ROUNDS = 2
#: Gain in the natural logarithm of the likelihood a training token below which training ends.
LEAST_GAIN = 1e-4
#: Text bytes of a piece, about, and of the pieces of one task; there are as many fragments as tasks.
PIECE_BYTES = 8 << 20
TASK_BYTES = 32 << 20
#: Tokens of the texts that advance together, about.
TOGETHER = 300_000
#: Token numbers in one slice of the summed counts.
SLICE = 2048
END = 0


def _head(train: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of all rows and their counts."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in utf8(part.column("text")):
                    seen.update(text.lower().split())
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = train.select("text").mapInArrow(run, "word binary, n long")
    top = [(bytes(r["word"]), r["n"]) for r in counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).toLocalIterator()]
    return [w for w, _ in top], np.array([n for _, n in top], float)


def _packed(raw: bytes) -> bytes:
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _raw(blob: bytes) -> bytes:
    return pa.decompress(blob[4:], int(np.frombuffer(blob, "<u4", 1)[0]), "zstd", asbytes=True)


def _sliced(total: np.ndarray) -> list[tuple[int, bytes]]:
    """(slice, blob) of the rows of a count matrix that are not zero: their numbers within the slice (left out where all
    rows are there), then their values."""
    out = []
    rows = np.flatnonzero(total.any(1))
    for own in np.split(rows, np.flatnonzero(np.diff(rows // SLICE)) + 1) if len(rows) else []:
        at = int(own[0]) // SLICE
        if 4 * len(own) > 3 * SLICE:
            own = np.arange(at * SLICE, min((at + 1) * SLICE, len(total)))
        named = (own % SLICE).astype("<u4") if len(own) < SLICE else np.zeros(0, "<u4")
        out.append((at, np.uint32(len(own)).tobytes() + named.tobytes() + total[own].astype("<f4").tobytes()))
    return out


def _add(total: np.ndarray, blob: bytes) -> None:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    if n == SLICE:
        total += np.frombuffer(blob, "<f4", -1, 4).reshape(n, -1)
    else:
        total[np.frombuffer(blob, "<u4", n, 4)] += np.frombuffer(blob, "<f4", -1, 4 + 4 * n).reshape(n, -1)


def _encoded(docs: DataFrame, words, deal: list[int]) -> DataFrame:
    """kind 0: a piece of texts (key, doc_ids, blob); kind 1: its distinct tail words of a fragment and their training counts.

    Rows are dealt by ``key``: a number of the piece's own for kind 0, ``deal[fragment]`` for kind 1 (``piece`` is the piece).

    Token numbers are 0 for the end token, then the head, then the tail words of the piece, fragment by fragment.
    """

    def run(batches):
        number = {w: i + 1 for i, w in enumerate(words.value)}.get
        size = len(words.value) + 1
        fragments = len(deal)
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                local: dict[bytes, int] = {}
                train = np.array(part.column("train").to_pylist(), bool)
                flat, lens = [], []
                for text in utf8(part.column("text")):
                    own = [number(w) or local.setdefault(w, size + len(local)) for w in text.lower().split()]
                    flat.append(np.array([*own, END], np.int64))
                    lens.append(len(own) + 1)
                ids, tail = np.concatenate(flat), list(local)
                hashes = np.fromiter((crc32(w) for w in tail), np.int64, len(tail))
                at = hashes % fragments
                order = np.argsort(at, kind="stable")
                place = np.empty(len(tail), np.int64)
                place[order] = np.arange(len(tail))
                ids[ids >= size] = size + place[ids[ids >= size] - size]
                n = np.bincount(ids[np.repeat(train, lens)], minlength=size + len(tail))[size:].astype("<u4")
                names, first = np.unique(at[order], return_index=True)
                bounds = np.append(first, len(tail))
                head = np.array([len(lens), len(tail), len(names)], "<u4")
                blob = head.tobytes() + np.concatenate([names, np.diff(bounds), lens, ids]).astype("<u4").tobytes() + train.tobytes() + (hashes[order] % STATES).astype("u1").tobytes()
                rows = [(0, key, None, None, part.column("doc_id").to_pylist(), _packed(blob))]
                for name, a, b in zip(names.tolist(), bounds, bounds[1:]):
                    rows.append((1, deal[name], key, name, None, _packed(np.uint32(b - a).tobytes() + n[a:b].tobytes() + b" ".join(tail[i] for i in order[a:b]))))
                key += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                columns = list(zip(*rows))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 64], k) for x, k in zip(columns, kinds)], names=["kind", "key", "piece", "fragment", "doc_ids", "blob"])
        released()

    return docs.mapInArrow(run, "kind int, key long, piece long, fragment int, doc_ids array<long>, blob binary")


class _Piece:
    """One row of kind 0, with the answers of the fragments to it."""

    def __init__(self, blob: bytes, size: int):
        blob = _raw(blob)
        docs, self.tail, names = (int(x) for x in np.frombuffer(blob, "<u4", 3))
        at = 12
        self.fragments, count, self.lens = (np.frombuffer(blob, "<u4", n, at + 4 * k).astype(np.int64) for n, k in ((names, 0), (names, names), (docs, 2 * names)))
        at += 8 * names + 4 * docs
        self.bounds = np.append(0, np.cumsum(count))
        self.flat = np.frombuffer(blob, "<u4", int(self.lens.sum()), at).astype(np.int64)
        at += 4 * len(self.flat)
        self.train = np.frombuffer(blob, bool, docs, at)
        self.lean = np.frombuffer(blob, "u1", self.tail, at + docs)
        self.size = size

    def blocks(self, picked: np.ndarray):
        """Token numbers of the picked texts, some ``TOGETHER`` at a time."""
        own, held = [], 0
        for yes, ids in zip(picked.tolist(), np.split(self.flat, np.cumsum(self.lens)[:-1])):
            if yes:
                if own and held + len(ids) > TOGETHER:
                    yield own
                    own, held = [], 0
                own.append(ids)
                held += len(ids)
        if own:
            yield own

    def answered(self, answers: list[dict] | None, kind: str, width: int) -> np.ndarray:
        """tail words x width"""
        out = np.zeros((self.tail, width), kind)
        found = {x["fragment"]: x["blob"] for x in answers or []}
        for name, a, b in zip(self.fragments.tolist(), self.bounds, self.bounds[1:]):
            out[a:b] = np.frombuffer(found[name], kind).reshape(width, b - a).T
        return out


def _numbered(asked: DataFrame) -> DataFrame:
    """Fragments number the words that the pieces name and sum their counts; key, fragment, blob of (number, count) a word.

    Key -1: the number of words that have a count, the sum of counts, and the add-one counts by the states words lean to.
    """

    def run(batches):
        held: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for name, key, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "piece", "blob"))):
                held.setdefault(name, {})[key] = blob
        total = np.zeros(2 + STATES)
        for name in sorted(held):
            number: dict[bytes, int] = {}
            index, counts = {}, []
            for key, blob in sorted(held.pop(name).items()):
                raw = _raw(blob)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                index[key] = np.array([number.setdefault(w, len(number)) for w in raw[4 + 4 * n :].split(b" ")], np.int64)
                counts.append(np.frombuffer(raw, "<u4", n, 4))
            sums = np.bincount(np.concatenate(list(index.values())), np.concatenate(counts), len(number)).astype(np.int64)
            seen = sums > 0
            leans = np.fromiter((crc32(w) % STATES for w in number), np.int64, len(number))
            total += [seen.sum(), sums.sum(), *np.bincount(leans[seen], sums[seen] + 1, STATES)]
            keys = list(index)
            for at in range(0, len(keys), 100):
                own = keys[at : at + 100]
                blobs = [np.stack([index[k], sums[index[k]]]).astype("<u4").tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([name] * len(own), pa.int32()), pa.array(blobs, pa.binary())], names=["key", "fragment", "blob"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["key", "fragment", "blob"])

    return asked.select("fragment", "piece", "blob").mapInArrow(run, "key long, fragment int, blob binary")


def _slice_row(key: int, name: int, total: np.ndarray) -> pa.RecordBatch:
    blobs = [blob for _, blob in _sliced(total)]
    return pa.RecordBatch.from_arrays([pa.array([key] * len(blobs), pa.int64()), pa.array([name] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["key", "fragment", "blob"])


def _slices(state: DataFrame) -> DataFrame:
    """key -1, fragment, blob: the head's slices of all groups of tasks added up; as many blobs meet as there are groups."""

    def run(batches):
        heads: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "blob"))):
                _add(heads.setdefault(name, np.zeros((SLICE, STATES - 1))), blob)
        for name, total in heads.items():
            yield _slice_row(-1, name, total)

    return state.where("key < 0").select("fragment", "blob").repartition("fragment").mapInArrow(run, "key long, fragment int, blob binary")


def _answered(sent: DataFrame, parts: int) -> DataFrame:
    """Fragments sum the expected counts that pieces send (numbers, then counts) and answer with the sums of their words.

    Rows of negative keys are slices of the head's counts; they are summed by slice and group of tasks (the key).
    """

    def run(batches):
        held: dict[int, dict[int, bytes]] = {}
        heads: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for name, key, blob in zip(*(batch.column(c).to_pylist() for c in ("fragment", "key", "blob"))):
                if key < 0:
                    _add(heads.setdefault((key, name), np.zeros((SLICE, STATES - 1))), blob)
                else:
                    held.setdefault(name, {})[key] = blob
        names = ["key", "fragment", "blob"]
        for (key, name), total in heads.items():
            yield _slice_row(key, name, total)
        for name in sorted(held):
            own = sorted(held.pop(name).items())
            words = [len(blob) // (4 * STATES) for _, blob in own]
            index = [np.frombuffer(blob, "<u4", n) for (_, blob), n in zip(own, words)]
            sums = np.zeros((max(int(x.max()) for x in index) + 1, STATES - 1))
            for (_, blob), at, n in zip(own, index, words):
                sums[at] += np.frombuffer(blob, "<f4", -1, 4 * n).reshape(n, STATES - 1)
            for at in range(0, len(own), 100):
                some = range(at, min(at + 100, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([own[i][0] for i in some], pa.int64()), pa.array([name] * len(some), pa.int32()), pa.array([sums[index[i]].T.astype("<f4").tobytes() for i in some], pa.binary())], names=names)

    return sent.repartition(parts, "dest").select("key", "fragment", "blob").mapInArrow(run, "key long, fragment int, blob binary")


def _by_piece(answers: DataFrame, name: str, parts: int) -> DataFrame:
    """One row for each piece."""
    return answers.where("key >= 0").repartition(parts, "key").groupBy("key").agg(F.collect_list(F.struct("fragment", "blob")).alias(name)).hint("merge")


class Trained:
    """The unigram totals, the head's counts and the hidden Markov model; of a fixed size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tail: np.ndarray):
        self.counts, self.size = counts, len(counts)
        types, tokens, mass = int(tail[0]), int(tail[1]), tail[2:]
        self.tokens = int(counts.sum()) + tokens
        self.types = int((counts > 0).sum()) + types
        #: words with emissions: those seen, the end token (always) and one for all words that were not seen
        self.space = len(words) + types + 2
        self.lean = np.array([crc32(w) % STATES for w in (b"", *words)])
        self.leaning = True
        # states start out with preferences for words by their hash, and like to stay
        self.below = self._leaning(counts, self.lean).sum(0) + mass.sum() + 2 * mass + 1
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.4 / STATES) + 0.6 * np.eye(STATES)
        self.of_head = self.emissions(counts, None, self.lean)

    def _leaning(self, n: np.ndarray, lean: np.ndarray) -> np.ndarray:
        return (n + 1)[:, None] * np.where((lean[:, None] == np.arange(STATES)) & (n > 0)[:, None], 3.0, 1.0)

    def emissions(self, n: np.ndarray, expected: np.ndarray | None, lean: np.ndarray) -> np.ndarray:
        """Words x states, from counts (before the first round) or expected counts by state."""
        top = self._leaning(n, lean) if self.leaning else expected + self.share
        return (top / self.below).astype(np.float32)

    def improve(self, counts: Counts, tail_visits: np.ndarray) -> None:
        # the last state has the rest of the plain count
        counts.emit[:, -1] = np.maximum(self.counts - counts.emit[:, :-1].sum(1), 0)
        # add one for every word, shared out over the states by how often they are visited
        visits = counts.emit.sum(0) + tail_visits + 1e-9
        self.share = visits / visits.sum()
        self.leaning, self.below = False, visits + self.share * self.space
        move, start = counts.move + 0.1, counts.start + 0.1
        self.start, self.move = start / start.sum(), move / move.sum(1, keepdims=True)
        self.of_head = self.emissions(self.counts, counts.emit, self.lean)

    def hmm(self, piece: _Piece, n: np.ndarray, answers: list[dict] | None) -> Hmm:
        """The model over the head and the tail words of a piece."""
        expected = None
        if not self.leaning:
            own = piece.answered(answers, "<f4", STATES - 1).astype(float)
            expected = np.column_stack([own, np.maximum(n - own.sum(1), 0)])
        return Hmm(self.start, self.move, np.concatenate([self.of_head, self.emissions(n, expected, piece.lean)]).T)


def _expected(joined: DataFrame, shared, deal: list[int]) -> DataFrame:
    """Baum-Welch counts of all states but the last. Negative keys: those of a task's head, sliced (fragment is the slice; the
    last one holds moves, first states, visits of tail words and the likelihood; the key is -1 less the group of the task);
    other keys: those of a piece's tail words, by fragment. ``dest`` deals the rows."""
    groups = math.isqrt(len(deal) - 1) + 1

    def run(batches):
        trained: Trained = shared.value
        size = trained.size
        all_counts, tail_visits = Counts(STATES, size), np.zeros(STATES)
        names = ["dest", "key", "fragment", "blob"]

        def rows_of(keys: list[int], fragments: list[int], blobs: list[bytes], shift: int = 0) -> pa.RecordBatch:
            dest = [deal[(x + shift) % len(deal)] for x in fragments]
            return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(keys, pa.int64()), pa.array(fragments, pa.int32()), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                key, blob, plain, state = (batch.column(c)[i].as_py() for c in ("key", "blob", "plain", "state"))
                piece = _Piece(blob, size)
                number, n = piece.answered(plain, "<u4", 2).T
                model = trained.hmm(piece, n.astype(float), state)
                counts = Counts(STATES, size + piece.tail)
                for block in piece.blocks(piece.train):
                    counts.add(model, block)
                all_counts.emit += counts.emit[:size]
                all_counts.move += counts.move
                all_counts.start += counts.start
                all_counts.log += counts.log
                tail_visits += counts.emit[size:].sum(0)
                own = counts.emit[size:, :-1].astype("<f4")
                blobs = [number[a:b].tobytes() + own[a:b].tobytes() for a, b in zip(piece.bounds, piece.bounds[1:])]
                yield rows_of([key] * len(blobs), piece.fragments.tolist(), blobs)
        extra = np.concatenate([all_counts.move.ravel(), all_counts.start, tail_visits, [all_counts.log]])
        extra = np.append(extra, np.zeros(-len(extra) % (STATES - 1))).reshape(-1, STATES - 1)
        own = _sliced(all_counts.emit[:, :-1]) + [(-(-size // SLICE) + k, b) for k, b in _sliced(extra)]
        group = TaskContext.get().partitionId() % groups
        yield rows_of([-1 - group] * len(own), [x for x, _ in own], [x for _, x in own], group * (-(-size // SLICE) + 1))
        released()

    return joined.select("key", "blob", "plain", "state").mapInArrow(run, "dest long, key long, fragment int, blob binary")


def _scored(joined: DataFrame, shared) -> DataFrame:
    def run(batches):
        trained: Trained = shared.value
        per_token = math.log10(trained.tokens + trained.types + 1)
        for batch in batches:
            for i in range(batch.num_rows):
                blob, plain, state, doc_ids = (batch.column(c)[i].as_py() for c in ("blob", "plain", "state", "doc_ids"))
                piece = _Piece(blob, trained.size)
                n = piece.answered(plain, "<u4", 2)[:, 1].astype(float)
                model = trained.hmm(piece, n, state)
                found = np.concatenate([log_likelihood(model, block) for block in piece.blocks(np.ones(len(piece.lens), bool))])
                seen = np.concatenate([trained.counts, n])[piece.flat]
                first = np.cumsum(piece.lens) - piece.lens
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array(~piece.train), pa.array(piece.lens), pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)),
                        pa.array(np.add.reduceat(np.log10(seen + 1.0), first) - piece.lens * per_token), pa.array(found / math.log(10)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, among: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """One row per input row: doc_id, held_out (not ``among``), n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end token only. Ids may be null or repeat. Without a training row every count is 0
    and the model is the smoothed start. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), among.alias("train"))
    words, counts = _head(own.where("train"), head)
    size, ends = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    deal = partition_keys(spark, parts)
    # one shuffle puts pieces and fragments in place; the checkpoint keeps the partitioning, so no round moves the texts
    placed = saved_in_place(_encoded(own, spark.sparkContext.broadcast(words), deal).repartition(parts, "key"))
    plain = saved(_numbered(placed.where("kind = 1")))
    tail = sum((np.frombuffer(r["blob"], "<f8") for r in plain.where("key < 0").toLocalIterator()), np.zeros(2 + STATES))
    trained = Trained(words, np.append(float(ends), counts), tail)
    with_plain = placed.where("kind = 0").select("key", "doc_ids", "blob").join(saved_in_place(_by_piece(plain, "plain", parts)).hint("merge"), "key", "left")
    del plain
    joined = with_plain.withColumn("state", F.lit(None).cast("array<struct<fragment:int,blob:binary>>"))
    slices = -(-trained.size // SLICE)
    likelihood = -math.inf
    for number in range(rounds):
        state = saved(_answered(_expected(joined, spark.sparkContext.broadcast(trained), deal), parts))
        total = np.zeros((slices + 1, SLICE, STATES - 1))
        for r in _slices(state).toLocalIterator():
            _add(total[r["fragment"]], r["blob"])
        found = Counts(STATES, trained.size)
        found.emit[:, :-1] = total[:-1].reshape(-1, STATES - 1)[: trained.size]
        move, found.start, visits, now = np.split(total[-1].ravel()[: STATES * (STATES + 2) + 1], [STATES * STATES, STATES * (STATES + 1), STATES * (STATES + 2)])
        found.move = move.reshape(STATES, STATES)
        joined = with_plain.join(_by_piece(state, "state", parts), "key", "left")
        trained.improve(found, visits)
        # of the model before this round
        before, likelihood = likelihood, float(now[0]) / max(1, trained.tokens)
        log_.info("round %s: log likelihood a token %.6f", number + 1, likelihood)
        if likelihood - before < least_gain:
            break
    return _scored(joined, spark.sparkContext.broadcast(trained)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
