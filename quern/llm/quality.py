"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Base counts come first (see ``base_counts``); a row that fails them is not kept. Every other row is kept when the
calibrated probability of good quality reaches ``KEEP_AT``, and its band is the number of ``THRESHOLDS`` that it reaches. The regression is fitted on a bounded sample of labelled
rows (``most_rows``); scoring covers every row, in Arrow batches, over whole texts.

Features: words, pairs of adjacent words and windows of four code points of the lower-cased text, each family hashed
to ``BUCKETS`` buckets and scaled to relative frequencies, so long and short texts are alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACE, mapped, pieces, table, utf8

BUCKETS = 1 << 15
FAMILIES = ("word", "pair", "char")
#: Labelled rows that the regression is fitted on, at most: those with the smallest hash of their id.
MOST_ROWS = 3_000
KEEP_AT = 0.35
THRESHOLDS = (KEEP_AT, 0.65, 0.9)
MIN_WORDS = 10
#: Words in repeated windows, percent of all words, that a kept text may have.
MOST_REPEATED = 20
WINDOW = 5
_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>"
#: Bytes of a text from which on it is read in blocks of that size, which bounds memory.
BLOCK = 1 << 20


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks that end with white space; a word is never cut."""
    start = 0
    while len(text) - start > BLOCK:
        found = _GAP.search(text, start + BLOCK)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def _repeats_by_rank(parts: Iterable[list[bytes]]) -> tuple[int, int]:
    """(words, ``repeated_words``) of very long texts: windows are named by exact ranks in arrays instead of tuples."""
    ids: dict[bytes, int] = {}
    one = np.concatenate([np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in parts])
    if len(one) <= WINDOW:
        return len(one), 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], one[4:])
    again = np.flatnonzero(np.bincount(five)[five] > 1)
    marks = np.zeros(len(one) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + WINDOW, -1)
    return len(one), int((np.cumsum(marks)[:-1] > 0).sum())


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    end = n = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if len(text) > BLOCK:
        n, again = _repeats_by_rank(map(bytes.split, blocks(text)))
    else:
        n, again = len(words := text.split()), repeated_words(words)
    chars = len(text.translate(None, SPACE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return n, chars, symbols, len(lines) - len(set(lines)), again


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def hashed(text: bytes, word: np.ndarray, points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The bucket of every n-gram of the text, one array for each family (empty where the text is too short), and what the
    next block of the text goes on from. ``word`` and ``points`` come from the block before."""
    text = text.lower()
    own = np.fromiter(map(crc32, text.split()), np.uint32, -1)
    word = np.append(word, own)
    pair = word[:-1] * np.uint32(0x9E3779B1) ^ word[1:]
    points = np.append(points, np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
    char = np.zeros(max(0, len(points) - 3), np.uint32)
    for k in range(4 if len(char) else 0):
        char = char * np.uint32(0x01000193) ^ points[k : len(points) - 3 + k]
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    return [(x * np.uint32(0x85EBCA6B)) >> shift for x in (own, pair, char)], word[-1:], points[-3:]


def _hashed_blocks(text: bytes) -> Iterator[list[np.ndarray]]:
    word = points = np.zeros(0, np.uint32)
    for block in blocks(text):
        found, word, points = hashed(block, word, points)
        yield found


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): relative frequencies of the buckets, families one after the other."""
    counts = np.zeros((len(FAMILIES), BUCKETS))
    for found in _hashed_blocks(text):
        for k, h in enumerate(found):
            counts[k] += np.bincount(h, minlength=BUCKETS)
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    index = np.flatnonzero(counts)
    return index, counts.ravel()[index]


class Model:
    """Weights for each family and the calibration of the margin (Platt: probability = 1 / (1 + exp(-(a * margin + b))))."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margin(self, text: bytes) -> float:
        sums, n = [0.0] * len(FAMILIES), [0] * len(FAMILIES)
        for found in _hashed_blocks(text):
            for k, h in enumerate(found):
                sums[k] += float(self.weights[k * BUCKETS + h].sum(dtype=np.float64))
                n[k] += len(h)
        return self.bias + sum(s / m for s, m in zip(sums, n) if m)

    def probability(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a * self.margin(text) + self.b))))


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, ridge: float = 1e-5) -> Model:
    """L2-regularised logistic regression by Adam over all rows; every fourth row only calibrates.

    With rows of one class only (or none) every text gets the smoothed share of that class.
    """
    size = len(FAMILIES) * BUCKETS
    labels = np.array([y for *_, y in rows], float)
    if len(rows) < 8 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(size), 0.0, 1.0, math.log(share / (1 - share)))
    last = np.arange(len(rows)) % 4 == 3
    train = [r for r, c in zip(rows, last) if not c]
    y = labels[~last]
    index = np.concatenate([r[0] for r in train])
    value = np.concatenate([r[1] for r in train])
    row = np.repeat(np.arange(len(train)), [len(r[0]) for r in train])
    # both classes weigh the same
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, m, v, bias, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = np.bincount(row, value * w[index], len(train)) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        g = np.bincount(index, value * r[row], size) + ridge * w
        gb = r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 2.0 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v) + 1e-8)
        bias -= 0.1 * rate * mb / (math.sqrt(vb) + 1e-8)
    model = Model(w, bias, 1.0, 0.0)
    held = [r for r, c in zip(rows, last) if c]
    if labels[last].min() == labels[last].max():
        return model
    margins = np.array([float((model.weights[i] * x).sum()) + bias for i, x, _ in held])
    return Model(w, bias, *_platt(margins, labels[last]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled rows. Null ids and labels are left out; of rows that repeat an id one counts."""
    sample = (
        labels.select(F.col(id_col).alias("q_id"), F.col(label_col).cast("int").alias("q_label"))
        .where("q_id is not null and q_label in (0, 1)")
        .orderBy(F.xxhash64("q_id"), "q_id", "q_label")
        .limit(most_rows)
        .groupBy("q_id")
        .agg(F.max("q_label").alias("q_label"))
    )
    texts = docs.select(F.col(id_col).alias("q_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "q_id")

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                found = [_features(t) for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("q_id").cast(pa.int64()), part.column("q_label").cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["q_id", "q_label", "i", "v"])

        return step

    rows: dict[int, tuple] = {}
    for r in mapped(texts, make, "q_id long, q_label int, i binary, v binary").toLocalIterator():
        got = (np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4"), r["q_label"])
        if r["q_id"] not in rows or len(got[0]) > len(rows[r["q_id"]][0]):
            rows[r["q_id"]] = got
    return fit([rows[k] for k in sorted(rows, key=lambda k: (k * 0x9E3779B97F4A7C15) % (1 << 64))])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept, probability, band.

    A null text has no words and fails. Ids may be null or repeat; other columns are ignored.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                rows = []
                for text in utf8(part.column("text")):
                    counts = base_counts(text)
                    bad = failed(counts[0], counts[-1])
                    p = model.probability(text)
                    rows.append((*counts, bad, not bad and p >= keep_at, p, sum(p >= x for x in THRESHOLDS)))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability", "band"])

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double, band int")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
