"""Language identification by nearest centroid.

A text is a vector of hashed n-grams of one, two and three code points of its lower-cased letters (words set off by
spaces), weighted by TF-IDF (damped counts times the inverse document frequency over all training texts) and scaled
to length one. Every language has several centroids, found by spherical k-means on a bounded sample of its texts; the
nearest centroid by cosine names the language. A text much farther from its centroid than usual texts of the language is
rejected (column ``rejected``; see ``REJECT_QUANTILE``); texts without a letter are ``und`` and rejected too.

Every learned language has centroids, 128 KB of them: the model grows with the number of languages, not of texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, mapped, pieces, saved, small, table

BUCKETS = 1 << 13
CENTROIDS = 4
#: Labelled texts of each language that its centroids are clustered on, at most.
MOST_PER_LANGUAGE = 512
#: A text is rejected when its cosine is under this share of this quantile of the cosines of the sample of its language.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.7
UNKNOWN = "und"

_NOT_ASCII_LETTERS = re.compile(r"[^a-z]+")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def words_of(text: str | None) -> str:
    """Lower-cased letters and their marks; everything between words becomes one space. Empty if the text has no letter."""
    text = (text or "").lower()
    out = (_NOT_ASCII_LETTERS if text.isascii() else _NOT_LETTERS).sub(" ", text)
    return out if any(map(str.isalpha, out)) else ""


def hashed(words: str) -> np.ndarray:
    """The bucket of each n-gram (n = 1, 2, 3) that does not begin with the space between words."""
    x = np.frombuffer(f" {words.strip()} ".encode("utf-32-le"), np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = (a * np.uint32(0x9E3779B1)) ^ (b + np.uint32(1))
    three = (two * np.uint32(0x85EBCA6B)) ^ (c + np.uint32(2))
    found = np.concatenate([b * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    return found >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def counts(words: str) -> np.ndarray:
    return np.bincount(hashed(words), minlength=BUCKETS)


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf
    return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def clustered(x: np.ndarray, k: int = CENTROIDS, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest the mean, then from those farthest from all before. Rows are unit vectors."""
    centre = x.mean(0)
    picks = [int(np.argmax(x @ centre))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


class Model:
    """Inverse document frequencies, centroids with the language of each, and the least cosine of each language."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], least: dict[str, float]):
        self.idf, self.centroids, self.langs, self.least = idf.astype(np.float32), np.ascontiguousarray(centroids.T.astype(np.float32)), langs, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0, True
        near = weighted(counts(words), self.idf) @ self.centroids
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return self.langs[best], score, score < self.least[self.langs[best]]


def _fitted(idf: np.ndarray, share: float):
    """The centroids of one language, from the sample of its texts: lang, number, centroid, least cosine that is not rejected."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(frame), BUCKETS), np.float32)
        for row, (i, n) in zip(x, sorted(zip(frame["i"], frame["n"]))):
            at = np.frombuffer(i, "<u2")
            row[at] = np.frombuffer(n, "<u4")
            row[:] = weighted(row, idf)
        c = clustered(x)
        least = share * float(np.quantile((x @ c.T).max(1), REJECT_QUANTILE))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "number": range(len(c)), "centroid": [v.astype("<f4").tobytes() for v in c], "least": least})

    return run


def train(docs: DataFrame, among: Column | None = None, text_col: str = "text", lang_col: str = "lang", reject_share: float = REJECT_SHARE) -> Model:
    """Learn from the rows of ``docs`` where ``among`` holds and the language is not null; from text and language only.

    Document frequencies cover all of these rows. The centroids of a language come from at most ``MOST_PER_LANGUAGE`` of its
    different texts (one for each remainder of the hash of the text). Texts without a letter teach nothing; without any
    other text the model predicts ``und``.
    """
    rows = (docs if among is None else docs.where(among)).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    def run(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for text in part.column("text").to_pylist():
                    if words := words_of(text):
                        total[np.unique(hashed(words))] += 1
                        total[BUCKETS] += 1
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i], pa.int64())], names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for r in rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    named = rows.withColumn("h", F.xxhash64("text"))
    picked = saved(named.groupBy("lang", F.pmod("h", F.lit(MOST_PER_LANGUAGE)).alias("part")).agg(F.min("h").alias("h")).drop("part"))
    texts = named.join(small(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def vectors():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                found = [counts(words) if (words := words_of(t)) else None for t in part.column("text").to_pylist()]
                own = part.filter(pa.array([n is not None for n in found], pa.bool_())).column("lang")
                pairs = [(np.flatnonzero(n), n) for n in found if n is not None]
                yield pa.RecordBatch.from_arrays([own, pa.array([i.astype("<u2").tobytes() for i, _ in pairs], pa.binary()), pa.array([n[i].astype("<u4").tobytes() for i, n in pairs], pa.binary())], names=["lang", "i", "n"])

        return step

    fitted = mapped(texts.select("lang", "text"), vectors, "lang string, i binary, n binary").groupBy("lang").applyInPandas(_fitted(idf, reject_share), "lang string, number int, centroid binary, least double")
    found = sorted(fitted.toLocalIterator(), key=lambda r: (r["lang"], r["number"]))
    centroids = np.stack([np.frombuffer(r["centroid"], "<f4") for r in found]) if found else np.zeros((0, BUCKETS), np.float32)
    return Model(idf, centroids, [r["lang"] for r in found], {r["lang"]: r["least"] for r in found})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine), rejected.

    A null text, an empty text and one without letters is ``und`` with score 0. Of languages whose centroids are equally near
    the first by name is predicted. Ids may be null or repeat; a text of any length is one vector; other columns are
    ignored; an empty table gives an empty result.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, "text"):
                lang, score, out = zip(*(model.predict(t) for t in part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

        return step

    own = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return mapped(own, make, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns (of any names), that the model does not reject.

    Null and empty texts and those without a letter go. Repeated rows are judged alike; an empty table stays empty.
    """

    def make():
        def step(batch: pa.RecordBatch):
            for part in pieces(batch, text_col):
                yield part.filter(pa.array([not model.predict(t)[2] for t in part.column(text_col).to_pylist()], pa.bool_()))

        return step

    return mapped(docs, make, docs.schema)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
