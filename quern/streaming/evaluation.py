"""The evaluator over a stream of predictions: counts that grow with every micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_counts(found: DataFrame) -> DataFrame:
    """label, prediction, n over a stream of (label, prediction); write it in complete or update mode.

    The state has one row for each pair of classes, so it needs no watermark.
    """
    return found.where("label >= 0").groupBy("label", "prediction").agg(F.count("*").alias("n"))


def eval_counts(pairs: DataFrame, classes: int = 2) -> DataFrame:
    """label, predicted, correct, truth from the state (label, prediction, n)."""
    grid = pairs.sparkSession.range(classes).select(F.col("id").cast("int").alias("c"))
    rows = grid.join(F.broadcast(pairs), (F.col("label") == F.col("c")) | (F.col("prediction") == F.col("c")), "left")
    amount = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    return rows.groupBy(F.col("c").alias("label")).agg(amount(F.col("prediction") == F.col("c")).alias("predicted"), amount((F.col("prediction") == F.col("c")) & (F.col("label") == F.col("c"))).alias("correct"), amount(F.col("label") == F.col("c")).alias("truth"))


def running_metrics(found: DataFrame, classes: int = 2) -> DataFrame:
    """evaluator, seq (from 1), acc, macro_f1 after every prediction of a stream (evaluator, test_idx, label, prediction).

    The state of an evaluator are its counts so far: one for all predictions and three for each class. A micro-batch holds
    later documents than those before; within one they are put in order, so it bounds what is sorted at once. Documents
    without a known label do not count. Metrics that are undefined are null. Write it in append mode; with a checkpoint
    location a stopped stream goes on with its counts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = np.array(state.get[0] if state.exists else [0] * (1 + 3 * classes), np.int64)
        rows = pd.concat(list(frames)).sort_values("test_idx")
        rows = rows[rows["label"] >= 0]
        if not len(rows):
            return
        label, prediction = rows["label"].to_numpy()[:, None], rows["prediction"].to_numpy()[:, None]
        own = np.arange(classes)
        flags = np.hstack([np.ones((len(rows), 1), bool), prediction == own, (prediction == own) & (label == own), label == own])
        run = before + np.cumsum(flags, 0)
        state.update((run[-1].tolist(),))
        predicted, correct, truth = (run[:, 1 + k * classes : 1 + (k + 1) * classes].astype(float) for k in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            p, r = correct / predicted, correct / truth
            f1 = 2 * p * r / (p + r)
            macro = np.nansum(f1, 1) / np.isfinite(f1).sum(1)
        yield pd.DataFrame({"evaluator": key[0], "seq": run[:, 0], "acc": correct.sum(1) / run[:, 0], "macro_f1": pd.Series(macro).where(np.isfinite(macro), None)})

    return found.groupBy("evaluator").applyInPandasWithState(step, "evaluator int, seq long, acc double, macro_f1 double", "counts array<long>", "append", "NoTimeout")
