"""Lazy, rule-based classification: rules that match a test document, class scores, order, prediction, and metrics.

The rule stage is a reconstruction: points of a class are the sum of the confidences of the matching rules, their number
is the number of rules, thresholds are those of rule counting. Undefined values (a class without rules) are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import item_ids, matched_rules, with_ids


def lazy_rules(train: DataFrame, test: DataFrame, sizes: range, min_conf: float = 0.001, min_sup: int = 1, classes: int = 2) -> DataFrame:
    """test_idx, label, n_rules, sum_conf for every test document and class; 0 where no rule matches.

    ``train`` has doc_idx, label and items, ``test`` has test_idx and items; items that training lacks never match. The test
    documents' itemsets are counted in the training documents, which are cut to the test's items first.
    """
    ids = item_ids(test)
    whole = F.lit(0).alias("part")
    known = with_ids(train, ids, ["doc_idx", "label"]).select(whole, "*")
    asking = with_ids(test.select(F.col("test_idx").cast("long").alias("asks"), "items"), ids, ["asks"]).select(whole, "*")
    found = matched_rules(asking, known, sizes, min_conf, min_sup, classes).withColumnRenamed("asks", "test_idx")
    grid = test.select("test_idx", F.explode(F.array(*(F.lit(c) for c in range(classes)))).alias("label"))
    return grid.join(found, ["test_idx", "label"], "left").select("test_idx", "label", F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), F.coalesce("sum_conf", F.lit(0.0)).alias("sum_conf"))


def class_scores(rules: DataFrame, strict_nan: bool = False) -> DataFrame:
    """test_idx, label, score: mean confidence, divided by the sum over the classes if that is defined and positive.

    A class without rules has an undefined score, which leaves the others undivided: null, or NaN with ``strict_nan``.
    """
    own = Window.partitionBy("test_idx")
    mean = F.when(F.col("n_rules") > 0, F.col("sum_conf") / F.col("n_rules"))
    scored = rules.select("test_idx", "label", mean.alias("m")).withColumn("undefined", F.max(F.col("m").isNull()).over(own)).withColumn("total", F.sum("m").over(own))
    score = F.when(~F.col("undefined") & (F.col("total") > 0), F.col("m") / F.col("total")).otherwise(F.col("m"))
    return scored.select("test_idx", "label", (F.coalesce(score, F.lit(float("nan"))) if strict_nan else score).alias("score"))


def ordered_labels(scores: DataFrame) -> DataFrame:
    """test_idx, rank (from 0), label: by score, of ties the lower label.

    An undefined score is never picked: a place that is left over gets the label equal to its number.
    """
    defined = F.filter(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), lambda x: x), lambda x: x["s"].isNotNull())
    rows = scores.groupBy("test_idx").agg(F.count("*").cast("int").alias("classes"), defined.alias("by"))
    return rows.select("test_idx", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda i: F.coalesce(F.get("by", i)["label"], i))).alias("rank", "label"))


def predictions(test: DataFrame, rules: DataFrame, order: DataFrame) -> DataFrame:
    """test_idx, label (the true one), prediction, rules."""
    total = rules.groupBy("test_idx").agg(F.sum("n_rules").alias("rules"))
    top = order.where("rank = 0").select("test_idx", F.col("label").alias("prediction"))
    return test.select("test_idx", "label").join(top, "test_idx").join(total, "test_idx")


def ranking_score(scores: DataFrame) -> DataFrame:
    """test_idx, value: the sum of label times score; null when a score is undefined."""
    value = F.when(F.count("score") == F.count("*"), F.sum(F.col("label") * F.col("score")))
    return scores.groupBy("test_idx").agg(value.alias("value"))


def prediction_entropy(scores: DataFrame) -> DataFrame:
    """test_idx, value: the entropy of the scores in bits; null when a score is undefined or 0."""
    value = F.when(F.count_if(F.col("score") > 0) == F.count("*"), -F.sum(F.when(F.col("score") > 0, F.col("score") * F.log2("score"))))
    return scores.groupBy("test_idx").agg(value.alias("value"))


def prediction_lines(found: DataFrame, ranking: DataFrame, entropy: DataFrame) -> DataFrame:
    """test_idx, line for each prediction; undefined values print as nan."""
    number = lambda c: F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string("%.6f", c))
    rows = found.join(ranking.withColumnRenamed("value", "r"), "test_idx").join(entropy.withColumnRenamed("value", "e"), "test_idx")
    line = F.concat(
        F.format_string("id= %d label= %d prediction= %d ranking= ", F.col("test_idx") + 1, "label", "prediction"), number(F.col("r")), F.lit(" entropy= "), number(F.col("e")), F.format_string(" rules= %d", "rules")
    )
    return rows.select("test_idx", line.alias("line"))


def eval_counts(found: DataFrame, classes: int = 2) -> DataFrame:
    """label, predicted, correct, truth for every class, over documents with a known label."""
    known = found.where("label >= 0")
    both = known.select(F.explode(F.array(F.struct(F.col("prediction").alias("c"), F.lit(1).alias("p"), (F.col("prediction") == F.col("label")).cast("int").alias("k"), F.lit(0).alias("t")), F.struct(F.col("label").alias("c"), F.lit(0).alias("p"), F.lit(0).alias("k"), F.lit(1).alias("t")))).alias("x"))
    sums = both.groupBy(F.col("x.c").alias("label")).agg(F.sum("x.p").alias("predicted"), F.sum("x.k").alias("correct"), F.sum("x.t").alias("truth"))
    grid = found.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return grid.join(sums, "label", "left").na.fill(0, ["predicted", "correct", "truth"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def eval_per_class(counts: DataFrame) -> DataFrame:
    """label, p, r, f1; null where undefined."""
    both = counts.select("label", _ratio(F.col("correct"), F.col("predicted")).alias("p"), _ratio(F.col("correct"), F.col("truth")).alias("r"))
    return both.withColumn("f1", _f1(F.col("p"), F.col("r")))


def eval_summary(counts: DataFrame) -> DataFrame:
    """acc, and macro_f1 over the classes whose F1 is defined."""
    return counts.join(eval_per_class(counts), "label").agg(_ratio(F.sum("correct"), F.sum("truth")).alias("acc"), F.avg("f1").alias("macro_f1"))


def eval_running(found: DataFrame, classes: int = 2) -> DataFrame:
    """seq (from 1), acc, macro_f1 after each prediction, in the order of test_idx.

    Running sums need an order over all rows; they are made in ranges of test_idx, with the sums of earlier ranges added.
    """
    known = found.where("label >= 0")
    span = 1 << 16
    flags = []
    for c in range(classes):
        flags += [(F.col("prediction") == c).cast("int").alias(f"p{c}"), ((F.col("prediction") == c) & (F.col("label") == c)).cast("int").alias(f"k{c}"), (F.col("label") == c).cast("int").alias(f"t{c}")]
    names = [f"{x}{c}" for c in range(classes) for x in "pkt"]
    rows = known.select("test_idx", F.floor(F.col("test_idx") / span).alias("_range"), F.lit(1).alias("one"), *flags)
    names = ["one", *names]
    totals = rows.groupBy("_range").agg(*(F.sum(x).alias(x) for x in names))
    over = Window.partitionBy(F.lit(0)).orderBy("_range")
    before = totals.select("_range", *((F.sum(x).over(over) - F.col(x)).alias(f"b_{x}") for x in names))
    own = Window.partitionBy("_range").orderBy("test_idx").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("_range", *(F.sum(x).over(own).alias(x) for x in names)).join(before, "_range").select(*((F.col(x) + F.col(f"b_{x}")).alias(x) for x in names))
    f1 = [_f1(_ratio(F.col(f"k{c}"), F.col(f"p{c}")), _ratio(F.col(f"k{c}"), F.col(f"t{c}"))) for c in range(classes)]
    defined = sum((x.isNotNull().cast("int") for x in f1[1:]), f1[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in f1[1:]), F.coalesce(f1[0], F.lit(0.0)))
    return run.select(F.col("one").alias("seq"), (sum((F.col(f"k{c}") for c in range(1, classes)), F.col("k0")) / F.col("one")).alias("acc"), F.when(defined > 0, total / defined).alias("macro_f1"))
