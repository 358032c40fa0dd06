"""Itemset supports and rule counts.

A rule is an (itemset, class) pair, itemsets of one to three items. Its support is the number of chosen documents with
the itemset, its confidence the share of them in the class. A document chosen twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import subset_rows

#: Antecedent sizes for a largest rule size (with the class) from 2 to 4; larger values act as 4, smaller ones as 2.
def antecedents(max_rule_size: int) -> range:
    return range(1, min(max(max_rule_size, 2), 4))


def reaches(count: Column, total: Column, min_conf: float) -> Column:
    """count / total >= min_conf in single precision; never for total 0."""
    ratio = (count.cast("double") / F.when(total > 0, total).cast("double")).cast("float")
    return F.coalesce(ratio >= F.lit(min_conf).cast("float"), F.lit(False))


def valid_rules(size: Column, n: Column, by_class: list[Column], min_conf: float, min_sup: int) -> Column:
    """How many classes form a rule with an itemset. Single items need no support."""
    passing = sum((reaches(c, n, min_conf).cast("int") for c in by_class[1:]), reaches(by_class[0], n, min_conf).cast("int"))
    return F.when((n > 0) & ((size == 1) | (n >= min_sup)), passing).otherwise(0)


def named(found: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """part, a, b, c (as many as ``size``), n, n_c0, n_c1, ...: the itemsets of ``size`` items of a support table by their names."""
    rows = found.where(F.col("size") == size)
    for k in range(size):
        rows = rows.join(ids.select(F.col("id").alias(f"s{k + 1}"), F.col("item").alias("abc"[k])), f"s{k + 1}")
    return rows.select("part", *"abc"[:size], "n", *(c for c in found.columns if c.startswith("n_c")))


def rules_size2(found: DataFrame, ids: DataFrame, classes: int = 2) -> DataFrame:
    """part, item, label, n, n_c, conf for single items."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"n_c{c}").alias("n_c")) for c in range(classes))))
    one = named(found, ids, 1).select("part", F.col("a").alias("item"), "n", each.alias("x"))
    return one.select("part", "item", "x.label", "n", "x.n_c", F.round(F.col("x.n_c") / F.col("n"), 6).alias("conf"))


def rule_counts(every: DataFrame, candidates: DataFrame, found: DataFrame, sizes: range, min_conf: float, min_sup: int, classes: int = 2) -> DataFrame:
    """part, doc_idx, rules for every document of ``every`` (part, doc_idx); 0 where nothing matches.

    ``candidates`` has part, doc_idx and ids, ``found`` is a support table. Subsets and rules meet as rows of numbers; a
    candidate's item without a rule of its own makes no subsets, which is the projection on the current items.
    """
    rules = found.where(F.col("size").isin(*sizes)).select("part", "s1", "s2", "s3", valid_rules(F.col("size"), F.col("n"), [F.col(f"n_c{c}") for c in range(classes)], min_conf, min_sup).alias("k")).where("k > 0")
    # sizes after a Python step are guessed: neither side may be broadcast
    matched = subset_rows(candidates.select("part", "doc_idx", "ids"), sizes).join(rules.hint("merge"), ["part", "s1", "s2", "s3"]).groupBy("part", "doc_idx").agg(F.sum("k").alias("rules"))
    return every.select("part", "doc_idx").join(matched, ["part", "doc_idx"], "left").select("part", "doc_idx", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"))


def summed_rules(every: DataFrame, matched: DataFrame) -> DataFrame:
    """part, doc_idx, rules for every document of ``every`` (part, doc_idx): the rules of all classes that it matches (part,
    doc_idx, n_rules); 0 where nothing matches."""
    sums = matched.groupBy("part", "doc_idx").agg(F.sum("n_rules").alias("rules"))
    return every.select("part", "doc_idx").join(sums, ["part", "doc_idx"], "left").select("part", "doc_idx", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"))


def least_representative(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """part, doc_idx, rules, df_sum: fewest rules, then the smaller sum, then the greater document."""
    both = counts.join(sums, ["part", "doc_idx"])
    return both.groupBy("part").agg(F.min_by(F.struct("doc_idx", "rules", "df_sum"), F.struct(F.col("rules"), F.col("df_sum"), -F.col("doc_idx"))).alias("x")).select("part", "x.doc_idx", "x.rules", "x.df_sum")
