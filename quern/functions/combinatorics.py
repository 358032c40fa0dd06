"""Combinations, binomial coefficients and primes as DataFrames and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def binomial(n: Column, k: Column) -> Column:
    """n over k as a long; 0 when k > n."""
    steps = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), F.lit(1).cast("long"), lambda r, d: F.floor(r * (n.cast("long") - d + 1) / d).cast("long"))
    return F.when(k > n, F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(steps)


def subsets(items: Column, size: int) -> Column:
    """All subsets of ``size`` (1 to 3) members of a sorted array, as arrays in lexicographic order of position."""
    rest = lambda i: F.slice(items, i + 2, F.size(items))  # noqa: E731  members after position i
    if size == 1:
        return F.transform(items, lambda a: F.array(a))
    if size == 2:
        return F.flatten(F.transform(items, lambda a, i: F.transform(rest(i), lambda b: F.array(a, b))))
    return F.flatten(F.flatten(F.transform(items, lambda a, i: F.transform(rest(i), lambda b, j: F.transform(F.slice(items, i + j + 3, F.size(items)), lambda c: F.array(a, b, c))))))


def combinations(spark: SparkSession, n: int, k: int) -> DataFrame:
    """r, and the members of the r-th k-combination of 0..n-1 (k = 2 or 3) in lexicographic order, r from 0.

    The number is computed from the members (combinatorial number system), so no rows meet in a sort.
    """
    if k not in (2, 3):
        raise ValueError("k must be 2 or 3")
    first = spark.range(n).select(F.col("id").cast("int").alias("i"))
    after = lambda c: F.explode(F.when(c + 1 < n, F.sequence(c + 1, F.lit(n - 1))).otherwise(F.array().cast("array<int>")))
    out = first.select("i", after(F.col("i")).alias("j"))
    choose2 = lambda m: m * (m - 1) / 2
    choose3 = lambda m: m * (m - 1) * (m - 2) / 6
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    if k == 2:
        return out.select((choose2(F.lit(n)) - choose2(n - i) + j - i - 1).cast("long").alias("r"), "i", "j")
    out = out.select("i", "j", after(F.col("j")).alias("k"))
    return out.select((choose3(F.lit(n)) - choose3(n - i) + choose2(n - i - 1) - choose2(n - j) + F.col("k") - j - 1).cast("long").alias("r"), "i", "j", "k")


def primes(spark: SparkSession, below: int) -> DataFrame:
    """p: all primes under ``below``: numbers without a divisor up to their root, the divisors being the small primes."""
    root = int(below**0.5) + 1
    small = [p for p in range(2, root + 1) if all(p % d for d in range(2, int(p**0.5) + 1))]
    n = F.col("id")
    composite = F.exists(F.array(*(F.lit(p).cast("long") for p in small)), lambda p: (p < n) & (n % p == 0)) if small else F.lit(False)
    return spark.range(2, max(2, below)).where(~composite).select(n.cast("int").alias("p"))

