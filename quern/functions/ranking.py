"""Dense numbers and n-tiles without a single-task window.

A window without partitions sorts the whole table in one task. Here the rows are dealt out by ranges of the whole order,
sorted there, and saved; a row's number is its place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import saved

#: Bits of a place in a range; the others are the number of the range.
_PLACE = 33


def row_numbers(df: DataFrame, out: str, order: list[str], by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with the size of its group, ``out_size``, and the 0-based row number ``out``, by ``order`` within ``by``.

    The order must be total for a unique result; nulls come first. There are as many ranges as ``spark.sql.shuffle.partitions``
    says. Other columns may have any names. Rows are saved once, with the columns of ``df``.
    """
    by = by or []
    mark = "_" * (1 + max(map(len, df.columns)))  # no column begins so
    place, cut, n, first, before = (mark + x for x in ("place", "range", "n", "first", "before"))
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *by, *order).sortWithinPartitions(*by, *order)
    rows = saved(dealt.withColumn(place, F.monotonically_increasing_id())).withColumn(cut, F.shiftright(place, _PLACE))
    sizes = rows.groupBy(*by, cut).agg(F.count("*").alias(n), F.min(place).alias(first))
    # one row for each group and range that it has rows in
    within = Window.partitionBy(*by or [F.lit(0)])
    offsets = sizes.select(*by, cut, first, (F.sum(n).over(within.orderBy(cut)) - F.col(n)).alias(before), F.sum(n).over(within).alias(f"{out}_size"))
    met = rows.join(offsets if by else F.broadcast(offsets), [*by, cut])
    return met.select(*df.columns, f"{out}_size", (F.col(before) + F.col(place) - F.col(first)).alias(out))


def ntile(number: Column, size: Column, n: int) -> Column:
    """The 0-based n-tile of a 0-based row number: the first ``size % n`` tiles have one row more."""
    q, r = F.floor(size / n), size % n
    return F.when(number < r * (q + 1), F.floor(number / (q + 1))).otherwise(r + F.floor((number - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")
