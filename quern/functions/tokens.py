"""Tokens of a transaction line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(line: Column) -> Column:
    """Runs of space, tab and newline separate tokens; a carriage return is part of its token."""
    return F.filter(F.split(line, "[ \t\n]+"), lambda t: t != "")


def leading_int(token: Column) -> Column:
    """The integer that a token begins with; 0 if there is none or it does not fit 32 bits."""
    return F.coalesce(F.regexp_extract(token, "^[+-]?[0-9]+", 0).try_cast("int"), F.lit(0))


def is_class(token: Column, classes: int = 2) -> Column:
    return token.isin([f"CLASS={k}" for k in range(classes)])


def class_label(found: Column, last: bool = True, classes: int = 2) -> Column:
    """The class of a line: of several class tokens the last (training) or the first (test) counts; -1 without one."""
    own = F.filter(found, lambda t: is_class(t, classes))
    one = F.element_at(own, -1) if last else F.get(own, F.lit(0))
    return F.when(F.size(own) > 0, F.substring(one, 7, 9).cast("int")).otherwise(F.lit(-1))


def items(found: Column, classes: int = 2) -> Column:
    """The distinct items after the id, in order of first appearance, without class tokens."""
    return F.array_distinct(F.filter(F.slice(found, 2, 1 << 30), lambda t: ~is_class(t, classes)))
