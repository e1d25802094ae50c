"""WHERE chains as column expressions.

Comparisons are two-valued: a NULL cell equals nothing and so differs from everything. AND and OR have equal
precedence and group to the left. An unknown column's condition is false. Plain comparisons are built
wherever NULL and FALSE drop a row alike, since only those reach the Parquet scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.values import BOOL, FLOAT, comparand
from keystrata.plans.statements import Condition


class UnsupportedColumn(ValueError):
    pass


def condition(c: Condition, kinds: dict[str, str | None]) -> Column:
    """``kinds``: the table's columns; None marks a type outside the dialect."""
    no, yes = F.lit(False), F.lit(True)
    if c.column not in kinds:
        return no
    kind = kinds[c.column]
    if kind is None:
        raise UnsupportedColumn(f"column '{c.column}' has a type that can't be compared")
    if c.value.value is None:
        return yes if c.op == "!=" else no
    cell, value = F.col(f"`{c.column}`"), comparand(c.value, kind)
    if kind == FLOAT and math.isnan(value):
        return yes if c.op == "!=" else no
    other = F.lit(value)
    if c.op == "!=":
        return cell.isNull() | (cell != other)
    if kind == BOOL:  # booleans have no order: <= and >= say equal
        return no if c.op in "<>" else cell == other
    built = {"=": cell == other, "<": cell < other, ">": cell > other, "<=": cell <= other, ">=": cell >= other}[c.op]
    return built & ~F.isnan(cell) if kind == FLOAT and c.op in (">", ">=") else built


def fold(where: tuple[Condition, ...], kinds: dict[str, str | None]) -> Column:
    """The chain from left to right; no condition is true."""
    out = F.lit(True)
    for i, c in enumerate(where):
        one = condition(c, kinds)
        out = one if not i else out | one if c.link == "OR" else out & one
    return out



