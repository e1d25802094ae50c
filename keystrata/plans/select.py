"""SELECT statements as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.plans import messages as M
from keystrata.plans.predicates import fold
from keystrata.plans.statements import Select

#: The hidden column that holds a row's key text.
KEY = "_key"


class PlanError(ValueError):
    pass


def plan_select(s: Select, table: DataFrame, kinds: dict[str, str | None], ordered: bool = True) -> DataFrame:
    """Filter, order, limit and project ``table``, which has the columns of ``kinds`` and KEY.

    Rows without ORDER BY come in key order if ``ordered`` or under a LIMIT; with it, ties go by key, NULLs
    first when ascending and last when descending.
    """
    names = list(kinds) if s.columns is None else list(s.columns)
    for name in names:
        if name not in kinds:
            raise PlanError(M.NO_COLUMN.format(name))
    if s.order_by is not None and s.order_by not in names:
        raise PlanError(M.UNSORTABLE.format(s.order_by))
    df = table.where(fold(s.where, kinds)) if s.where else table
    key = [F.col(KEY)] if KEY in table.columns else []
    if s.order_by is not None:
        column = F.col(f"`{s.order_by}`")
        df = df.orderBy(column.desc() if s.descending else column.asc(), *key)
    elif key and (ordered or s.limit is not None):
        df = df.orderBy(*key)
    if s.limit is not None:
        df = df.limit(s.limit)
    return df.select(*[F.col(f"`{n}`") for n in names])
