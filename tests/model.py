"""A row-at-a-time model of the dialect's comparison rules, for comparison with the plans."""

import math

from keystrata.functions.values import BOOL, comparand


def matches(row, where, kinds):
    out = True
    for i, c in enumerate(where):
        if c.column not in kinds:
            one = False
        else:
            kind, cell = kinds[c.column], row[c.column]
            if cell is None or c.value.value is None:
                one = c.op == "!="
            else:
                x, y = cell, comparand(c.value, kind)
                equal = x == y
                less, more = (False, False) if kind == BOOL else (_bytes(x) < _bytes(y), _bytes(x) > _bytes(y))
                one = {"=": equal, "!=": not equal, "<": less, ">": more, "<=": equal or less, ">=": equal or more}[c.op]
        out = one if not i else out or one if c.link == "OR" else out and one
    return out


def _bytes(x):
    return x.encode() if isinstance(x, str) else x


def same(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))
