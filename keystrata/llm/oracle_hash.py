"""XXH64 as a DuckDB expression: unsigned 64-bit arithmetic by way of 128-bit integers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

#: The five multipliers of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261

_ALL, _fresh = 1 << 64, count()


def _u(x: int | str) -> str:
    return f"{x}::UBIGINT" if isinstance(x, int) else x


def _mul(a, b) -> str:
    return f"(({_u(a)})::UHUGEINT * ({_u(b)})::UHUGEINT % {_ALL}::UHUGEINT)::UBIGINT"


def _add(*xs) -> str:
    return "((" + " + ".join(f"({_u(x)})::UHUGEINT" for x in xs) + f") % {_ALL}::UHUGEINT)::UBIGINT"


def _xor(a, b) -> str:
    return f"xor({_u(a)}, {_u(b)})"


def _let(value: str, use: Callable[[str], str]) -> str:
    """``use`` of a value that is computed once."""
    name = f"y{next(_fresh)}"
    return f"list_transform([{value}], lambda {name}: {use(name)})[1]"


def _turn(x: str, bits: int) -> str:
    return _let(x, lambda y: f"({_mul(y, 1 << bits)} | ({y} >> {64 - bits}))")


def _round(acc: str, lane: str) -> str:
    return _mul(_turn(_add(acc, _mul(lane, P2)), 31), P1)


def _number(x: str, at: str, size: int) -> str:
    """``size`` bytes of the hexadecimal text ``x`` from byte ``at`` on, lowest first."""
    digits = " || ".join(f"substr({x}, 2 * ({at}) + {2 * (size - 1 - i) + 1}, 2)" for i in range(size))
    return f"('0x' || {digits})::UBIGINT"


def _fold(start: str, steps: str, lane: str, step: Callable[[str, str], str]) -> str:
    return f"list_reduce(list_prepend({start}, list_transform(range(0, {steps}), lambda k: {lane})), lambda a, l: {step('a', 'l')})"


def xxh64(x: str, n: str, seed: int = 42) -> str:
    """The hash of the ``n`` bytes that column ``x`` holds in hexadecimal, a UBIGINT."""
    starts = ((seed + P1 + P2) % _ALL, (seed + P2) % _ALL, seed, (seed - P1) % _ALL)
    lane = [_fold(_u(v), f"{n} // 32", _number(x, f"32 * k + {8 * i}", 8), _round) for i, v in enumerate(starts)]

    def merged(*v: str) -> str:
        acc = _add(*(_turn(y, bits) for y, bits in zip(v, (1, 7, 12, 18), strict=True)))
        for y in v:
            acc = _add(_mul(_xor(acc, _round("0::UBIGINT", y)), P1), P4)
        return acc

    stripes = _let(lane[0], lambda a: _let(lane[1], lambda b: _let(lane[2], lambda c: _let(lane[3], lambda d: merged(a, b, c, d)))))
    acc = _add(f"CASE WHEN {n} >= 32 THEN {stripes} ELSE {_u((seed + P5) % _ALL)} END", f"{n}::UBIGINT")
    acc = _fold(acc, f"{n} % 32 // 8", _number(x, f"{n} // 32 * 32 + 8 * k", 8), lambda a, y: _add(_mul(_turn(_xor(a, _round("0::UBIGINT", y)), 27), P1), P4))
    acc = _fold(acc, f"{n} % 8 // 4", _number(x, f"{n} // 8 * 8", 4), lambda a, y: _add(_mul(_turn(_xor(a, _mul(y, P1)), 23), P2), P3))
    acc = _fold(acc, f"{n} % 4", _number(x, f"{n} // 4 * 4 + k", 1), lambda a, y: _mul(_turn(_xor(a, _mul(y, P5)), 11), P1))
    for shift, by in ((33, P2), (29, P3), (32, None)):
        acc = _let(acc, lambda y, shift=shift: _xor(y, f"{y} >> {shift}"))
        acc = acc if by is None else _mul(acc, by)
    return acc
