"""Statements of the dialect as immutable values."""

from __future__ import annotations

from dataclasses import dataclass

from keystrata.functions.values import Value


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    not_null: bool = False
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]
    primary_key: str | None


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]  # none: all, in declaration order
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Condition:
    """``link`` joins it to all that stands before it: AND, OR, or nothing for the first."""

    column: str
    op: str
    value: Value
    link: str | None = None


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None  # None: *
    where: tuple[Condition, ...] = ()
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Value], ...]
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class ShowTables:
    pass


@dataclass(frozen=True)
class Describe:
    table: str


Statement = CreateTable | DropTable | Insert | Select | Update | Delete | ShowTables | Describe
