"""Predicates over integer and link properties, folded to filters that Parquet can push down.

A link is compared by its raw value, target + 1 with 0 for null, so `== 0` finds null links and `< k` includes them. The filters below
say the same of the nullable column itself, without arithmetic on it, so they stay pushable.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedPredicate
from ..schema import Kind, ObjectType, Prop


class Op(str, Enum):
    EQ = "=="
    NE = "!="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="


@dataclass(frozen=True)
class Predicate:
    prop: int | str
    op: Op
    value: int


def largest(prop: Prop) -> int:
    return 2**64 - 1 if prop.wide else 2**63 - 1


def bounds(op: Op, value: int, most: int) -> tuple[int, int] | None:
    """The inclusive range within 0 to most that op and value allow; None if empty. Not for NE."""
    lo, hi = {Op.EQ: (value, value), Op.LT: (0, value - 1), Op.LE: (0, value), Op.GT: (value + 1, most), Op.GE: (value, most)}[op]
    lo, hi = max(lo, 0), min(hi, most)
    return (lo, hi) if lo <= hi else None


def raw(prop: Prop) -> Column:
    """The unsigned cell that predicates, sums and sorts see."""
    if prop.kind == Kind.INT:
        return F.col(prop.name)
    if prop.kind == Kind.LINK:
        return F.coalesce(F.col(prop.name) + 1, F.lit(0).cast("bigint"))
    raise UnsupportedPredicate(f"{prop.name}: {prop.kind.value} properties can't be compared")


def _number(prop: Prop, v: int) -> Column:
    return F.lit(v).cast("bigint") if not prop.wide else F.lit(str(v)).cast("decimal(20,0)")


def to_column(prop: Prop, op: Op, value: int) -> Column:
    raw(prop)  # rejects kinds that can't be compared
    most, c, null_in = largest(prop), F.col(prop.name), False
    if op == Op.NE:
        if not 0 <= value <= most:
            return F.lit(True)
        if prop.kind == Kind.LINK:
            return c.isNotNull() if value == 0 else c.isNull() | (c != _number(prop, value - 1))
        return c != _number(prop, value)
    got = bounds(op, value, most)
    if got is None:
        return F.lit(False)
    lo, hi = got
    if prop.kind == Kind.LINK:
        null_in, lo, hi, most = lo == 0, lo - 1, hi - 1, most - 1
        if hi < 0:
            return c.isNull()
        lo = max(lo, 0)
    if lo == hi:
        out = c == _number(prop, lo)
    elif lo == 0 and hi == most:
        out = c.isNotNull() if prop.kind == Kind.LINK and not null_in else F.lit(True)
    elif lo == 0:
        out = c <= _number(prop, hi)
    elif hi == most:
        out = c >= _number(prop, lo)
    else:
        out = c.between(_number(prop, lo), _number(prop, hi))
    return c.isNull() | out if null_in else out


def conjunction(otype: ObjectType, preds: list[Predicate]) -> Column:
    """All of preds; an empty list holds for every row."""
    return reduce(lambda a, b: a & b, (to_column(otype.prop(p.prop), Op(p.op), p.value) for p in preds), F.lit(True))


def driving(otype: ObjectType, preds: list[Predicate]) -> int | None:
    """Which predicate an index would serve: the first equality on an indexed property, else the first range on one. Spark needs no
    choice (every predicate is pushed to the scan); this names the property whose file order prunes most."""
    able = [i for i, p in enumerate(preds) if otype.prop(p.prop).indexed and Op(p.op) != Op.NE]
    return next((i for i in able if Op(preds[i].op) == Op.EQ), able[0] if able else None)
