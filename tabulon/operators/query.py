"""Filters, counts, aggregates, ranges, order and look-ups over one table. Results are DataFrames; object keys come ascending where order shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import Op, Predicate, conjunction, raw
from .ranking import with_rank
from .table import Table

WRAP = "18446744073709551616"


def matching(t: Table, preds: list[Predicate]) -> DataFrame:
    return t.df.where(conjunction(t.otype, preds))


def where(t: Table, preds: list[Predicate], ordered: bool = True) -> DataFrame:
    """(_okey) of the rows that meet every predicate. The range sort costs a shuffle; leave it out where order doesn't show."""
    found = matching(t, preds).select("_okey")
    return found.orderBy("_okey") if ordered else found


def count_where(t: Table, preds: list[Predicate]) -> DataFrame:
    return matching(t, preds).agg(F.count("*").alias("n"))


def wrapping_sum(c: Column) -> Column:
    """Sum of unsigned cells modulo 2^64, 0 for no rows, as DECIMAL(20,0)."""
    total = F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.coalesce(F.pmod(total, F.lit(WRAP).cast("decimal(38,0)")), F.lit(0)).cast("decimal(20,0)")


def aggregate_int(t: Table, prop: int | str, preds: list[Predicate]) -> DataFrame:
    """(count, sum, min, max) in one pass; over no rows the sum is 0, min and max are null."""
    c = raw(t.otype.prop(prop))
    return matching(t, preds).agg(F.count("*").alias("count"), wrapping_sum(c).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"))


def range_inclusive(t: Table, prop: int | str, lo: int, hi: int, ordered: bool = True) -> DataFrame:
    """(_okey) with lo <= value <= hi; nothing if lo > hi."""
    return where(t, [Predicate(prop, Op.GE, lo), Predicate(prop, Op.LE, hi)], ordered)


def sort_by_prop(t: Table, okeys: DataFrame, prop: int | str, position: str | None = None) -> DataFrame:
    """okeys(_okey) by ascending property, ties by object key. An unknown key is an error. With `position`, rows come unordered with their
    0-based place in that column instead, which scales as with_rank does."""
    cell = raw(t.otype.prop(prop))
    values = t.df.select("_okey", cell.alias("_cell"))
    rows = okeys.join(values, "_okey", "left")
    rows = rows.withColumn("_cell", F.when(F.col("_cell").isNull(), F.raise_error(F.lit("unknown object key"))).otherwise(F.col("_cell")))
    if position:
        return with_rank(rows, "_cell", ["_okey"], position).select("_okey", position)
    return rows.orderBy("_cell", "_okey").select("_okey")


def get_by_pk(t: Table, pks: list[int] | DataFrame) -> DataFrame:
    """Rows of the given primary keys: a short list is a pushed filter, a table (pk) a semi-join."""
    if isinstance(pks, DataFrame):
        return t.df.join(pks.select(F.col(pks.columns[0]).alias(t.otype.pk)), t.otype.pk, "left_semi").select(*t.columns())
    return t.df.where(F.col(t.otype.pk).isin(list(pks)))


def get_by_okey(t: Table, okeys: list[int] | DataFrame) -> DataFrame:
    if isinstance(okeys, DataFrame):
        return t.df.join(okeys.select(F.col(okeys.columns[0]).alias("_okey")), "_okey", "left_semi").select(*t.columns())
    return t.df.where(F.col("_okey").isin(list(okeys)))


def pk_to_okey(t: Table, pks: list[int] | DataFrame) -> DataFrame:
    return get_by_pk(t, pks).select(t.otype.pk, "_okey")


def resolve_prop(t: Table, pks: list[int] | DataFrame, prop: int | str) -> DataFrame:
    """(pk, cell): the raw cell of integers and links, the value of others."""
    p = t.otype.prop(prop)
    cell = raw(p) if p.kind.value in ("int", "link") else F.col(p.name)
    return get_by_pk(t, pks).select(F.col(t.otype.pk).alias("pk"), cell.alias("cell"))


def live_count(t: Table) -> DataFrame:
    return t.df.agg(F.count("*").alias("n"))


def max_key(t: Table) -> DataFrame:
    """The largest primary key; null for an empty table."""
    return t.df.agg(F.max(t.otype.pk).alias("max_pk"))


def value_index(t: Table, prop: int | str) -> DataFrame:
    """(value, n, min_okey, max_okey): what an index on prop holds, by value. value_entries() lists the keys themselves."""
    return t.df.groupBy(raw(t.otype.prop(prop)).alias("value")).agg(F.count("*").alias("n"), F.min("_okey").alias("min_okey"), F.max("_okey").alias("max_okey"))


def value_entries(t: Table, prop: int | str) -> DataFrame:
    """(value, _okey), sorted: one row for each entry, so a frequent value is no large array."""
    return t.df.select(raw(t.otype.prop(prop)).alias("value"), "_okey").orderBy("value", "_okey")
