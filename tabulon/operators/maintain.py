"""Schema changes, compaction, equivalence of two stores, and the integrity report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompactionMismatch, SchemaMismatch
from ..schema import LINKS, Kind, Prop
from .links import edges
from .table import Table


def add_property(t: Table, prop: Prop, default: Column | None = None) -> Table:
    """A new last property; every row gets the default (for collections the empty one, whatever is given)."""
    value = prop.empty() if default is None or prop.kind not in (Kind.INT, Kind.BLOB, Kind.LINK) else default.cast(prop.spark_type())
    return Table(t.otype.with_property(prop), t.df.withColumn(prop.name, value), t.next_key, t.next_row)


def remove_property(t: Table, at: int) -> Table:
    """Without property `at` (the key stays); later properties move up."""
    return Table(t.otype.without_property(at), t.df.drop(t.otype.props[at].name), t.next_key, t.next_row)


def should_compact(live: int, next_row: int) -> bool:
    """Whether over half the rows ever placed are dead."""
    return next_row > 0 and (next_row - live) * 2 > next_row


def compact(t: Table) -> Table:
    """Live rows in object-key order, range-partitioned so that files have narrow key ranges; object keys, versions and links stay."""
    df = t.df.select(*t.columns()).repartitionByRange("_okey").sortWithinPartitions("_okey")
    return Table(t.otype, df, t.next_key, t.df.count())


def pk_fold(t: Table) -> DataFrame:
    """(n, sum, fold): count, sum and an order-independent fold of the primary keys."""
    return t.df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(t.otype.pk).cast("decimal(38,0)")), F.lit(0)).alias("sum"), F.coalesce(F.bit_xor(F.xxhash64(t.otype.pk)), F.lit(0).cast("bigint")).alias("fold"))


def verify_equivalent(a: list[Table], b: list[Table]) -> None:
    """Type count, live counts, key folds, and every row by object key (to-one links and all other values) agree, or CompactionMismatch."""
    if [t.otype.to_json() for t in a] != [t.otype.to_json() for t in b]:
        raise CompactionMismatch("types differ")
    for x, y in zip(a, b):
        if pk_fold(x).first() != pk_fold(y).first():
            raise CompactionMismatch(f"{x.otype.name}: keys differ")
        row = F.xxhash64(*(p.comparable(F.col(p.name)) for p in x.otype.props), "_version").alias("h")
        one, two = (t.df.select("_okey", row) for t in (x, y))
        if not one.withColumnRenamed("h", "_h").join(two, "_okey", "full").where(~F.col("h").eqNullSafe(F.col("_h"))).isEmpty():
            raise CompactionMismatch(f"{x.otype.name}: rows differ")


def integrity_report(tables: list[Table]) -> DataFrame:
    """(type, problem, n): repeated primary or object keys, object keys at or above next_key, and dangling links (allowed, but told)."""
    spark, out = tables[0].df.sparkSession, []
    for i, t in enumerate(tables):
        twice = lambda c: t.df.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n"))  # noqa: B023, E731
        found = [("duplicate primary key", twice(t.otype.pk)), ("duplicate object key", twice("_okey")), ("object key not given out", t.df.where(F.col("_okey") >= t.next_key).agg(F.count("*").alias("n")))]
        for p in (p for p in t.otype.props if p.kind in LINKS):
            if not 0 <= p.target < len(tables):
                raise SchemaMismatch(f"{p.name}: no type {p.target}")
            lost = edges(t, p.name).join(tables[p.target].df.select(F.col("_okey").alias("target")), "target", "left_anti")
            found.append((f"dangling link {p.name}", lost.agg(F.count("*").alias("n"))))
        out += [df.select(F.lit(i).alias("type"), F.lit(what).alias("problem"), "n") for what, df in found]
    return reduce(DataFrame.unionAll, out).where("n > 0") if out else spark.createDataFrame([], "type int, problem string, n bigint")
