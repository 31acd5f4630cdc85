"""To-one and to-many links, followed and reversed by equi-joins for whole tables at once. Backlinks are derived, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Kind, Prop
from .table import Table, changed


def get_link(t: Table, prop: int | str) -> DataFrame:
    """(_okey, target): null where unset."""
    return t.df.select("_okey", F.col(t.otype.prop(prop).name).alias("target"))


def resolve_link(t: Table, prop: int | str) -> DataFrame:
    """(_okey, target_type, target) of the links that are set."""
    p = t.otype.prop(prop)
    return t.df.where(F.col(p.name).isNotNull()).select("_okey", F.lit(p.target).alias("target_type"), F.col(p.name).alias("target"))


def follow(t: Table, prop: int | str, target: Table, prefix: str = "to_") -> DataFrame:
    """t's rows with the linked object's columns, prefixed; null where the link is unset or dangling."""
    p = t.otype.prop(prop)
    there = target.df.select(*(F.col(c).alias(f"{prefix}{c}") for c in target.columns()))
    return t.df.join(there, F.col(p.name) == F.col(f"{prefix}_okey"), "left")


def edges(t: Table, prop: int | str) -> DataFrame:
    """(source, target): one row for each link."""
    p = t.otype.prop(prop)
    if p.kind == Kind.LINK:
        return t.df.where(F.col(p.name).isNotNull()).select(F.col("_okey").alias("source"), F.col(p.name).alias("target"))
    return t.df.select(F.col("_okey").alias("source"), F.explode(p.name).alias("target"))


def backlinks(t: Table, prop: int | str, ordered: bool = False) -> DataFrame:
    """(target, source), by both if ordered."""
    out = edges(t, prop).select("target", "source")
    return out.orderBy("target", "source") if ordered else out


def backlink_counts(t: Table, prop: int | str, target: Table) -> DataFrame:
    """(_okey, n) for every object of target, 0 included; counted before the join."""
    per = edges(t, prop).groupBy(F.col("target").alias("_okey")).agg(F.count("*").alias("n"))
    return target.df.select("_okey").join(per, "_okey", "left").select("_okey", F.coalesce("n", F.lit(0)).alias("n"))


def link_set_counts(t: Table, prop: int | str) -> DataFrame:
    return t.df.select("_okey", F.size(t.otype.prop(prop).name).cast("bigint").alias("n"))


def link_set_contains(t: Table, prop: int | str, target: int) -> DataFrame:
    return t.df.select("_okey", F.array_contains(t.otype.prop(prop).name, F.lit(target)).alias("contains"))


def link_set_members(t: Table, prop: int | str, ordered: bool = True) -> DataFrame:
    """(_okey, target), ascending."""
    out = edges(t, prop).select(F.col("source").alias("_okey"), "target")
    return out.orderBy("_okey", "target") if ordered else out


def _rewritten(t: Table, name: str, new: DataFrame, version: int) -> DataFrame:
    """Changes for the rows of new(_okey, _new) whose value differs; they take the version."""
    rows = t.df.join(new, "_okey").where(~F.col(name).eqNullSafe(F.col("_new")))
    return changed(rows.withColumn(name, F.col("_new")).withColumn("_version", F.lit(version).cast("bigint")), t)


def set_link(t: Table, prop: int | str, wanted: DataFrame, version: int) -> DataFrame:
    """Changes that set the links of wanted(pk, target), a null target clears. Unknown keys and unchanged links change nothing. If a key comes
    more than once, its greatest target counts."""
    name = t.otype.prop(prop).name
    per = wanted.groupBy(F.col("pk").alias("_pk")).agg(F.max("target").alias("_new"))
    return _rewritten(t, name, t.df.select("_okey", F.col(t.otype.pk).alias("_pk")).join(per, "_pk").select("_okey", "_new"), version)


def _members(t: Table, wanted: DataFrame) -> DataFrame:
    per = wanted.groupBy(F.col("pk").alias("_pk")).agg(F.array_sort(F.collect_set("target")).alias("_m"))
    return t.df.select("_okey", F.col(t.otype.pk).alias("_pk")).join(per, "_pk").select("_okey", "_m")


def link_set_add(t: Table, prop: int | str, wanted: DataFrame, version: int) -> DataFrame:
    """Changes that add wanted(pk, target) to the sets; members that are there change nothing."""
    name = t.otype.prop(prop).name
    new = t.df.select("_okey", name).join(_members(t, wanted), "_okey").select("_okey", F.array_sort(F.array_union(name, "_m")).alias("_new"))
    return _rewritten(t, name, new, version)


def link_set_remove(t: Table, prop: int | str, wanted: DataFrame, version: int) -> DataFrame:
    name = t.otype.prop(prop).name
    new = t.df.select("_okey", name).join(_members(t, wanted), "_okey").select("_okey", F.array_except(name, "_m").alias("_new"))
    return _rewritten(t, name, new, version)


def nullify(t: Table, props: list[Prop], gone: DataFrame) -> DataFrame:
    """Changes that clear what props link to in gone(_okey, of the props' target type). Row versions stay as they are."""
    out, touched = t.df, F.lit(False)
    gone = gone.select(F.col("_okey").alias("_gone")).distinct()
    for p in props:
        if p.kind == Kind.LINK:
            out = out.join(gone, F.col(p.name) == F.col("_gone"), "left")
            hit = F.col("_gone").isNotNull()
            out = out.withColumn(p.name, F.when(~hit, F.col(p.name))).withColumn("_hit", hit)
        else:
            pairs = t.df.select("_okey", F.explode(p.name).alias("_gone")).join(gone, "_gone").groupBy("_okey").agg(F.collect_list("_gone").alias("_m"))
            out = out.join(pairs, "_okey", "left").withColumn("_hit", F.col("_m").isNotNull())
            out = out.withColumn(p.name, F.when(F.col("_hit"), F.array_except(p.name, "_m")).otherwise(F.col(p.name))).drop("_m")
        out = out.withColumn(f"_hit_{p.name}", F.col("_hit")).drop("_gone", "_hit")
        touched = touched | F.col(f"_hit_{p.name}")
    return changed(out.where(touched), t)
