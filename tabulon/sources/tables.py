"""The star-schema tables as object types: dense keys are their own object keys, so reading one is a plain scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import with_rank
from ..operators.table import Table
from ..schema import Elem, Kind, ObjectType, Prop, Rule

REGION, NATION, CUSTOMER, ORDERS, LINEITEM = range(5)


def _i(name: str, **k) -> Prop:
    return Prop(name, Kind.INT, **k)


def _s(name: str) -> Prop:
    return Prop(name, Kind.BLOB)


def _l(name: str, target: int, rule: Rule = Rule.NULLIFY) -> Prop:
    return Prop(name, Kind.LINK, target=target, rule=rule)


TYPES = {
    "region": ObjectType("region", (_i("r_regionkey"), _s("r_name"))),
    "nation": ObjectType("nation", (_i("n_nationkey"), _s("n_name"), _l("n_regionkey", REGION))),
    "customer": ObjectType("customer", (_i("c_custkey"), _s("c_name"), _l("c_nationkey", NATION), _s("c_mktsegment"))),
    "orders": ObjectType("orders", (_i("o_orderkey"), _l("o_custkey", CUSTOMER), _s("o_orderstatus"), _s("o_orderpriority"))),
    "part": ObjectType("part", (_i("p_partkey"), _s("p_name"), _i("p_size"))),
    "documents": ObjectType("documents", (_i("doc_id"), _s("text"), _i("n_chars"))),
    "labels": ObjectType("labels", (_i("doc_id"), _i("quality", indexed=True), _i("toxic"))),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A table whose keys are 0 to n - 1 as rows at version 2, the version of a first commit."""
    t = TYPES[name]
    df = read(spark, sf_dir, name)
    wide = lambda p: F.col(p.name).cast("bigint") if p.kind in (Kind.INT, Kind.LINK) else F.col(p.name)  # noqa: E731  strings stay strings: same bytes
    return Table(t, df.select(F.col(t.pk).cast("bigint").alias("_okey"), F.lit(2).cast("bigint").alias("_version"), *(wide(p).alias(p.name) for p in t.props)))


def numbered(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A table with sparse keys: object keys are the ranks of the keys."""
    t = TYPES[name]
    df = with_rank(read(spark, sf_dir, name).select(*(F.col(p.name).cast("bigint").alias(p.name) for p in t.props)), t.pk, name="_okey")
    return Table(t, df.select("_okey", F.lit(2).cast("bigint").alias("_version"), *t.names))


def as_links(t: Table, **targets: int) -> Table:
    """t with integer columns read as links."""
    props = tuple(_l(p.name, targets[p.name]) if p.name in targets else p for p in t.otype.props)
    return Table(ObjectType(t.otype.name, props, t.otype.embedded), t.df, t.next_key, t.next_row)


def order_parts(spark: SparkSession, sf_dir: str) -> Table:
    """Orders with the set of their parts as a to-many link."""
    t = ObjectType("order_parts", (_i("o_orderkey"), Prop("parts", Kind.LINK_SET, target=0)))
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return Table(t, per.select(F.col("o_orderkey").alias("_okey"), F.lit(2).cast("bigint").alias("_version"), "o_orderkey", "parts"))


def user_events(spark: SparkSession, sf_dir: str) -> Table:
    """Users with the list of their events, the set of event types and the count of each type."""
    t = ObjectType("user_events", (_i("user_id"), Prop("events", Kind.LIST), Prop("types", Kind.SET, Elem.BLOB), Prop("counts", Kind.DICT)))
    ev = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").cast("binary").alias("kind"))
    lists = ev.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("events"), F.array_sort(F.collect_set("kind")).alias("types"))
    counts = ev.groupBy("user_id", "kind").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))
    return Table(t, lists.join(counts, "user_id").select(F.col("user_id").alias("_okey"), F.lit(2).cast("bigint").alias("_version"), *t.names))
