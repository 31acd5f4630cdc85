"""Filters, aggregates and order against plain Python, and pushed filters."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.errors import DuplicateKey, SchemaMismatch, UnsupportedPredicate
from tabulon.operators import bulk, query, ranking
from tabulon.operators.table import Table
from tabulon.plans.predicates import Op, Predicate, bounds, driving
from tabulon.schema import Elem, Kind, ObjectType, Prop, Rule, of_ints, of_kinds, validate

PY = {Op.EQ: int.__eq__, Op.NE: int.__ne__, Op.LT: int.__lt__, Op.LE: int.__le__, Op.GT: int.__gt__, Op.GE: int.__ge__}


def make(spark, otype, rows):
    schema = otype.struct()
    exact = lambda r: [Decimal(v) if p.wide else v for p, v in zip(otype.props, r)]
    return Table(otype, spark.createDataFrame([(i, 2, *exact(r)) for i, r in enumerate(rows)], schema), len(rows), len(rows))


def keys(df):
    return [r[0] for r in df.collect()]


def test_small_filters(spark):
    t = make(spark, of_ints("t", 2), [(1, 20), (2, 30), (3, 40), (4, 30)])
    assert len(keys(query.where(t, [Predicate(1, Op.EQ, 30)]))) == 2
    assert len(keys(query.where(t, [Predicate(1, Op.GT, 25), Predicate(0, Op.LT, 4)]))) == 2
    left = Table(t.otype, t.df.where("p0 <> 2"))
    assert len(keys(query.where(left, [Predicate(1, Op.EQ, 30)]))) == 1


def test_aggregates(spark):
    t = make(spark, of_ints("t", 2), [(1, 10), (2, 20), (3, 30), (4, 40)])
    one = lambda p: tuple(query.aggregate_int(t, 1, p).first())
    assert query.count_where(t, []).first()[0] == 4 and query.count_where(t, [Predicate(1, Op.GE, 30)]).first()[0] == 2
    assert one([]) == (4, 100, 10, 40) and one([Predicate(1, Op.GT, 1000)]) == (0, 0, None, None)


def test_sum_wraps_at_64_bits(spark):
    ty = ObjectType("t", (Prop("pk"), Prop("v", wide=True)))
    t = make(spark, ty, [(1, 2**64 - 1), (2, 2**64 - 1), (3, 7)])
    assert query.aggregate_int(t, "v", []).first()["sum"] == (2 * (2**64 - 1) + 7) % 2**64


def test_range_and_sort(spark):
    t = make(spark, of_ints("t", 2), [(5, 1), (1, 9), (9, 2), (3, 9), (7, 0)])
    found = query.range_inclusive(t, 0, 3, 7)
    assert len(keys(found)) == 3 and keys(query.range_inclusive(t, 0, 7, 3)) == []
    assert [t.df.where(F.col("_okey") == k).first()["p0"] for k in keys(query.sort_by_prop(t, found, 0))] == [3, 5, 7]
    assert keys(query.sort_by_prop(t, t.df.select("_okey"), 1)) == [4, 0, 2, 1, 3]
    with pytest.raises(Exception, match="unknown object key"):
        query.sort_by_prop(t, spark.createDataFrame([(99,)], "_okey bigint"), 0).collect()


def test_every_operator_on_edges_and_links(spark):
    """All operators and edge values against raw cells, pushed and plain alike."""
    rng = random.Random(1)
    ty = ObjectType("t", (Prop("pk"), Prop("v", indexed=True), Prop("to", Kind.LINK), Prop("w", wide=True)))
    rows = [(i, rng.randint(0, 99), rng.choice([None, 0, 1, 5, 98]), rng.choice([0, 1, 2**63, 2**64 - 1])) for i in range(300)]
    t = make(spark, ty, rows)
    cell = {1: lambda r: r[1], 2: lambda r: 0 if r[2] is None else r[2] + 1, 3: lambda r: r[3]}
    for prop, get in cell.items():
        for op, f in PY.items():
            for v in (-1, 0, 1, 2, 6, 99, 100, 2**63 - 1, 2**63, 2**64 - 1, 2**64):
                assert query.count_where(t, [Predicate(prop, op, v)]).first()[0] == sum(f(get(r), v) for r in rows), (prop, op, v)
    got = keys(query.where(t, [Predicate("v", Op.GE, 10), Predicate("v", Op.LT, 40), Predicate("to", Op.NE, 6)]))
    assert got == [i for i, r in enumerate(rows) if 10 <= r[1] < 40 and r[2] != 5]


def test_filters_reach_the_scan(spark, tmp_path):
    t = make(spark, of_ints("t", 3), [(i, i % 100, i) for i in range(1000)])
    t.df.write.parquet(f"{tmp_path}/t")
    t = Table(t.otype, spark.read.schema(t.df.schema).parquet(f"{tmp_path}/t"))
    plan = query.where(t, [Predicate(1, Op.EQ, 7)], ordered=False)._jdf.queryExecution().toString()
    assert "EqualTo(p1,7)" in plan and "ReadSchema: struct<_okey:bigint,p1:bigint>" in plan
    links = Table(ObjectType("t", (Prop("p0"), Prop("p1", Kind.LINK))), t.df)
    assert "LessThanOrEqual(p1,8)" in query.where(links, [Predicate(1, Op.LT, 10)], ordered=False)._jdf.queryExecution().toString()


def test_planning():
    ty = ObjectType("t", (Prop("pk"), Prop("a", indexed=True), Prop("b", indexed=True), Prop("c")))
    p = lambda prop, op: Predicate(prop, op, 1)
    assert driving(ty, [p("c", Op.EQ), p("a", Op.GT), p("b", Op.EQ)]) == 2
    assert driving(ty, [p("a", Op.NE), p("b", Op.LE)]) == 1 and driving(ty, [p("a", Op.NE), p("c", Op.EQ)]) is None
    assert bounds(Op.GT, 2**64 - 1, 2**64 - 1) is None and bounds(Op.LT, 0, 9) is None and bounds(Op.LE, 4, 9) == (0, 4)


def test_unsupported_kinds_are_refused(spark):
    t = make(spark, ObjectType("t", (Prop("pk"), Prop("b", Kind.BLOB))), [(1, b"x")])
    with pytest.raises(UnsupportedPredicate):
        query.where(t, [Predicate("b", Op.EQ, 1)])


def test_lookups_and_index(spark):
    t = make(spark, of_ints("t", 2), [(100, 7), (200, 8), (300, 7)])
    assert [r["_okey"] for r in query.get_by_pk(t, [200, 999]).collect()] == [1]
    assert [r["p0"] for r in query.get_by_okey(t, spark.createDataFrame([(2,), (9,)], "k bigint")).collect()] == [300]
    assert {tuple(r) for r in query.value_index(t, 1).collect()} == {(7, 2, 0, 2), (8, 1, 1, 1)}
    assert [tuple(r) for r in query.value_entries(t, 1).collect()] == [(7, 0), (7, 2), (8, 1)]
    assert query.max_key(t).first()[0] == 300 and query.live_count(t).first()[0] == 3
    assert query.max_key(Table(t.otype, t.df.limit(0))).first()[0] is None


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Small shuffles in one partition, as they run here, and in several, as large ones run."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_ranks_and_order_over_partitions(spark, coalesced):
    rng = random.Random(2)
    ks = [rng.choice((None, 7, 7, rng.randint(-500, 500))) for _ in range(900)]  # half of the rows share a key, a quarter have none
    df = spark.createDataFrame(list(enumerate(ks)), "id bigint, k bigint")
    want = {i: n for n, (_, i) in enumerate(sorted((-9999 if k is None else k, i) for i, k in enumerate(ks)))}
    assert {r.id: r._rank for r in ranking.with_rank(df, "k", ["id"]).collect()} == want
    assert ranking.with_rank(df.limit(0), "k", ["id"]).count() == 0
    up = spark.createDataFrame([(i, 3 * i) for i in range(500)], "p bigint, k bigint")
    assert ranking.ascending(up, "p", "k") and ranking.ascending(up.limit(0), "p", "k")
    for bad in (250, 0, 499):
        assert not ranking.ascending(up.withColumn("k", F.when(F.col("p") == bad, 741 if bad else 9999).otherwise(F.col("k"))), "p", "k")


def test_bulk_sees_every_duplicate_with_one_shuffle(spark, coalesced):
    t = Table(of_ints("t", 2), spark.createDataFrame([], "_okey bigint, _version bigint, p0 bigint, p1 bigint"))
    df = spark.range(400).select(F.col("id").alias("p0"), (F.col("id") % 7).alias("p1"))
    assert {(r._okey, r.p0) for r in bulk.bulk_import(t, df.sort(F.desc("p0")), 1).collect()} == {(i, i) for i in range(400)}
    for again in (0, 200, 399):
        with pytest.raises(DuplicateKey):
            bulk.bulk_import(t, df.unionAll(df.where(F.col("p0") == again)), 1)
    same = F.count("*").over(Window.partitionBy("p0")).alias("n")
    plan = df.repartitionByRange("p0").sortWithinPartitions("p0").select("*", same)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_schema_rules():
    with pytest.raises(SchemaMismatch):
        ObjectType("t", (Prop("b", Kind.BLOB),))
    with pytest.raises(SchemaMismatch):
        of_ints("t", 257)
    ty = ObjectType("t", (Prop("pk"), Prop("s", Kind.SET, Elem.BLOB), Prop("l", Kind.LINK, target=3, rule=Rule.BLOCK, indexed=True)), embedded=True)
    assert ObjectType.from_json(ty.to_json()) == ty
    assert ty.struct()["l"].metadata["rule"] == "block" and ty.struct()["l"].metadata["pos"] == 2
    validate([of_kinds("a", [Kind.INT, Kind.DICT])], [[Kind.INT, Kind.DICT]])
    with pytest.raises(SchemaMismatch):
        validate([of_ints("a", 2)], [[Kind.INT]])
