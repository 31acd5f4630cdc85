"""List, set and dictionary expressions."""

import pytest
from pyspark.sql import functions as F

from tabulon.functions import collections as C


@pytest.fixture(scope="module")
def row(spark):
    lit = lambda x: F.lit(x).cast("binary")
    df = spark.range(1).select(
        F.array(F.lit(10), F.lit(20), F.lit(10)).alias("l"), C.build_set(F.array(F.lit(6), F.lit(5), F.lit(6))).alias("s"), C.build_set(F.array(lit("x"), lit("yy"), lit("x"))).alias("b"),
        C.build_dict(F.array(lit("apple"), lit("banana"), lit("apple")), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d"), F.lit(None).cast("array<int>").alias("none"),
    )
    return lambda c: df.select(c.alias("v")).first()["v"]


def test_lists(row):
    c = F.col("l")
    assert row(C.length(c)) == 3 and row(C.list_get(c, 0)) == 10 and row(C.list_get(c, 2)) == 10
    assert row(C.list_append(c, F.lit(7))) == [10, 20, 10, 7] and row(C.list_set(c, 1, F.lit(9))) == [10, 9, 10]
    for bad in (C.list_get(c, 3), C.list_get(c, -1), C.list_set(c, 3, F.lit(1))):
        with pytest.raises(Exception, match="out of bounds"):
            row(bad)
    assert row(C.list_get(F.col("none"), 0)) is None


def test_sets(row):
    s, b = F.col("s"), F.col("b")
    assert row(s) == [5, 6] and row(C.set_add(s, F.lit(1))) == [1, 5, 6] and row(C.set_add(s, F.lit(5))) == [5, 6]
    assert row(C.set_remove(s, F.lit(5))) == [6] and row(C.set_remove(s, F.lit(8))) == [5, 6] and row(C.set_contains(s, F.lit(6)))
    assert [bytes(x) for x in row(b)] == [b"x", b"yy"] and row(C.length(b)) == 2
    z = C.set_add(C.set_add(b, F.lit(b"z")), F.lit(b"z"))
    assert row(C.length(z)) == 3 and [bytes(x) for x in row(C.set_remove(z, F.lit(b"x")))] == [b"yy", b"z"]
    high = C.build_set(F.array(F.lit(b"\xff"), F.lit(b"a"), F.lit(b"\x7f")))
    assert [bytes(x) for x in row(high)] == [b"a", b"\x7f", b"\xff"]


def test_dictionaries(row):
    d = F.col("d")
    items = lambda c: [(bytes(e["key"]), e["value"]) for e in row(C.dict_entries(c))]
    assert items(d) == [(b"apple", 3), (b"banana", 2)] and row(C.dict_get(d, F.lit(b"none"))) is None and row(C.dict_get(d, F.lit(b"apple"))) == 3
    new = C.dict_remove(C.dict_put(C.dict_put(d, F.lit(b"cherry"), F.lit(3).cast("bigint")), F.lit(b"apple"), F.lit(9).cast("bigint")), F.lit(b"banana"))
    assert items(new) == [(b"apple", 9), (b"cherry", 3)] and row(C.dict_count(new)) == 2
    assert row(C.blob_size(F.lit("é"))) == 2 and row(C.blob_size(F.lit(None).cast("binary"))) == 0
