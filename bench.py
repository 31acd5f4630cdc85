"""Set-based headline queries: the star-schema tables in $BENCH_SF_DIR, and the reference scale of one million rows. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import query
from tabulon.plans.predicates import Op, Predicate
from tabulon.queries import QUERIES
from tabulon.schema import ObjectType, Prop, of_ints
from tabulon.sources.store import Store

NAMES = (
    "where_eq", "where_and", "count_where", "aggregate_int", "aggregate_wrap", "range_inclusive", "sort_by_prop", "get_by_pk", "get_linked", "nested_linked", "backlink_count", "link_set_count",
    "set_link", "list_get", "dict_collect", "insert_status", "update_status", "delete_nullify", "delete_cascade", "bulk_import", "bulk_append", "value_index", "pk_fold", "integrity",
)
ROWS, REPEATS = 1_000_000, 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f, repeats: int = REPEATS) -> float:
    """Median seconds, after one run that isn't counted."""
    f()
    took = []
    for _ in range(repeats):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 4)


def million(spark: SparkSession, top: str) -> dict[str, float]:
    """Bulk import of 1M rows of two integers, append of 500k to 500k, and counts over 1M rows with 100 categories."""
    out: dict[str, float] = {}
    n = iter(range(10_000))
    data = spark.range(ROWS).select(F.col("id").alias("p0"), (F.col("id") * 3).alias("p1"))
    data.write.parquet(f"{top}/src")
    data = spark.read.parquet(f"{top}/src")

    def load() -> Store:
        s = Store.create(spark, f"{top}/s{next(n)}")
        with s.begin_write() as w:
            w.add_type(of_ints("t", 2))
            w.bulk_import(0, data)
            w.commit()
        return s

    out["bulk_import_1m"] = timed(load, 2)
    half = data.where(f"p0 < {ROWS // 2}")
    rest = data.where(f"p0 >= {ROWS // 2}").withColumn("_pos", F.col("p0"))
    took = []
    for _ in range(2):
        s = Store.create(spark, f"{top}/a{next(n)}")
        with s.begin_write() as w:
            w.add_type(of_ints("t", 2))
            w.bulk_import(0, half)
            w.commit()
        t = time.perf_counter()
        with s.begin_write() as w:
            w.bulk_append(0, rest)
            w.commit()
        took.append(time.perf_counter() - t)
    out["bulk_append_500k"] = round(min(took), 4)
    s = Store.create(spark, f"{top}/c")
    with s.begin_write() as w:
        w.add_type(ObjectType("t", (Prop("pk"), Prop("category", indexed=True))))
        w.bulk_import(0, spark.range(ROWS).select(F.col("id").alias("pk"), (F.col("id") % 100).alias("category")))
        w.commit()
    with s.begin_read() as r:
        t = r.table(0)
        out["full_scan_count_1m"] = timed(lambda: query.count_where(t, []).collect(), 7)
        out["eq_count_1m"] = timed(lambda: query.count_where(t, [Predicate("category", Op.EQ, 42)]).collect(), 7)
        out["aggregate_1m"] = timed(lambda: query.aggregate_int(t, "pk", [Predicate("category", Op.LT, 50)]).collect(), 7)
        out["lookup_100k_keys_1m"] = timed(lambda: run(query.get_by_pk(t, spark.range(0, ROWS, 10).toDF("pk"))))
    return out


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )
    with tempfile.TemporaryDirectory() as top:
        took = {n: timed(lambda n=n: run(QUERIES[n](spark, d))) for n in NAMES} | million(spark, top)
        sys.stdout.flush()
        print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")), "rows_per_s": {"bulk_import": round(ROWS / took["bulk_import_1m"]), "bulk_append": round(ROWS / 2 / took["bulk_append_500k"])}}))
    spark.stop()


if __name__ == "__main__":
    main()
