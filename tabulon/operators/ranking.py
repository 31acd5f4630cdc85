"""Dense global positions without a single-partition window.

Rows are range-partitioned and sorted once, by key and ties together, so a key that most rows share is spread like any other; the sorted rows are written, with
their partition and place in it. A row's position is its place plus the rows of earlier partitions: the driver sees one number for each shuffle partition.
"""

from __future__ import annotations

from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .cut import cut

#: monotonically_increasing_id(): the partition above this bit, the place in it below.
PLACE_BITS = 33


def in_order(df: DataFrame, order: list[str], *more: Column) -> DataFrame:
    """df, computed once, with `_at`: ascending along `order` (null first), partition and place in it. `more` are columns over the sorted partitions."""
    by = [F.col(c).asc_nulls_first() for c in order]
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", *more).withColumn("_at", F.monotonically_increasing_id()))


def _part() -> Column:
    return F.shiftright("_at", PLACE_BITS)


def parts(rows: DataFrame, *more: Column) -> list[Row]:
    """(part, n, more...) of in_order() rows: a row for each partition that has any, in order."""
    return sorted(rows.groupBy(_part().alias("part")).agg(F.count("*").alias("n"), *more).collect())


def numbered(rows: DataFrame, per: list[Row], name: str = "_rank") -> DataFrame:
    """in_order() rows with their 0-based position for `_at`; per: parts(rows). The scan's own projection: no join and no shuffle."""
    n = {r["part"]: r["n"] for r in per}
    before = accumulate((n.get(i, 0) for i in range(max(n, default=0))), initial=0)
    starts = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.withColumn(name, F.get(starts, _part().cast("int")) + place).drop("_at")


def with_rank(df: DataFrame, key: str, ties: list[str] | None = None, name: str = "_rank") -> DataFrame:
    """df with each row's 0-based position in ascending order of key, ties; rows alike in all of these come in any order."""
    rows = in_order(df, [key, *(ties or [])])
    return numbered(rows, parts(rows), name)


def rising(rows: DataFrame, key: str) -> tuple[list[Row], bool, int | None]:
    """parts() of in_order() rows, whether key rises strictly along them, and its first value: inside every partition by lag, across partitions by their ends."""
    k = F.col(key)
    bad = k <= F.lag(k).over(Window.partitionBy("_part").orderBy("_at"))
    per = parts(rows.select("_at", k, _part().alias("_part")).withColumn("_bad", bad), F.max("_bad").alias("bad"), F.min(k).alias("lo"), F.max(k).alias("hi"))
    return per, not any(r["bad"] for r in per) and all(a["hi"] < b["lo"] for a, b in pairwise(per)), per[0]["lo"] if per else None


def ascending(df: DataFrame, position: str, key: str) -> bool:
    return rising(in_order(df.select(position, key), [position]), key)[1]
