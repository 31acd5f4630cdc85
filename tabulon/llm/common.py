"""What several operators share: scratch tables, word shingles, row order across partitions."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, as bytes.split() cuts them.
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so their Python finds it wherever they run. A package that came in an
    archive is there already."""
    sc, top = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if sc.applicationId in _shipped or not os.path.isdir(top):
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(), with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, one machine's temp folder does if all runs on
    that machine; on a cluster it is an error."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "tabulon-scratch")
    return f"{top.rstrip('/')}/t-{uuid.uuid4().hex}"


def column(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of df as one struct `_row`, beside `more`: whatever df's columns are called, they can't clash with an operator's own."""
    return df.select(F.struct(*map(column, df.columns)).alias("_row"), *more)


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns `names` out of _row, and new ones; a new column takes the place of one of its name."""
    return df.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in names), *(v.alias(k) for k, v in new.items() if k not in names))


#: Spark's own setting: the shuffle files of a query go when the query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors and is computed once. Nothing needs the query's shuffle files after that."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    gc.collect()  # plans that Python still holds in cycles would fill the driver's memory
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, df._scratch
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shingle_bounds(words: list[bytes], k: int) -> tuple[bytes, list[int], list[int]]:
    """The space-joined words, and where each shingle of k words starts and ends in them. Fewer words than k: the whole; none: no shingle."""
    joined = b" ".join(words)
    if not words:
        return joined, [], []
    if len(words) <= k:
        return joined, [0], [len(joined)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> list[int]:
    """XXH64 of each k-word shingle, repeats included."""
    h, (joined, starts, ends) = xxhash.xxh64_intdigest, shingle_bounds(words, k)
    return [h(joined[a:b], seed) for a, b in zip(starts, ends)]


def in_order(rows: DataFrame, order: list[str], per_part: int) -> DataFrame:
    """rows sorted ascending (null first) over partitions of about per_part rows each, with `part`, the partition's number in that order. However many rows,
    the driver sees one cut point for each partition. End `order` with a column of its own value in each row, and rows that are alike in the others can be
    dealt to several partitions."""
    by = [F.col(c).asc_nulls_first() for c in order]
    parts = max(1, -(-rows.count() // per_part))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())


def running_totals(rows: DataFrame, order: list[str], weight: str, per_part: int = 200_000) -> DataFrame:
    """rows with `nth` (rows before) and `before` (sum of weight over them), in the order that in_order() gives: sums inside partitions of bounded size, and then
    over one row for each partition."""
    dealt = written(in_order(rows, order, per_part))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("part").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    per = per.select("part", F.coalesce(F.sum("w").over(first), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("part").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    own = dealt.select("*", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("w1"), F.row_number().over(inside).alias("n1"))
    return own.join(per, "part").select(*rows.columns, (F.col("n0") + F.col("n1") - 1).alias("nth"), (F.col("w0") + F.col("w1")).alias("before"))
