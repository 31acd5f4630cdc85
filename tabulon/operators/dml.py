"""Batches of inserts, updates and deletes with optimistic concurrency. Each returns a status for every row of the batch, and the changes.

A batch is checked against the table as it stands when the batch begins. Where a key comes more than once, the first row (by `_pos`, else
by key) counts as done before the others: a second insert is a duplicate, a second update finds the new version, a second delete finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import with_rank
from .table import Table, changed


@dataclass(frozen=True)
class Done:
    """status: (pk, status, ...) for each row; changes: for Table.apply."""

    status: DataFrame
    changes: DataFrame


def _numbered(batch: DataFrame, pk: str) -> DataFrame:
    batch = batch if "_pos" in batch.columns else batch.withColumn("_pos", F.col(pk))
    return batch.withColumn("_nth", F.row_number().over(Window.partitionBy(pk).orderBy("_pos")))


def stored_row(t: Table, batch: DataFrame) -> list:
    """Every property as it is kept; one the batch lacks gets its default."""
    return [(p.stored(F.col(p.name)) if p.name in batch.columns else p.empty()).alias(p.name) for p in t.otype.props]


def insert(t: Table, batch: DataFrame, version: int) -> Done:
    """status: ok or duplicate, with the new object key. Keys follow next_key in the order of _pos, and are never given twice."""
    pk = t.otype.pk
    rows = _numbered(batch.select(*stored_row(t, batch), *(["_pos"] if "_pos" in batch.columns else [])), pk)
    there = t.df.select(F.col(pk), F.lit(True).alias("_there"))
    rows = rows.join(there, pk, "left").withColumn("_ok", F.col("_there").isNull() & (F.col("_nth") == 1))
    fresh = with_rank(rows.where("_ok"), "_pos", [pk]).withColumn("_okey", F.col("_rank") + F.lit(t.next_key)).withColumn("_version", F.lit(version).cast("bigint"))
    status = fresh.select(F.col(pk).alias("pk"), F.lit("ok").alias("status"), F.col("_okey").alias("okey"))
    refused = rows.where("NOT _ok").select(F.col(pk).alias("pk"), F.lit("duplicate").alias("status"), F.lit(None).cast("bigint").alias("okey"))
    return Done(status.unionAll(refused), changed(fresh, t))


def _judged(t: Table, batch: DataFrame, pk: str) -> DataFrame:
    """batch with the current row's _okey and _version, and the status of its first row for each key."""
    now = t.df.select(F.col(pk), F.col("_okey"), F.col("_version").alias("_now"))
    rows = _numbered(batch, pk).join(now, pk, "left")
    stale = F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("_now"))
    return rows.withColumn("status", F.when(F.col("_okey").isNull(), "not_found").when(stale, "conflict").otherwise("ok"))


def update(t: Table, batch: DataFrame, version: int) -> Done:
    """batch: the properties and expected_version (null: whatever is there). status: ok, conflict or not_found, with current_version (the new
    one if ok). Rows are replaced as a whole, but for properties that the batch lacks; object keys stay."""
    pk = t.otype.pk
    own = [p for p in t.otype.props if p.name in batch.columns]
    batch = batch.select(*(p.stored(F.col(p.name)).alias(p.name) for p in own), F.col("expected_version").cast("bigint"), *(["_pos"] if "_pos" in batch.columns else []))
    rows = _judged(t, batch, pk)
    again = (F.col("_nth") > 1) & (F.max(F.when((F.col("_nth") == 1) & (F.col("status") == "ok"), 1)).over(Window.partitionBy(pk)) == 1)
    fits = F.col("expected_version").isNull() | (F.col("expected_version") == F.lit(version))
    rows = rows.withColumn("status", F.when(again & ~fits, "conflict").when(again, "ok").otherwise(F.col("status")))
    rows = rows.withColumn("_now", F.when(again, F.lit(version).cast("bigint")).otherwise(F.col("_now")))
    last = F.row_number().over(Window.partitionBy(pk).orderBy(F.col("_pos").desc(), F.col("_nth").desc()))
    good = rows.where("status = 'ok'").withColumn("_last", last).where("_last = 1")
    others = [p.name for p in t.otype.props if p not in own]
    good = good.join(t.df.select("_okey", *others), "_okey") if others else good
    status = rows.select(F.col(pk).alias("pk"), "status", F.when(F.col("status") == "ok", F.lit(version).cast("bigint")).otherwise(F.col("_now")).alias("current_version"))
    return Done(status, changed(good.withColumn("_version", F.lit(version).cast("bigint")), t))


def delete(t: Table, batch: DataFrame) -> Done:
    """batch: pk, expected_version (null: whatever is there). status: ok, conflict or not_found. Links elsewhere stay, and dangle: they read as
    null when followed. graph.delete_graph() is the delete that keeps links clean."""
    pk = t.otype.pk
    rows = _judged(t, batch.select(F.col("pk").cast(t.otype.props[0].spark_type()).alias(pk), F.col("expected_version").cast("bigint"), *(["_pos"] if "_pos" in batch.columns else [])), pk)
    before = F.max(F.when((F.col("status") == "ok"), 1)).over(Window.partitionBy(pk).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("status", F.when(before == 1, "not_found").otherwise(F.col("status")))
    status = rows.select(F.col(pk).alias("pk"), "status", F.when(F.col("status") == "conflict", F.col("_now")).alias("current_version"))
    gone = t.df.join(rows.where("status = 'ok'").select("_okey"), "_okey", "left_semi")
    return Done(status, changed(gone, t, live=False))
