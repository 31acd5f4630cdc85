"""Bulk import into a new type, and bulk append behind its largest key. All checks come before any row is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import BadRow, DuplicateKey, NotAppendable, TypeNotEmpty, UnsupportedForBulk
from ..schema import LINKS
from . import dml
from .ranking import in_order, numbered, parts, rising
from .table import Table, changed


def _check_width(t: Table, rows: DataFrame) -> None:
    if [c for c in rows.columns if c != "_pos"] != t.otype.names:
        raise BadRow(f"columns must be {t.otype.names}")


def bulk_import(t: Table, rows: DataFrame, version: int) -> DataFrame:
    """Changes that fill a type that never had rows; object keys follow next_key in the order of the primary key. One shuffle: rows sorted by key show their
    duplicates, and the sorted rows are numbered by partition."""
    if t.next_row:
        raise TypeNotEmpty(t.otype.name)
    if any(p.kind in LINKS for p in t.otype.props):
        raise UnsupportedForBulk("types with links take rows one batch at a time")
    _check_width(t, rows)
    pk = t.otype.pk
    sorted_rows = in_order(rows.select(*dml.stored_row(t, rows)), [pk], F.count("*").over(Window.partitionBy(pk)).alias("_same"))
    per = parts(sorted_rows, F.max("_same").alias("same"))
    if any(r["same"] > 1 for r in per):
        raise DuplicateKey(t.otype.name)
    return _placed(t, sorted_rows.drop("_same"), per, version)


def _placed(t: Table, sorted_rows: DataFrame, per: list[Row], version: int) -> DataFrame:
    ranked = numbered(sorted_rows, per)
    return changed(ranked.withColumn("_okey", F.col("_rank") + F.lit(t.next_key)).withColumn("_version", F.lit(version).cast("bigint")), t)


def appendable(t: Table, rows: DataFrame) -> tuple[DataFrame, list[Row]]:
    """rows(_pos, properties) in input order, and their parts(), if they can go behind what is there: no index or link to keep, keys ascending and above the largest key."""
    _check_width(t, rows)
    if any(p.indexed or p.kind in LINKS for p in t.otype.props):
        raise NotAppendable("an indexed or link property needs the row-wise path")
    pk = t.otype.pk
    sorted_rows = in_order(rows.select(*dml.stored_row(t, rows), "_pos"), ["_pos"])
    per, fine, first = rising(sorted_rows, pk)
    if not fine:
        raise NotAppendable("keys don't rise strictly in input order")
    top = t.df.agg(F.max(pk)).first()[0]
    if first is not None and top is not None and first <= top:
        raise NotAppendable("a key is at or below the largest key")
    return sorted_rows, per


def bulk_append(t: Table, rows: DataFrame, version: int) -> DataFrame:
    """Changes that append rows(_pos, properties); object keys follow next_key in input order. No rows, no changes."""
    return _placed(t, *appendable(t, rows), version)


def bulk_append_or_insert(t: Table, rows: DataFrame, version: int) -> DataFrame:
    """bulk_append, or the row-wise insert in input order where that can't be; a key that is there or comes twice is an error."""
    try:
        return bulk_append(t, rows, version)
    except NotAppendable:
        done = dml.insert(t, rows, version)
        if not done.status.where("status = 'duplicate'").isEmpty():
            raise DuplicateKey(t.otype.name) from None
        return done.changes
