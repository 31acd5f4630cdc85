"""One object type's rows, and changes to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ObjectType


@dataclass(frozen=True)
class Table:
    """df has _okey, _version and the properties. next_key: the object key that comes next; next_row: rows ever placed since the last
    compaction, the dead ones included."""

    otype: ObjectType
    df: DataFrame
    next_key: int = 0
    next_row: int = 0

    def columns(self) -> list[str]:
        return ["_okey", "_version", *self.otype.names]

    def apply(self, changes: DataFrame) -> DataFrame:
        """The rows after changes(_okey, _version, _live, properties), which has a row for each changed or new object: what isn't changed keeps its
        scan and its pushed filters."""
        kept = self.df.join(changes.select("_okey"), "_okey", "left_anti")
        return kept.select(*self.columns()).unionByName(changes.where("_live").select(*self.columns()))


def changed(df: DataFrame, table: Table, live: bool = True) -> DataFrame:
    return df.select("_okey", "_version", F.lit(live).alias("_live"), *table.otype.names)


def blank(table: Table) -> DataFrame:
    """No changes."""
    return changed(table.df.limit(0), table)
