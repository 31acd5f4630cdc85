"""List, set and dictionary columns: builders, readers and changes, all built-in expressions.

Reads of a null column (no such row) give null. Positions count from 0, and one outside a list is an error, as it is in a change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_list(*items: Column) -> Column:
    return F.array(*items)


def build_set(items: Column) -> Column:
    """Without repeats, ascending; binary members by unsigned bytes."""
    return F.array_sort(F.array_distinct(items))


def build_dict(keys: Column, values: Column) -> Column:
    """The last value of a repeated key stays, whatever spark.sql.mapKeyDedupPolicy says: entries are sorted by key and place, and the last of each key is kept."""
    entry = lambda e, i: F.struct(e["k"].cast("binary").alias("k"), i.alias("i"), e["v"].cast("bigint").alias("v"))
    entries = F.array_sort(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), entry))
    after = F.slice(entries, 2, F.greatest(F.size(entries), F.lit(1)))  # beside each entry the next one, null for the last
    paired = F.filter(F.arrays_zip(entries.alias("e"), after.alias("n")), lambda x: x["n"].isNull() | (x["e"]["k"] != x["n"]["k"]))
    return F.map_from_entries(F.transform(paired, lambda x: F.struct(x["e"]["k"].alias("key"), x["e"]["v"].alias("value"))))


def length(c: Column) -> Column:
    return F.size(c).cast("bigint")


def list_get(c: Column, i: int | Column) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    inside = (i >= 0) & (i < F.size(c))
    return F.when(c.isNull(), F.lit(None)).when(inside, F.get(c, i)).otherwise(F.raise_error(F.lit("index out of bounds")))


def list_append(c: Column, v: Column) -> Column:
    return F.array_append(c, v)


def list_set(c: Column, i: int | Column, v: Column) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    changed = F.transform(c, lambda x, j: F.when(j == i, v).otherwise(x))
    return F.when((i >= 0) & (i < F.size(c)), changed).otherwise(F.raise_error(F.lit("index out of bounds")))


def set_contains(c: Column, v: Column) -> Column:
    return F.array_contains(c, v)


def set_add(c: Column, v: Column) -> Column:
    return F.array_sort(F.array_union(c, F.array(v)))


def set_remove(c: Column, v: Column) -> Column:
    return F.array_remove(c, v)


def dict_get(c: Column, key: Column) -> Column:
    return F.try_element_at(c, key)


def dict_count(c: Column) -> Column:
    return F.cardinality(c).cast("bigint")


def dict_put(c: Column, key: Column, v: Column) -> Column:
    rest = F.map_filter(c, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, v))


def dict_remove(c: Column, key: Column) -> Column:
    return F.map_filter(c, lambda k, _: k != key)


def dict_entries(c: Column) -> Column:
    """(key, value) structs by ascending key bytes."""
    return F.array_sort(F.map_entries(c))


def blob_size(c: Column) -> Column:
    """Bytes; 0 for an empty or missing blob."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")


def blob_read(c: Column, offset: int | Column, n: int | Column) -> Column:
    """At most n bytes from offset (from 0); what is beyond the end isn't there. Null for a missing blob."""
    offset, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, n))
    return F.substring(c, offset + 1, F.greatest(n, F.lit(0)))
