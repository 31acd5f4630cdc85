"""Deletes over the whole directory of types: block, cascade, nullify; and embedded children."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LINKS, Kind, Rule
from . import dml, links
from .cut import cut
from .table import Table, blank, changed


@dataclass(frozen=True)
class GraphDone:
    """status: (pk, status, current_version); changes: by type id."""

    status: DataFrame
    changes: dict[int, DataFrame]


def blocked(tables: list[Table], type_id: int) -> DataFrame:
    """(_okey) of the type's objects that a block-rule link points at."""
    found = [links.edges(t, p.name).select(F.col("target").alias("_okey")) for t in tables for p in t.otype.links_to(type_id) if p.rule == Rule.BLOCK]
    return reduce(DataFrame.unionAll, found).distinct() if found else tables[type_id].df.select("_okey").limit(0)


def kinds(keys: DataFrame) -> set[int]:
    """The types that keys(_type, ...) names: at most as many as there are."""
    return {r["_type"] for r in keys.select("_type").distinct().collect()}


def reached(tables: list[Table], type_id: int, roots: DataFrame) -> tuple[DataFrame, set[int]]:
    """(_type, _okey): roots(_okey) of a type and all that cascade-rule links own, once each, cycles or not; and the types that can be among them. One round for each level of depth; a round joins its frontier with
    the edges of the types that are in it, and its result is cut from its history in the shared folder."""
    rules = [(i, p) for i, t in enumerate(tables) for p in t.otype.props if p.kind in LINKS and p.rule == Rule.CASCADE]
    seen = front = cut(roots.select(F.lit(type_id).cast("int").alias("_type"), F.col("_okey").cast("bigint").alias("_okey")).distinct())
    types, all_types = {type_id}, {type_id}
    while steps := [(i, p) for i, p in rules if i in types]:
        found = []
        for i, p in steps:
            own = front.where(F.col("_type") == i).select(F.col("_okey").alias("source"))
            there = tables[p.target].df.select(F.col("_okey").alias("target"))
            to = links.edges(tables[i], p.name).join(own, "source", "left_semi").join(there, "target", "left_semi")
            found.append(to.select(F.lit(p.target).alias("_type"), F.col("target").alias("_okey")))
        front = cut(reduce(DataFrame.unionAll, found).distinct().join(seen, ["_type", "_okey"], "left_anti"))
        seen = seen.unionAll(front)
        types = kinds(front)
        all_types |= types
    return seen, all_types


def removal(tables: list[Table], gone: DataFrame, types: set[int]) -> dict[int, DataFrame]:
    """Changes by type that tombstone gone(_type, _okey), of `types`, and clear every link into it. Versions of rows that only lose a link stay. A type
    that is none of these, nor links to one, isn't read."""
    out: dict[int, DataFrame] = {}
    for i, t in enumerate(tables):
        own = gone.where(F.col("_type") == i).select("_okey")
        parts = [changed(t.df.join(own, "_okey", "left_semi"), t, live=False)] if i in types else [blank(t)]
        now = t
        for target in sorted({p.target for p in t.otype.props if p.kind in LINKS} & types):
            hit = links.nullify(now, t.otype.links_to(target), gone.where(F.col("_type") == target).select("_okey"))
            now = Table(t.otype, now.apply(hit), t.next_key, t.next_row)
        if now is not t:
            before = t.df.select("_okey", F.struct(*(p.name for p in t.otype.props if p.kind in LINKS)).alias("_before"))
            after = now.df.join(own, "_okey", "left_anti").join(before, "_okey")
            diff = after.where(~F.struct(*(p.name for p in t.otype.props if p.kind in LINKS)).eqNullSafe(F.col("_before")))
            parts.append(changed(diff, t))
        out[i] = reduce(DataFrame.unionAll, parts)
    return out


def delete_graph(tables: list[Table], type_id: int, batch: DataFrame) -> GraphDone:
    """Deletes batch(pk, expected_version) of a type by the links' rules. A row is not_found, else conflict, else blocked (the object itself only: what a
    cascade reaches is deleted even if block links point at it), else ok."""
    t = tables[type_id]
    done = dml.delete(t, batch)
    stop = blocked(tables, type_id).join(t.df.select("_okey", F.col(t.otype.pk).alias("pk")), "_okey").select("pk", F.lit(True).alias("_stop"))
    status = done.status.join(stop, "pk", "left").withColumn("status", F.when((F.col("status") == "ok") & F.col("_stop"), "blocked").otherwise(F.col("status"))).drop("_stop")
    status = cut(status)
    ok = status.where("status = 'ok'").select("pk").join(t.df.select("_okey", F.col(t.otype.pk).alias("pk")), "pk")
    gone, types = reached(tables, type_id, ok.select("_okey"))
    return GraphDone(status, removal(tables, gone, types))


def owned(tables: list[Table], owner_type: int, prop: str, owners: DataFrame) -> DataFrame:
    """(owner_pk, pk): the children that owners(owner_pk) have through a to-one link."""
    t = tables[owner_type]
    p = t.otype.prop(prop)
    child = tables[p.target]
    own = t.df.select(F.col(t.otype.pk).alias("owner_pk"), F.col(p.name).alias("_child")).join(owners.select("owner_pk").distinct(), "owner_pk", "left_semi")
    return own.join(child.df.select(F.col("_okey").alias("_child"), F.col(child.otype.pk).alias("pk")), "_child").select("owner_pk", "pk")


def clear_embedded(tables: list[Table], owner_type: int, prop: str, owners: DataFrame) -> GraphDone:
    """Deletes the children of owners(owner_pk), with all their own; owners without one stay as they are."""
    p = tables[owner_type].otype.prop(prop)
    if p.kind != Kind.LINK:
        raise ValueError("an embedded child hangs on a to-one link")
    children = owned(tables, owner_type, prop, owners).select("pk", F.lit(None).cast("bigint").alias("expected_version"))
    return delete_graph(tables, p.target, children)


def applied(tables: list[Table], changes: dict[int, DataFrame]) -> list[Table]:
    return [Table(t.otype, cut(t.apply(changes[i])) if i in changes else t.df, t.next_key, t.next_row) for i, t in enumerate(tables)]


def insert_embedded(tables: list[Table], owner_type: int, prop: str, batch: DataFrame, version: int) -> tuple[DataFrame, list[Table]]:
    """Gives each owner of batch(owner_pk, child properties) a new child; a child it has is deleted first. An owner whose child is blocked keeps
    it and gets status blocked, one that isn't there not_found, one whose new child's key is taken duplicate."""
    p = tables[owner_type].otype.prop(prop)
    old = owned(tables, owner_type, prop, batch)
    cleared = clear_embedded(tables, owner_type, prop, batch)
    kept = old.join(cleared.status.where("status <> 'ok'").select("pk"), "pk").select("owner_pk", F.lit("blocked").alias("_held"))
    kept = cut(kept)
    now = applied(tables, cleared.changes)
    owner, child = now[owner_type], now[p.target]
    there = owner.df.select(F.col(owner.otype.pk).alias("owner_pk"), F.lit(True).alias("_there"))
    rows = batch.join(there, "owner_pk", "left").join(kept, "owner_pk", "left")
    rows = cut(rows.withColumn("_held", F.when(F.col("_there").isNull(), "not_found").otherwise(F.col("_held"))))
    free = rows.where(F.col("_held").isNull())
    done = dml.insert(child, free.select(*(c for c in batch.columns if c != "owner_pk")), version)
    status, changes = cut(done.status), cut(done.changes)
    now[p.target] = Table(child.otype, cut(child.apply(changes)), child.next_key + changes.count(), child.next_row)
    pairs = free.select("owner_pk", F.col(child.otype.pk).alias("pk")).join(status.where("status = 'ok'"), "pk")
    link = links.set_link(now[owner_type], prop, pairs.select(F.col("owner_pk").alias("pk"), F.col("okey").alias("target")), version)
    now[owner_type] = Table(owner.otype, cut(now[owner_type].apply(link)), now[owner_type].next_key, now[owner_type].next_row)
    told = rows.select("owner_pk", F.col(child.otype.pk).alias("pk"), "_held").join(status, "pk", "left")
    return told.select("owner_pk", F.coalesce("_held", "status").alias("status")), now
