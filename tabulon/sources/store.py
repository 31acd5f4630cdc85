"""A versioned object store: Parquet files, and one small manifest for each version.

    types/{id}/{file}        Parquet folders: `base` rows, and `delta` rows that replace or delete what came before
    _versions/{n}.json       what version n consists of, with a checksum
    _latest                  the published version; moving it is the commit
    _lock                    held by the writer

A commit writes its files, then the manifest, then moves _latest. If it fails at any point, the old version stays live and readers never see
what was written. Rows of a type are its base files without the keys that deltas name, plus the newest delta row of each key if it is
live: predicates reach the base scan, and a type without deltas is a plain scan. Columns have physical names of their own, so adding or
removing a property rewrites nothing and old versions keep their shape.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Corrupt, Durability, NoSuchType, VersionUnavailable, WouldBlock
from ..operators import bulk, dml, graph, links, maintain
from ..operators.table import Table
from ..schema import Kind, ObjectType, Prop, check_types, type_at
from .files import Files

#: Versions that stay reachable at most.
RING = 128


@dataclass
class TypeState:
    otype: ObjectType
    physical: list[str]
    next_column: int
    next_key: int = 0
    next_row: int = 0
    live: int = 0
    base: list[str] = field(default_factory=list)
    delta: list[str] = field(default_factory=list)
    defaults: dict[str, int] = field(default_factory=dict)
    #: Rows of each file, and a fold of them that doesn't depend on their order.
    sums: dict[str, list[int]] = field(default_factory=dict)

    @staticmethod
    def new(otype: ObjectType) -> TypeState:
        n = len(otype.props)
        return TypeState(otype, [f"c{i}" for i in range(n)], n)

    def to_json(self) -> dict:
        used = {*self.base, *self.delta}
        return self.__dict__ | {"otype": self.otype.to_json(), "sums": {n: v for n, v in self.sums.items() if n in used}}

    @staticmethod
    def from_json(d: dict) -> TypeState:
        return TypeState(**(d | {"otype": ObjectType.from_json(d["otype"])}))


def row_sums(df: DataFrame) -> list[Column]:
    """Count and order-independent fold of all columns; dictionaries by ascending key."""
    cols = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0).cast("bigint")).alias("fold")]


def checksum(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


class Snapshot:
    """One version's types, to read."""

    def __init__(self, store: Store, version: int, types: list[TypeState]) -> None:
        self.store, self.version, self.types = store, version, types

    def table(self, type_id: int) -> Table:
        type_at([t.otype for t in self.types], type_id)
        s = self.types[type_id]
        return Table(s.otype, self.store._rows(s), s.next_key, s.next_row)

    def tables(self) -> list[Table]:
        return [self.table(i) for i in range(len(self.types))]

    def type_count(self) -> int:
        return len(self.types)

    def is_embedded(self, type_id: int) -> bool:
        return type_at([t.otype for t in self.types], type_id).embedded

    def live_count(self, type_id: int) -> int:
        """From the manifest, without a scan."""
        if not 0 <= type_id < len(self.types):
            raise NoSuchType(str(type_id))
        return self.types[type_id].live

    def register_views(self) -> None:
        """Each type as a temporary view, by its name, for Spark SQL."""
        for t in self.tables():
            t.df.createOrReplaceTempView(t.otype.name)

    def end(self) -> None:
        self.store._unpin(self.version)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.end()


class Store:
    """Opened on a folder. `hook(step)` is called before each durable step of a commit ("files", "manifest", "publish"), to simulate crashes."""

    def __init__(self, spark: SparkSession, path: str, hook: Callable[[str], None] | None = None) -> None:
        self.spark, self.path, self.files, self.hook = spark, path.rstrip("/"), Files(spark, path), hook
        self.version, self.retain, self.commits = 0, 0, 0
        self._pinned: list[int] = []
        self.name, self.lease_s = uuid.uuid4().hex, 3600.0
        self._told: int | None = None
        self._lease = 0.0
        #: Delta files that a type may have after a commit before that many of the oldest are folded; 0: never.
        self.auto_compact = 0

    @staticmethod
    def create(spark: SparkSession, path: str, hook: Callable[[str], None] | None = None) -> Store:
        """A new store with version 1 and no types; whatever was in the folder goes."""
        s = Store(spark, path, hook)
        s.files.delete("")
        s.files.make_folder("_versions")
        s._write_manifest(1, [])
        s._publish(1)
        s.version = 1
        return s

    @staticmethod
    def open(spark: SparkSession, path: str, hook: Callable[[str], None] | None = None) -> Store:
        s = Store(spark, path, hook)
        top, _, name = s.path.rpartition("/")
        if not s.files.exists("_versions") and Files(spark, top).exists(f"{name}.old/_versions"):
            Files(spark, top).move(f"{name}.old", name)  # compact_in_place() ended between its renames
        s.refresh()
        return s

    @staticmethod
    def open_or_create(spark: SparkSession, path: str) -> Store:
        there = Files(spark, path).exists("_versions") or Files(spark, f"{path.rstrip('/')}.old").exists("_versions")
        return Store.open(spark, path) if there else Store.create(spark, path)

    # manifests

    def _manifest(self, version: int) -> dict | None:
        try:
            d = json.loads(self.files.read(f"_versions/{version:020d}.json") or "null")
        except ValueError:
            return None
        return d if d and d.get("checksum") == checksum(d["body"]) and d["body"]["version"] == version else None

    def _write_manifest(self, version: int, types: list[TypeState]) -> None:
        body = {"version": version, "types": [t.to_json() for t in types]}
        name, text = f"_versions/{version:020d}.json", json.dumps({"body": body, "checksum": checksum(body)})
        if not self.files.create(name, text):
            if self.files.exists("_latest") and version <= self._published():
                raise Durability(f"version {version} is published")
            self.files.delete(name)  # left by a commit that never published; the writer's lock is held
            if not self.files.create(name, text):
                raise Durability(f"another writer makes version {version}")

    def _publish(self, version: int) -> None:
        self.files.replace("_latest", json.dumps({"version": version, "checksum": checksum({"version": version})}))

    def _published(self) -> int:
        """The pointer, if it is whole; only a damaged one makes the newest valid manifest count."""
        try:
            p = json.loads(self.files.read("_latest") or "null")
            if p and p["checksum"] == checksum({"version": p["version"]}) and self._manifest(p["version"]):
                return p["version"]
        except (ValueError, KeyError, TypeError):
            pass
        for v in reversed(self._versions()):
            if self._manifest(v):
                return v
        raise Corrupt(f"no readable version in {self.path}")

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_versions") if n.endswith(".json") and n[:-5].isdigit()]

    def refresh(self) -> int:
        """The latest published version becomes the current one."""
        self.version = self._published()
        return self.version

    # versions

    def has_version(self, version: int) -> bool:
        return self.oldest_ring_version() <= version <= self.version and self._manifest(version) is not None

    def oldest_ring_version(self) -> int:
        return max(1, self.version - RING + 1)

    def oldest_readable_version(self) -> int:
        return max(self.oldest_ring_version(), self.version - self.retain)

    def set_retain_versions(self, n: int) -> None:
        self.retain = n

    def _pins(self) -> dict[str, int]:
        """The oldest pinned version of each attached reader, other processes' too, whose lease hasn't ended."""
        out = {}
        for n in self.files.names("_pins"):
            try:
                pin = json.loads(self.files.read(f"_pins/{n}") or "{}")
                if pin["until"] > time.time():
                    out[n] = pin["version"]
            except (ValueError, KeyError):  # being written or deleted
                continue
        return out

    def _pin_file(self) -> None:
        """Tells other processes the oldest version that this handle reads, with a lease; nothing while it reads none."""
        now = min(self._pinned) if self._pinned else None
        if now != self._told or now is not None and time.time() > self._lease - self.lease_s / 2:
            self._told, self._lease = now, time.time() + self.lease_s
            if now is None:
                self.files.delete(f"_pins/{self.name}.json")
            else:
                self.files.replace(f"_pins/{self.name}.json", json.dumps({"version": now, "until": self._lease}))

    def _unpin(self, version: int) -> None:
        self._pinned.remove(version)
        self._pin_file()

    def oldest_pinned_version(self) -> int:
        """Of this handle's snapshots and those of every attached process."""
        return min([*self._pinned, *self._pins().values(), self.version])

    def attached(self) -> int:
        """Handles, in any process, that hold a snapshot and whose lease hasn't ended."""
        return len(self._pins())

    def begin_read(self) -> Snapshot:
        return self._snapshot(self.refresh())

    def read_at(self, version: int) -> Snapshot:
        self.refresh()
        if not self.oldest_readable_version() <= version <= self.version:
            raise VersionUnavailable(str(version))
        return self._snapshot(version)

    def _snapshot(self, version: int) -> Snapshot:
        m = self._manifest(version)
        if m is None:
            raise VersionUnavailable(str(version))
        self._pinned.append(version)
        self._pin_file()
        return Snapshot(self, version, [TypeState.from_json(t) for t in m["body"]["types"]])

    # rows

    def _struct(self, s: TypeState, delta: bool) -> T.StructType:
        kinds = dict(zip(s.physical, s.otype.props))
        rows = [T.StructField("_okey", T.LongType()), T.StructField("_version", T.LongType())]
        rows += [T.StructField("_live", T.BooleanType()), T.StructField("_seq", T.LongType())] if delta else []
        return T.StructType(rows + [T.StructField(c, p.spark_type()) for c, p in kinds.items()])

    def _named(self, s: TypeState, df: DataFrame) -> DataFrame:
        """Physical columns by property name; rows older than a property have its default."""
        out = []
        for c, p in zip(s.physical, s.otype.props):
            value = F.col(c)
            if c in s.defaults:
                d = s.defaults[c]
                value = F.when(value.isNull(), F.lit(d).cast(p.spark_type()) if p.kind in (Kind.INT, Kind.LINK) and d is not None else p.empty()).otherwise(value)
            out.append(value.alias(p.name))
        return df.select(*(c for c in df.columns if c.startswith("_")), *out)

    def _rows(self, s: TypeState) -> DataFrame:
        full = lambda names: [f"{self.path}/{n}" for n in names]
        plain = self._struct(s, False)
        base = self.spark.read.schema(plain).parquet(*full(s.base)) if s.base else self.spark.createDataFrame([], plain)
        if s.delta:
            late = self.spark.read.schema(self._struct(s, True)).parquet(*full(s.delta))
            newest = late.withColumn("_r", F.row_number().over(Window.partitionBy("_okey").orderBy(F.col("_seq").desc()))).where("_r = 1").drop("_r", "_seq")
            base = base.join(late.select("_okey").distinct(), "_okey", "left_anti").unionByName(newest.where("_live").drop("_live"))
        return self._named(s, base)

    # writing

    def begin_write(self, wait_s: float = 60.0) -> WriteTxn:
        """The writer's lock, waiting for it."""
        until = time.time() + wait_s
        while True:
            try:
                return self.begin_write_try()
            except WouldBlock:
                if time.time() > until:
                    raise
                time.sleep(0.1)

    def begin_write_try(self) -> WriteTxn:
        owner = uuid.uuid4().hex
        if not self.files.create("_lock", json.dumps({"since": time.time(), "owner": owner})):
            raise WouldBlock(self.path)
        return WriteTxn(self, owner)

    def lock_owner(self) -> str | None:
        try:
            return json.loads(self.files.read("_lock") or "{}").get("owner")
        except ValueError:
            return None

    def break_lock(self) -> None:
        """Frees the lock of a writer that died. If it lives after all, it can't commit any more."""
        self.files.delete("_lock")

    # upkeep

    def vacuum(self) -> int:
        """Deletes manifests and files that no readable or pinned version needs; the number of files deleted. The writer's lock is held meanwhile."""
        with self.begin_write() as txn:
            floor = min(self.oldest_readable_version(), self.oldest_pinned_version())
            keep: set[str] = set()
            for v in self._versions():
                m = self._manifest(v)
                if v < floor or v > self.version or m is None:
                    self.files.delete(f"_versions/{v:020d}.json")
                else:
                    keep |= {n for t in m["body"]["types"] for n in (*t["base"], *t["delta"])}
            gone = [n for i in self.files.names("types") for f in self.files.names(f"types/{i}") if (n := f"types/{i}/{f}") not in keep]
            for n in gone:
                self.files.delete(n)
            txn.abort()
        return len(gone)

    def should_compact(self, type_id: int) -> bool:
        with self.begin_read() as r:
            s = r.types[type_id]
            return maintain.should_compact(s.live, s.next_row)

    def compact(self, type_id: int) -> int:
        """One type's live rows in new files by object key, in a commit of its own."""
        with self.begin_write() as txn:
            txn.compact(type_id)
            return txn.commit()

    def compact_step(self, type_id: int, budget: int) -> dict:
        """Folds at most `budget` delta files, the oldest first, into base files; {ran, merged, done}. Does nothing where there are none
        and should_compact() is false. The deltas' rows decide which base rows go, so a step also reads and rewrites the base; budget bounds the deltas alone."""
        with self.begin_write() as txn:
            s = txn.types[type_id]
            if not s.delta and not maintain.should_compact(s.live, s.next_row):
                txn.abort()
                return {"ran": False, "merged": 0, "done": True}
            part = s.delta[: max(1, budget)]
            rest = s.delta[len(part) :]
            s.delta = part
            df = self._rows(s)
            s.base, s.delta = [txn._put(type_id, df, None)], rest
            if not rest:
                s.next_row = s.live
            txn.commit()
            return {"ran": True, "merged": len(part), "done": not rest}

    def compact_to(self, path: str) -> Store:
        """A new store in path with the live rows of every type, same object keys, versions and next keys; checked before it is published."""
        with self.begin_read() as r:
            new = Store(self.spark, path)
            new.files.delete("")
            new.files.make_folder("_versions")
            states = []
            txn = WriteTxn(new, None)
            for i, s in enumerate(r.types):
                df = maintain.compact(r.table(i)).df
                made = TypeState(s.otype, list(s.physical), s.next_column, s.next_key, s.live, s.live)
                made.base = [txn._put(i, df, None, made)]
                states.append(made)
            copy = Snapshot(new, r.version, states)
            maintain.verify_equivalent(r.tables(), copy.tables())
            new._write_manifest(r.version, states)
            new._publish(r.version)
            new.version = r.version
            return new

    def compact_in_place(self) -> None:
        """compact_to() beside this store; then this one is renamed aside, the new one into its place, and the old one deleted. No other handle may be open. If
        it ends between the renames, the next open() puts the old one back."""
        top, _, name = self.path.rpartition("/")
        beside = f"{name}.{uuid.uuid4().hex}"
        self.compact_to(f"{top}/{beside}")
        up = Files(self.spark, top)
        up.delete(f"{name}.old")
        up.move(name, f"{name}.old")
        if self.hook:
            self.hook("renamed")
        up.move(beside, name)
        up.delete(f"{name}.old")
        self.refresh()

    def verify_integrity(self) -> DataFrame:
        """Corrupt if the pointer, the manifest or a file is damaged or missing, or a counter is off; else the report on keys and links."""
        p = self.files.read("_latest")
        try:
            whole = p is not None and json.loads(p)["checksum"] == checksum({"version": json.loads(p)["version"]})
        except (ValueError, KeyError, TypeError):
            whole = False
        if not whole:
            raise Corrupt("the pointer to the latest version is damaged")
        with self.begin_read() as r:
            if r.version != json.loads(p)["version"]:
                raise Corrupt("the published version can't be read")
            for i, s in enumerate(r.types):
                for n in (*s.base, *s.delta):
                    if not self.files.exists(f"{n}/_SUCCESS"):
                        raise Corrupt(f"{n} is missing")
                    if n in s.sums and self._sums_of(n) != s.sums[n]:
                        raise Corrupt(f"{n} doesn't hold what was written")
                if r.table(i).df.count() != s.live:
                    raise Corrupt(f"type {i} doesn't have {s.live} rows")
            return maintain.integrity_report(r.tables()) if r.types else self.spark.createDataFrame([], "type int, problem string, n bigint")

    def _sums_of(self, name: str) -> list[int]:
        try:
            df = self.spark.read.parquet(f"{self.path}/{name}")
            return list(df.agg(*row_sums(df)).first())
        except Exception as e:
            raise Corrupt(f"{name} can't be read") from e

    def _compact_after(self, txn: WriteTxn) -> None:
        """The step that follows a commit, where auto_compact asks for one."""
        for i, s in enumerate(txn.types if self.auto_compact else []):
            if len(s.delta) > self.auto_compact:
                n, self.auto_compact = self.auto_compact, 0  # its own commit asks for none
                try:
                    self.compact_step(i, n)
                finally:
                    self.auto_compact = n

    def metrics(self) -> dict:
        with self.begin_read() as r:
            return {
                "latest_version": r.version, "oldest_readable_version": self.oldest_readable_version(), "oldest_pinned_version": self.oldest_pinned_version(), "attached": self.attached(), "commit_count": self.commits,
                "bytes": self.files.size(""), "live_bytes": sum(self.files.size(n) for s in r.types for n in (*s.base, *s.delta)),
                "files": sum(len(s.base) + len(s.delta) for s in r.types), "live_rows": sum(s.live for s in r.types), "dead_rows": sum(s.next_row - s.live for s in r.types),
            }

    def close(self) -> None:
        self._pinned.clear()
        self._pin_file()


class WriteTxn:
    """One writer's changes, applied in order and published together by commit(). Reads inside see them. abort() publishes nothing."""

    def __init__(self, store: Store, owner: str | None) -> None:
        """owner: the token in the lock file; None for a store that nobody else knows yet."""
        self.store, self.owner, self.locked, self.seq = store, owner, owner is not None, 0
        if self.locked:
            store.refresh()
            m = store._manifest(store.version)
            self.types = [TypeState.from_json(t) for t in m["body"]["types"]]
        else:
            self.types = []
        self.version = store.version + 1

    def __enter__(self) -> WriteTxn:
        return self

    def __exit__(self, *_) -> None:
        self.abort()

    def table(self, type_id: int) -> Table:
        type_at([t.otype for t in self.types], type_id)
        s = self.types[type_id]
        return Table(s.otype, self.store._rows(s), s.next_key, s.next_row)

    def tables(self) -> list[Table]:
        return [self.table(i) for i in range(len(self.types))]

    # schema

    def add_type(self, otype: ObjectType) -> int:
        check_types([*(t.otype for t in self.types), otype])
        self.types.append(TypeState.new(otype))
        return len(self.types) - 1

    def add_property(self, type_id: int, prop: Prop, default: int | None = 0) -> None:
        """A new last property with a default for the rows that are there: a number for integers, a target or None for links; collections and blobs are empty."""
        s = self.types[type_id]
        s.otype = s.otype.with_property(prop)
        s.physical.append(f"c{s.next_column}")
        s.defaults[f"c{s.next_column}"] = default if prop.kind == Kind.INT else None
        if prop.kind == Kind.LINK and default is not None and default != 0:
            raise ValueError("a new link starts unset")
        s.next_column += 1

    def remove_property(self, type_id: int, at: int) -> None:
        s = self.types[type_id]
        s.otype = s.otype.without_property(at)
        s.defaults.pop(s.physical.pop(at), None)

    # rows

    def _put(self, type_id: int, df: DataFrame, live: bool | None, state: TypeState | None = None) -> str:
        """Writes rows (delta rows if live is given) under physical names; the folder's name."""
        s = state or self.types[type_id]
        name = f"types/{type_id}/{uuid.uuid4().hex}"
        cols = ["_okey", "_version"] + (["_live", "_seq"] if live is not None else [])
        out, seen = df.select(*cols, *(F.col(p.name).alias(c) for p, c in zip(s.otype.props, s.physical))), Observation()
        if live is None and (by := next((c for p, c in zip(s.otype.props, s.physical) if p.indexed), None)):
            out = out.repartitionByRange(by).sortWithinPartitions(by, "_okey")  # files and row groups of narrow ranges, which a predicate on it skips
        out.observe(seen, *row_sums(out)).write.parquet(f"{self.store.path}/{name}")
        s.sums[name] = [seen.get["rows"], seen.get["fold"]]
        return name

    def _new_rows(self, type_id: int, changes: DataFrame) -> int:
        s = self.types[type_id]
        name = self._put(type_id, changes, None)
        n = s.sums[name][0]  # counted while it was written
        if n:
            s.base.append(name)
        s.next_key += n
        s.next_row += n
        s.live += n
        return n

    def apply(self, type_id: int, changes: DataFrame) -> int:
        """Changes to existing rows, as a delta; the number of rows in it."""
        s = self.types[type_id]
        self.seq += 1
        seen = Observation()
        counted = changes.withColumn("_seq", F.lit(self.version * 1_000_000 + self.seq).cast("bigint")).observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("_live"), 1)).alias("dead"))
        name = self._put(type_id, counted, True)
        n, dead = seen.get["n"], seen.get["dead"]
        if n:
            s.delta.append(name)
        s.live -= dead
        return n

    def frame(self, type_id: int, rows: list | DataFrame, extra: str = "") -> DataFrame:
        """Rows given as tuples in property order, as a DataFrame with their position."""
        if isinstance(rows, DataFrame):
            return rows
        props = self.types[type_id].otype.props
        schema = T.StructType([T.StructField(p.name, p.spark_type()) for p in props] + ([T.StructField(extra, T.LongType())] if extra else []) + [T.StructField("_pos", T.LongType())])
        wide = [p.wide and p.kind == Kind.INT for p in props]
        exact = lambda r: [Decimal(v) if i < len(wide) and wide[i] and v is not None else v for i, v in enumerate(r)]
        return self.store.spark.createDataFrame([(*exact(r), i) for i, r in enumerate(rows)], schema)

    def insert(self, type_id: int, rows: list | DataFrame) -> DataFrame:
        done = dml.insert(self.table(type_id), self.frame(type_id, rows), self.version)
        status = graph.cut(done.status)
        self._new_rows(type_id, done.changes)
        return status

    def update(self, type_id: int, rows: list | DataFrame) -> DataFrame:
        """Rows have the properties, then expected_version (None: whatever is there)."""
        done = dml.update(self.table(type_id), self.frame(type_id, rows, "expected_version"), self.version)
        status = graph.cut(done.status)
        self.apply(type_id, done.changes)
        return status

    def _keys(self, rows: list | DataFrame) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.store.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "pk bigint, expected_version bigint, _pos bigint")

    def delete(self, type_id: int, rows: list | DataFrame) -> DataFrame:
        """Rows of (pk, expected_version). Links to the deleted rows are left, and dangle."""
        done = dml.delete(self.table(type_id), self._keys(rows))
        status = graph.cut(done.status)
        self.apply(type_id, done.changes)
        return status

    def delete_graph(self, type_id: int, rows: list | DataFrame) -> DataFrame:
        done = graph.delete_graph(self.tables(), type_id, self._keys(rows))
        self._apply_all(done.changes)
        return done.status

    def _apply_all(self, changes: dict[int, DataFrame]) -> None:
        made = {i: graph.cut(c) for i, c in changes.items()}
        for i, c in made.items():
            self.apply(i, c)

    def clear_embedded(self, owner_type: int, prop: str, owners: DataFrame) -> DataFrame:
        done = graph.clear_embedded(self.tables(), owner_type, prop, owners)
        self._apply_all(done.changes)
        return done.status

    def insert_embedded(self, owner_type: int, prop: str, batch: DataFrame) -> DataFrame:
        """As graph.insert_embedded(), into the transaction."""
        before = self.tables()
        child = before[owner_type].otype.prop(prop).target
        status, after = graph.insert_embedded(before, owner_type, prop, batch, self.version)
        status = graph.cut(status)
        for i, (a, b) in enumerate(zip(before, after)):
            if b.df is a.df:
                continue
            made = b.df.where(F.col("_okey") >= a.next_key) if i == child else b.df.limit(0)
            new = graph.cut(made)
            rows = [p.name for p in a.otype.props]
            same = a.df.select("_okey", F.struct("_version", *rows).alias("_was"))
            old = b.df.where(F.col("_okey") < a.next_key).join(same, "_okey").where(~F.struct("_version", *rows).eqNullSafe(F.col("_was")))
            dead = a.df.join(b.df.select("_okey"), "_okey", "left_anti")
            delta = graph.cut(old.select("_okey", "_version", F.lit(True).alias("_live"), *rows).unionAll(dead.select("_okey", "_version", F.lit(False).alias("_live"), *rows)))
            self.apply(i, delta)
            self._new_rows(i, new)
        return status

    def set_link(self, type_id: int, prop: str, wanted: DataFrame) -> int:
        return self.apply(type_id, links.set_link(self.table(type_id), prop, wanted, self.version))

    def link_set_add(self, type_id: int, prop: str, wanted: DataFrame) -> int:
        return self.apply(type_id, links.link_set_add(self.table(type_id), prop, wanted, self.version))

    def link_set_remove(self, type_id: int, prop: str, wanted: DataFrame) -> int:
        return self.apply(type_id, links.link_set_remove(self.table(type_id), prop, wanted, self.version))

    def change_collection(self, type_id: int, prop: str, pks: list[int], change: Callable, always: bool = False) -> int:
        """Sets prop to change(column) in the rows of pks, which must all be there; the version moves only where the value changes (or always, as a
        dictionary's put does). Returns the rows changed."""
        t = self.table(type_id)
        rows = t.df.where(F.col(t.otype.pk).isin(pks)).withColumn("_new", change(F.col(prop)))
        found = rows.select(t.otype.pk).count()
        if found < len(set(pks)):
            raise KeyError(f"{len(set(pks)) - found} of the keys aren't there")
        p = t.otype.prop(prop)
        same = F.lit(False) if always else p.comparable(F.col(prop)).eqNullSafe(p.comparable(F.col("_new")))
        rows = rows.where(~same).withColumn(prop, F.col("_new")).withColumn("_version", F.lit(self.version).cast("bigint"))
        return self.apply(type_id, rows.select("_okey", "_version", F.lit(True).alias("_live"), *t.otype.names))

    def bulk_import(self, type_id: int, rows: list | DataFrame) -> int:
        df = self.frame(type_id, rows)
        return self._new_rows(type_id, bulk.bulk_import(self.table(type_id), df.drop("_pos"), self.version))

    def bulk_append(self, type_id: int, rows: list | DataFrame) -> int:
        return self._new_rows(type_id, bulk.bulk_append(self.table(type_id), self.frame(type_id, rows), self.version))

    def bulk_append_or_insert(self, type_id: int, rows: list | DataFrame) -> int:
        return self._new_rows(type_id, bulk.bulk_append_or_insert(self.table(type_id), self.frame(type_id, rows), self.version))

    def compact(self, type_id: int) -> None:
        s = self.types[type_id]
        t = maintain.compact(self.table(type_id))
        s.base, s.delta, s.next_row = [self._put(type_id, t.df, None)], [], s.live

    # end

    def _step(self, step: str) -> None:
        if self.store.hook:
            self.store.hook(step)

    def commit(self) -> int:
        """The new version. If a step fails, Durability is raised and the old version stays live."""
        try:
            self._step("files")
            self._own()
            self.store._write_manifest(self.version, self.types)
            self._step("manifest")
            self._step("publish")
            self._own()
            self.store._publish(self.version)
        except Exception as e:
            self.abort()
            raise Durability(str(e)) from e
        self.store.version = self.version
        self.store.commits += 1
        self.abort()
        self.store._compact_after(self)
        return self.version

    def _own(self) -> None:
        if self.locked and self.store.lock_owner() != self.owner:
            raise Durability("the lock was taken away")

    def abort(self) -> None:
        """Frees the lock, if it is still this writer's. What was written stays unreferenced until vacuum()."""
        if self.locked:
            self.locked = False
            if self.store.lock_owner() == self.owner:
                self.store.files.delete("_lock")
