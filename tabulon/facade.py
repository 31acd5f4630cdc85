"""One type of integers behind calls that return codes, each in a commit of its own unless it is inside a transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import BadRow, DuplicateKey, StoreError, TypeNotEmpty, UnsupportedForBulk
from .operators import query
from .schema import of_ints
from .sources.store import Store, WriteTxn

# Fixed values.
OK, GENERIC, NOT_FOUND, BAD_ARGS, CONFLICT, DUPLICATE, NOT_EMPTY, UNSUPPORTED = 0, -1, -2, -3, -4, -5, -6, -7

_CODES = {"ok": OK, "not_found": NOT_FOUND, "conflict": CONFLICT, "duplicate": DUPLICATE}


class Batch:
    """Operations that one commit makes durable together. A failed one leaves the others usable."""

    def __init__(self, db: Database, txn: WriteTxn) -> None:
        self.db, self.txn = db, txn

    def insert(self, vals: Sequence[int]) -> int:
        if len(vals) != self.db.prop_count:
            return BAD_ARGS
        r = self.txn.insert(0, [tuple(vals)]).first()
        return r["okey"] if r["status"] == "ok" else _CODES[r["status"]]

    def update(self, vals: Sequence[int]) -> int:
        if len(vals) != self.db.prop_count:
            return BAD_ARGS
        return _CODES[self.txn.update(0, [(*vals, None)]).first()["status"]]

    def delete(self, pk: int) -> int:
        return _CODES[self.txn.delete(0, [(pk, None)]).first()["status"]]

    def commit(self) -> int:
        try:
            self.txn.commit()
            return OK
        except StoreError:
            return GENERIC

    def abort(self) -> None:
        self.txn.abort()


class Database:
    def __init__(self, store: Store, prop_count: int) -> None:
        self.store, self.prop_count = store, prop_count

    @staticmethod
    def open(spark: SparkSession, path: str, prop_count: int) -> Database | None:
        """An existing store keeps its own number of properties. None for a relative path or a store that can't be read."""
        if not (path.startswith("/") or ":/" in path):
            return None
        try:
            store = Store.open_or_create(spark, path)
            with store.begin_read() as r:
                if r.types:
                    return Database(store, len(r.types[0].otype.props))
            with store.begin_write() as txn:
                txn.add_type(of_ints("objects", prop_count))
                txn.commit()
            return Database(store, prop_count)
        except StoreError:
            return None

    def close(self) -> None:
        self.store.close()

    def _one(self, call) -> int:
        with self.store.begin_write() as txn:
            out = call(Batch(self, txn))
            if out < 0:
                return out
            try:
                txn.commit()
            except StoreError:
                return GENERIC
            return out

    def insert(self, vals: Sequence[int]) -> int:
        """The new object key, or a code."""
        return BAD_ARGS if len(vals) != self.prop_count else self._one(lambda b: b.insert(vals))

    def get(self, pk: int) -> tuple[int, list[int] | None]:
        """(row version, values), or (NOT_FOUND, None)."""
        with self.store.begin_read() as r:
            t = r.table(0)
            row = query.get_by_pk(t, [pk]).first()
            return (row["_version"], [row[n] for n in t.otype.names]) if row else (NOT_FOUND, None)

    def count(self) -> int:
        with self.store.begin_read() as r:
            return r.live_count(0)

    def update(self, vals: Sequence[int]) -> int:
        """Whatever version is there is replaced."""
        return BAD_ARGS if len(vals) != self.prop_count else self._one(lambda b: b.update(vals))

    def delete(self, pk: int) -> int:
        return self._one(lambda b: b.delete(pk))

    def _rows(self, flat: Sequence[int], n_rows: int, n_props: int) -> list[tuple[int, ...]] | None:
        if n_props != self.prop_count or len(flat) != n_rows * n_props:
            return None
        return [tuple(flat[i * n_props : (i + 1) * n_props]) for i in range(n_rows)]

    def _bulk(self, flat: Sequence[int], n_rows: int, n_props: int, how: str) -> int:
        rows = self._rows(flat, n_rows, n_props)
        if rows is None:
            return BAD_ARGS
        try:
            with self.store.begin_write() as txn:
                n = getattr(txn, how)(0, rows)
                txn.commit()
                return n
        except TypeNotEmpty:
            return NOT_EMPTY
        except UnsupportedForBulk:
            return UNSUPPORTED
        except DuplicateKey:
            return DUPLICATE
        except BadRow:
            return BAD_ARGS
        except StoreError:
            return GENERIC

    def bulk_insert(self, flat: Sequence[int], n_rows: int, n_props: int) -> int:
        """Rows imported from one flat sequence, or a code."""
        return self._bulk(flat, n_rows, n_props, "bulk_import")

    def bulk_append(self, flat: Sequence[int], n_rows: int, n_props: int) -> int:
        return self._bulk(flat, n_rows, n_props, "bulk_append_or_insert")

    def begin(self) -> Batch:
        return Batch(self, self.store.begin_write())

    def total(self, prop: int) -> int:
        """The wrapping sum of a property."""
        with self.store.begin_read() as r:
            return int(query.aggregate_int(r.table(0), prop, []).select(F.col("sum")).first()[0])
