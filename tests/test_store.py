"""The versioned store: rows, links, graph deletes, bulk, migration, time travel, crashes, upkeep, facade, streams."""

import pytest
from pyspark.sql import functions as F

from tabulon import errors as E
from tabulon.facade import BAD_ARGS, DUPLICATE, NOT_EMPTY, NOT_FOUND, OK, Database
from tabulon.functions import collections as C
from tabulon.operators import links, maintain, query
from tabulon.plans.predicates import Op, Predicate
from tabulon.schema import Elem, Kind, ObjectType, Prop, Rule, of_ints
from tabulon.sources.store import Store, WriteTxn
from tabulon.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"{tmp_path}/db")


def rows(t, *names):
    return sorted((tuple(r) for r in t.df.select(*(names or t.otype.names)).collect()), key=repr)


def status(df):
    return [r["status"] for r in df.orderBy("pk", "status").collect()]


def test_versions_and_concurrency(store):
    assert store.version == 1
    with store.begin_write() as w:
        w.add_type(of_ints("t", 3))
        assert [r["okey"] for r in w.insert(0, [(100, 7, 1), (200, 8, 0)]).orderBy("okey").collect()] == [0, 1]
        assert w.commit() == 2
    with store.begin_write() as w:
        assert status(w.insert(0, [(100, 1, 1), (300, 1, 1), (300, 2, 2)])) == ["duplicate", "duplicate", "ok"]
        with pytest.raises(E.WouldBlock):
            store.begin_write_try()
        assert status(w.update(0, [(100, 77, 1, 2), (200, 0, 0, 9), (999, 0, 0, 2)])) == ["ok", "conflict", "not_found"]
        assert status(w.update(0, [(100, 78, 1, 2)])) == ["conflict"] and status(w.update(0, [(100, 79, 1, 3)])) == ["ok"]
        w.commit()
    with store.begin_write() as w:
        assert status(w.delete(0, [(200, 3)])) == ["conflict"] and status(w.delete(0, [(200, 2), (200, 2)])) == ["not_found", "ok"]
        assert w.insert(0, [(200, 5, 5)]).first()["okey"] == 3  # object keys don't come again
        w.commit()
    with store.begin_read() as r:
        assert rows(r.table(0), "_okey", "p0", "p1", "_version") == [(0, 100, 79, 3), (2, 300, 1, 3), (3, 200, 5, 4)] and r.live_count(0) == 3
        assert r.type_count() == 1 and not r.is_embedded(0)
        with pytest.raises(E.NoSuchType):
            r.table(1)


def test_against_a_plain_map(store):
    pks = [(i * 2654435761) % 5000011 for i in range(3000)]
    with store.begin_write() as w:
        w.add_type(of_ints("t", 2))
        w.insert(0, [(k, i) for i, k in enumerate(pks)])
        w.commit()
    with store.begin_write() as w:
        w.update(0, [(k, i + 1, None) for i, k in enumerate(pks) if i % 5 == 0])
        w.delete(0, [(k, None) for i, k in enumerate(pks) if i % 5 and i % 7 == 0])
        w.commit()
    want = sorted(((k, i + (i % 5 == 0)) for i, k in enumerate(pks) if i % 5 == 0 or i % 7), key=repr)
    with Store.open(store.spark, store.path).begin_read() as r:
        assert rows(r.table(0)) == want and r.live_count(0) == len(want)
        before = rows(r.table(0), "_okey", "_version", "p0", "p1")
    store.compact(0)
    with store.begin_read() as r:
        assert rows(r.table(0), "_okey", "_version", "p0", "p1") == before and not r.types[0].delta
        plan = query.where(r.table(0), [Predicate(1, Op.EQ, 7)], ordered=False)._jdf.queryExecution().toString()
        assert "EqualTo(c1,7)" in plan


def world(store, author_rule=Rule.NULLIFY):
    author = ObjectType("author", (Prop("pk"), Prop("name", Kind.BLOB)))
    book = ObjectType("book", (Prop("pk"), Prop("author", Kind.LINK, target=0, rule=author_rule), Prop("seen", Kind.LINK_SET, target=0)))
    with store.begin_write() as w:
        w.add_type(author)
        w.add_type(book)
        w.insert(0, [(1, b"Ada"), (2, b"Bo")])
        w.insert(1, [(1, 0, [0, 1, 0]), (2, 0, []), (3, None, [1])])
        w.commit()


def test_links_and_nullify(store):
    world(store)
    with store.begin_read() as r:
        a, b = r.tables()
        assert {tuple(x) for x in links.follow(b, "author", a).select("pk", F.col("to_name").cast("string")).collect()} == {(1, "Ada"), (2, "Ada"), (3, None)}
        assert {tuple(x) for x in links.backlink_counts(b, "author", a).collect()} == {(0, 2), (1, 0)}
        assert [tuple(x) for x in links.backlinks(b, "seen", ordered=True).collect()] == [(0, 0), (1, 0), (1, 2)]
        assert {tuple(x) for x in links.resolve_link(b, "author").collect()} == {(0, 0, 0), (1, 0, 0)}
    with store.begin_write() as w:
        assert w.set_link(1, "author", w.store.spark.createDataFrame([(1, 0), (2, 1), (9, 1)], "pk bigint, target bigint")) == 1
        assert w.link_set_add(1, "seen", w.store.spark.createDataFrame([(1, 1), (2, 1)], "pk bigint, target bigint")) == 1
        assert w.link_set_remove(1, "seen", w.store.spark.createDataFrame([(2, 0), (3, 1)], "pk bigint, target bigint")) == 1
        w.commit()
    with store.begin_write() as w:
        assert status(w.delete_graph(0, [(1, 2)])) == ["ok"]
        w.commit()
    with store.begin_read() as r:
        assert rows(r.table(1), "pk", "author", "seen", "_version") == [(1, None, [1], 2), (2, 1, [1], 3), (3, None, [], 3)]
        assert r.live_count(0) == 1 and store.verify_integrity().count() == 0


def test_plain_delete_leaves_links_dangling(store):
    world(store)
    with store.begin_write() as w:
        w.delete(0, [(1, None)])
        w.commit()
    with store.begin_read() as r:
        a, b = r.tables()
        assert links.follow(b, "author", a).where("author IS NOT NULL AND to_pk IS NULL").count() == 2
    assert {(x.problem, x.n) for x in store.verify_integrity().collect()} == {("dangling link author", 2), ("dangling link seen", 1)}


def test_only_links_to_the_deleted_type_are_cleared(spark, store):
    a = ObjectType("a", (Prop("pk"), Prop("to_a", Kind.LINK, target=0), Prop("to_b", Kind.LINK, target=1)))
    with store.begin_write() as w:
        w.add_type(a)
        w.add_type(of_ints("b", 1))
        w.insert(0, [(1, None, None), (2, 0, 0)])
        w.insert(1, [(7,)])
        w.delete_graph(0, [(1, None)])
        assert rows(w.table(0)) == [(2, None, 0)]


def test_block(store):
    world(store, Rule.BLOCK)
    with store.begin_write() as w:
        assert status(w.delete_graph(0, [(1, 9), (5, 2)])) == ["conflict", "not_found"] and status(w.delete_graph(0, [(1, 2), (2, 2)])) == ["blocked", "ok"]
        w.delete_graph(1, [(1, None), (2, None)])
        assert status(w.delete_graph(0, [(1, 2)])) == ["ok"]


def test_cascade_over_sets_and_cycles(store):
    with store.begin_write() as w:
        w.add_type(ObjectType("parent", (Prop("pk"), Prop("kids", Kind.LINK_SET, target=1, rule=Rule.CASCADE))))
        w.add_type(of_ints("kid", 1))
        w.add_type(ObjectType("node", (Prop("pk"), Prop("next", Kind.LINK, target=2, rule=Rule.CASCADE))))
        w.insert(1, [(10,), (20,), (30,), (40,)])
        w.insert(0, [(1, [0, 1, 2])])
        w.insert(2, [(1, 1), (2, 0), (3, None)])
        w.delete_graph(0, [(1, None)])
        w.delete_graph(2, [(1, None)])
        assert rows(w.table(1)) == [(40,)] and rows(w.table(0)) == [] and rows(w.table(2)) == [(3, None)]


def test_embedded_children(spark, store):
    with store.begin_write() as w:
        w.add_type(ObjectType("owner", (Prop("pk"), Prop("child", Kind.LINK, target=1, rule=Rule.CASCADE))))
        w.add_type(ObjectType("child", (Prop("pk"), Prop("note", Kind.BLOB)), embedded=True))
        w.insert(0, [(1, None), (2, None)])
        give = lambda *r: spark.createDataFrame(list(r), "owner_pk bigint, pk bigint, note binary")
        told = lambda df: sorted((r.owner_pk, r.status) for r in df.collect())
        assert told(w.insert_embedded(0, "child", give((1, 5, b"a"), (9, 6, b"b")))) == [(1, "ok"), (9, "not_found")]
        assert rows(w.table(0), "pk", "child") == [(1, 0), (2, None)]
        assert told(w.insert_embedded(0, "child", give((1, 7, b"c")))) == [(1, "ok")]
        assert [(r.pk, bytes(r.note)) for r in w.table(1).df.collect()] == [(7, b"c")] and rows(w.table(0), "pk", "child") == [(1, 1), (2, None)]
        w.clear_embedded(0, "child", spark.createDataFrame([(1,), (2,)], "owner_pk bigint"))
        assert rows(w.table(1)) == [] and rows(w.table(0)) == [(1, None), (2, None)]
        w.insert_embedded(0, "child", give((2, 8, b"d")))
        w.delete_graph(0, [(2, None)])
        assert rows(w.table(1)) == []
        w.commit()


def test_collections_change_versions_only_where_values_change(spark, store):
    ty = ObjectType("t", (Prop("pk"), Prop("l", Kind.LIST), Prop("s", Kind.SET), Prop("d", Kind.DICT), Prop("b", Kind.SET, Elem.BLOB)))
    with store.begin_write() as w:
        w.add_type(ty)
        w.insert(0, [(1, [3, 3], [2, 1, 2], {b"a": 1}, [b"y", b"x", b"y"]), (2, None, None, None, None)])
        w.commit()
    with store.begin_write() as w:
        v = F.lit(1).cast("bigint")
        assert w.change_collection(0, "s", [1], lambda c: C.set_add(c, v)) == 0 and w.change_collection(0, "s", [2], lambda c: C.set_add(c, v)) == 1
        assert w.change_collection(0, "d", [1], lambda c: C.dict_put(c, F.lit(b"a"), v), always=True) == 1
        with pytest.raises(KeyError):
            w.change_collection(0, "l", [9], lambda c: C.list_append(c, v))
        w.commit()
    with store.begin_read() as r:
        got = {x.pk: x for x in r.table(0).df.collect()}
        assert (got[1].l, got[1].s, [(bytes(k), v) for k, v in got[1].d.items()], got[1]._version) == ([3, 3], [1, 2], [(b"a", 1)], 3)
        assert [bytes(x) for x in got[1].b] == [b"x", b"y"] and (got[2].l, got[2].s, got[2]._version) == ([], [1], 3)


def test_bulk_is_the_same_as_row_by_row(store):
    data = [(k, k * 3, k % 50) for k in sorted(range(2000), key=lambda k: (k * 7919) % 2003)]
    ty = ObjectType("t", (Prop("pk"), Prop("v"), Prop("cat", indexed=True)))
    with store.begin_write() as w:
        w.add_type(ty)
        w.add_type(ty)
        assert w.bulk_import(0, data) == 2000
        w.insert(1, sorted(data))
        assert rows(w.table(0), "_okey", "_version", "pk", "v", "cat") == rows(w.table(1), "_okey", "_version", "pk", "v", "cat")
        assert query.count_where(w.table(0), [Predicate("cat", Op.EQ, 7)]).first()[0] == 40
        with pytest.raises(E.TypeNotEmpty):
            w.bulk_import(0, data)
        w.add_type(ObjectType("links", (Prop("pk"), Prop("to", Kind.LINK))))
        with pytest.raises(E.UnsupportedForBulk):
            w.bulk_import(2, [(1, None)])
        w.add_type(of_ints("twice", 1))
        with pytest.raises(E.DuplicateKey):
            w.bulk_import(3, [(1,), (1,)])


def test_append_or_insert(store):
    with store.begin_write() as w:
        w.add_type(of_ints("t", 2))
        w.add_type(ObjectType("i", (Prop("pk"), Prop("v", indexed=True))))
        assert w.bulk_append(0, [(1, 1), (5, 5)]) == 2 and w.bulk_append(0, []) == 0 and w.bulk_append(0, [(6, 0), (9, 0)]) == 2
        for bad in ([(9, 1)], [(11, 1), (10, 1)], [(12, 1), (12, 1)]):
            with pytest.raises(E.NotAppendable):
                w.bulk_append(0, bad)
        with pytest.raises(E.NotAppendable):
            w.bulk_append(1, [(1, 1)])
        assert w.bulk_append_or_insert(0, [(4, 0), (2, 0)]) == 2
        assert rows(w.table(0), "_okey", "p0") == [(0, 1), (1, 5), (2, 6), (3, 9), (4, 4), (5, 2)]
        with pytest.raises(E.DuplicateKey):
            w.bulk_append_or_insert(0, [(4, 0), (20, 0)])


def test_migration(store):
    store.set_retain_versions(9)
    with store.begin_write() as w:
        w.add_type(of_ints("t", 2))
        w.insert(0, [(1, 10), (2, 20)])
        w.commit()
    with store.begin_write() as w:
        w.add_property(0, Prop("extra"), 7)
        w.add_property(0, Prop("tags", Kind.SET))
        w.insert(0, [(3, 30, 99, [1])])
        w.remove_property(0, 1)
        w.add_property(0, Prop("p1"), 5)
        w.commit()
    with store.begin_read() as r:
        assert rows(r.table(0)) == [(1, 7, [], 5), (2, 7, [], 5), (3, 99, [1], 5)] and r.table(0).otype.names == ["p0", "extra", "tags", "p1"]
    with store.read_at(2) as r:
        assert rows(r.table(0)) == [(1, 10), (2, 20)]
    with pytest.raises(E.SchemaMismatch):
        maintain.remove_property(r.table(0), 0)


def test_time_travel_and_retention(store):
    made = []
    for k in range(3):
        with store.begin_write() as w:
            if not k:
                w.add_type(of_ints("t", 1))
            w.insert(0, [(k,)])
            made.append(w.commit())
    with pytest.raises(E.VersionUnavailable):
        store.read_at(made[0])
    store.set_retain_versions(2**64)
    for k, v in enumerate(made):
        with store.read_at(v) as r:
            assert r.table(0).df.count() == k + 1 == r.live_count(0)
    with pytest.raises(E.VersionUnavailable):
        store.read_at(made[-1] + 1)
    assert store.oldest_readable_version() == 1 == store.oldest_ring_version() and store.has_version(made[1]) and not store.has_version(99)
    store.set_retain_versions(0)
    held = store.begin_read()
    assert store.oldest_pinned_version() == made[-1]
    held.end()
    store.vacuum()
    with store.begin_read() as r:
        assert r.table(0).df.count() == 3
    store.set_retain_versions(9)
    with pytest.raises(E.VersionUnavailable):
        store.read_at(made[0])


@pytest.mark.parametrize("step", ["files", "manifest", "publish"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, step):
    s = Store.create(spark, f"{tmp_path}/db")
    with s.begin_write() as w:
        w.add_type(of_ints("t", 1))
        w.insert(0, [(1,)])
        w.commit()

    def crash(at):
        if at == step:
            raise OSError("no more")

    s.hook = crash
    with s.begin_write() as w:
        w.insert(0, [(2,)])
        with pytest.raises(E.Durability):
            w.commit()
    for again in (s, Store.open(spark, s.path)):
        again.hook = None
        with again.begin_read() as r:
            assert r.version == 2 and rows(r.table(0)) == [(1,)]
    with s.begin_write() as w:
        w.insert(0, [(3,)])
        assert w.commit() == 3
    assert s.vacuum() >= 1 and s.verify_integrity().count() == 0


def test_damage_is_found(spark, store):
    with store.begin_write() as w:
        w.add_type(of_ints("t", 1))
        w.insert(0, [(1,)])
        w.commit()
    f = store.files
    f.delete("_latest")
    f.create("_latest", "{broken")
    assert Store.open(spark, store.path).version == 2  # the newest whole manifest, since the pointer is damaged
    with pytest.raises(E.Corrupt):
        store.verify_integrity()
    store._publish(2)
    with store.begin_read() as r:
        f.delete(r.types[0].base[0])
    with pytest.raises(E.Corrupt):
        store.verify_integrity()
    with pytest.raises(E.Corrupt):
        f.delete("_versions")
        f.delete("_latest")
        Store.open(spark, store.path)


def test_compaction(spark, store, tmp_path):
    ty = ObjectType("t", (Prop("pk"), Prop("b", Kind.BLOB), Prop("l", Kind.LIST), Prop("s", Kind.SET), Prop("to", Kind.LINK), Prop("d", Kind.DICT)))
    with store.begin_write() as w:
        w.add_type(ty)
        w.insert(0, [(1, b"a", [10, 20], [5, 6], None, {b"k": 1}), (2, b"bb", [], [7], 0, {}), (3, b"ccc", [1, 2, 3], [], None, {}), (4, b"", [], [], None, {}), (5, b"", [], [], 1, {})])
        w.commit()
    for pk in (3, 4, 5):
        with store.begin_write() as w:
            w.delete(0, [(pk, None)])
            w.commit()
    assert store.should_compact(0) and store.metrics()["dead_rows"] == 3
    copy = store.compact_to(f"{tmp_path}/copy")
    with copy.begin_read() as a, store.begin_read() as b:
        maintain.verify_equivalent(a.tables(), b.tables())
        assert a.types[0].next_key == 5 and not a.types[0].delta and a.version == b.version
        with pytest.raises(E.CompactionMismatch):
            x = b.tables()
            maintain.verify_equivalent(a.tables(), [type(x[0])(x[0].otype, x[0].df.where("pk <> 1"))])
    step = store.compact_step(0, 2)
    assert step == {"ran": True, "merged": 2, "done": False} and store.compact_step(0, 2)["done"]
    assert store.compact_step(0, 2) == {"ran": False, "merged": 0, "done": True} and not store.should_compact(0)
    store.compact_in_place()
    with store.begin_read() as r:
        assert rows(r.table(0), "pk", "_okey", "to") == [(1, 0, None), (2, 1, 0)]
    with store.begin_write() as w:
        assert w.insert(0, [(3, b"", [], [], None, {})]).first()["okey"] == 5


def test_views_and_large_blobs(spark, store):
    with store.begin_write() as w:
        w.add_type(ObjectType("blobs", (Prop("pk"), Prop("body", Kind.BLOB))))
        w.insert(0, [(1, bytes(i % 251 for i in range(20 << 20))), (2, b"small")])
        w.commit()
    with store.begin_read() as r:
        r.register_views()
        assert [tuple(x) for x in spark.sql("SELECT pk, octet_length(body) FROM blobs ORDER BY pk").collect()] == [(1, 20 << 20), (2, 5)]


def test_facade(spark, tmp_path):
    assert Database.open(spark, "relative", 2) is None
    db = Database.open(spark, f"{tmp_path}/f", 3)
    assert (db.insert([100, 7, 1]), db.insert([100, 1, 1]), db.insert([1]), db.insert([200, 8, 0])) == (0, DUPLICATE, BAD_ARGS, 1)
    assert db.get(200)[1] == [200, 8, 0] and db.get(9) == (NOT_FOUND, None) and db.count() == 2
    assert (db.update([100, 77, 1]), db.update([5, 5, 5]), db.delete(200), db.delete(200)) == (OK, NOT_FOUND, OK, NOT_FOUND)
    assert db.bulk_append([300, 1, 1, 301, 2, 2], 2, 3) == 2 and db.bulk_insert([1, 1, 1], 1, 3) == NOT_EMPTY and db.bulk_append([1], 1, 3) == BAD_ARGS
    b = db.begin()
    assert (b.insert([5, 5, 5]), b.insert([5, 5, 5]), b.update([5, 6, 6]), b.delete(100), b.commit()) == (4, DUPLICATE, OK, OK, OK)
    b = db.begin()
    b.insert([6, 6, 6])
    b.abort()
    again = Database.open(spark, f"{tmp_path}/f", 9)
    assert again.prop_count == 3 and again.count() == 3 and again.get(5)[1] == [5, 6, 6] and again.total(0) == 5 + 300 + 301


def test_stream_into_a_store(spark, store, tmp_path):
    with store.begin_write() as w:
        w.add_type(of_ints("t", 2))
        w.commit()
    src = f"{tmp_path}/in"
    spark.createDataFrame([(i, i * 2, i) for i in range(20)], "p0 bigint, p1 bigint, ord bigint").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("p0 bigint, p1 bigint, ord bigint").parquet(src)
        ingest(stream, store, 0, f"{tmp_path}/cp", "ord").awaitTermination(60)
    stream = spark.readStream.schema("p0 bigint, p1 bigint, ord bigint").parquet(src)
    ingest(stream, store, 0, f"{tmp_path}/other", "ord").awaitTermination(60)  # replays everything, changes nothing
    with store.begin_read() as r:
        assert rows(r.table(0), "_okey", "p0", "p1") == sorted(((i, i, 2 * i) for i in range(20)), key=repr)


def _type(store, name="t"):
    with store.begin_write() as w:
        w.add_type(of_ints(name, 2))
        w.insert(0, [(1, 1)])
        w.commit()


def test_a_writer_whose_lock_was_broken_cannot_publish(spark, store):
    _type(store)
    slow = store.begin_write()
    slow.insert(0, [(2, 2)])
    store.break_lock()
    other = Store.open(spark, store.path)
    quick = other.begin_write()
    quick.insert(0, [(3, 3)])
    with pytest.raises(E.Durability):
        slow.commit()
    assert other.lock_owner() == quick.owner  # the slow writer left the other's lock alone
    assert quick.commit() == 3
    with Store.open(spark, store.path).begin_read() as r:
        assert rows(r.table(0), "p0") == [(1,), (3,)]
    late = WriteTxn(other, "nobody")
    late.version = 3
    with pytest.raises(E.Durability):
        store._write_manifest(3, late.types)  # a published version is never replaced


def test_compact_in_place_survives_a_crash_between_its_renames(spark, store):
    _type(store)

    def crash(step):
        raise OSError(step)

    store.hook = crash
    with pytest.raises(OSError):
        store.compact_in_place()
    again = Store.open_or_create(spark, store.path)
    with again.begin_read() as r:
        assert rows(r.table(0), "p0", "p1") == [(1, 1)]
    again.compact_in_place()
    with Store.open(spark, store.path).begin_read() as r:
        assert rows(r.table(0), "p0", "p1") == [(1, 1)]


def test_vacuum_keeps_what_another_handle_reads(spark, store):
    _type(store)
    reader = Store.open(spark, store.path)
    snapshot = reader.begin_read()
    assert store.attached() == 1 and store.oldest_pinned_version() == snapshot.version
    for k in range(3):
        store.compact(0)
        store.vacuum()
    assert rows(snapshot.table(0), "p0") == [(1,)]
    snapshot.end()
    assert store.attached() == 0 and store.vacuum() >= 1
    reader.lease_s = -1.0  # a reader that died: its lease ends
    reader.begin_read()
    assert store.attached() == 0


def test_changed_data_is_found(spark, store):
    with store.begin_write() as w:
        w.add_type(ObjectType("t", (Prop("pk"), Prop("d", Kind.DICT), Prop("s", Kind.SET))))
        w.insert(0, [(1, {b"k": 1, b"a": 2}, [3]), (2, {}, [])])
        w.commit()
    with store.begin_read() as r:
        name = r.types[0].base[0]
    assert store.verify_integrity().count() == 0
    path = f"{store.path}/{name}"
    df = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    df.withColumn("c0", F.when(F.col("c0") == 2, 5).otherwise(F.col("c0")).cast("bigint")).write.mode("overwrite").parquet(path)
    with pytest.raises(E.Corrupt):
        store.verify_integrity()


def test_deltas_are_folded_after_commits(spark, store):
    _type(store)
    store.auto_compact = 2
    for k in range(5):
        with store.begin_write() as w:
            w.update(0, [(1, k, None)])
            w.commit()
        with store.begin_read() as r:
            assert len(r.types[0].delta) <= 2 and rows(r.table(0), "p0", "p1") == [(1, k)]


def test_indexed_types_are_laid_out_by_their_index(spark, store):
    with store.begin_write() as w:
        w.add_type(ObjectType("t", (Prop("pk"), Prop("category", indexed=True))))
        w.bulk_import(0, spark.range(20_000).select(F.col("id").alias("pk"), (F.col("id") % 100).alias("category")))
        w.commit()
    with store.begin_read() as r:
        t = r.table(0)
        per_file = t.df.select("category", F.input_file_name().alias("f")).groupBy("f").agg(F.min("category").alias("lo"), F.max("category").alias("hi")).collect()
        spans = sorted((x.lo, x.hi) for x in per_file)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert query.count_where(t, [Predicate("category", Op.EQ, 42)]).first().n == 200
