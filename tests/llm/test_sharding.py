import random
import zlib

import pytest

from tabulon.llm import common, sharding


def test_against_plain_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(i * 3 - 50, rng.choice([None, "", "é" * rng.randint(0, 40), "x" * rng.randint(0, 300)])) for i in range(700)]
    rng.shuffle(rows)
    got = {r.id: r for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).collect()}
    sizes = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in sorted(rows)]
    total, before, slots = sum(s for _, s, _ in sizes), 0, {}
    for i, s, c in sizes:
        shard = min(6, (2 * before + s) * 7 // (2 * total))
        slot = slots[shard] = slots.get(shard, -1) + 1
        assert (got[i]["size"], got[i].text_crc32, got[i].shard, got[i].slot) == (s, c, shard, slot)
        before += s


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.assign_shards(none).count() == 0
    df = spark.createDataFrame([(None, "a", 1, 2), (None, None, 1, 2), (5, "x" * 100_000, 1, 2), (5, "b", 1, 2), (5, "b", 1, 2)], "doc_id bigint, text string, size int, before int")
    got = sharding.assign_shards(df, 3).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert all({r.slot for r in got if r.shard == s} == set(range(sum(r.shard == s for r in got))) for s in {r.shard for r in got})


def test_one_id_on_a_third_of_all_rows_is_spread(spark):
    rows = [(7 if i % 3 else i, "x" * (i % 50)) for i in range(900)] + [(None, "y")] * 100
    df = common.packed(spark.createDataFrame(rows, "doc_id bigint, text string"), common.F.monotonically_increasing_id().alias("own"))
    parts = common.in_order(common.unpacked(df, ["doc_id", "text"], own=common.F.col("own")), ["doc_id", "text", "own"], 100).groupBy("part").count().collect()
    assert len(parts) > 7 and max(r["count"] for r in parts) < 300
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()
    assert len(got) == 1000 and all({r.slot for r in got if r.shard == s} == set(range(sum(r.shard == s for r in got))) for s in range(5))


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, *range(40)]), i, rng.randint(0, 9)) for i in range(2000)]
    got = common.running_totals(spark.createDataFrame(data, "k int, own int, w int"), ["k", "own"], "w", 30).collect()
    before = 0
    for n, (r, want) in enumerate(zip(sorted(got, key=lambda r: r.nth), sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))):
        assert (r.k, r.own, r.w, r.nth, r.before) == (*want, n, before)
        before += r.w


def test_packed_columns_cannot_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, _row int, x int")
    out = common.unpacked(common.packed(df, common.F.lit(5).alias("x")), df.columns, x=common.F.col("x"), y=common.F.col("x"))
    assert out.columns == ["a.b", "_row", "x", "y"] and tuple(out.first()) == (1, 2, 5, 5)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

        conf = Conf()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())
    Session.sparkContext.master = "local[8]"
    assert common.scratch_dir(Session())
