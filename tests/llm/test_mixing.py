import random

import duckdb

from tabulon.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def rows(n=400):
    rng = random.Random(3)
    srcs = ["src0"] * 6 + ["src1", "src10", "src2", "é", None]
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 300, 900]))), rng.choice(srcs)) for i in range(n)]


def test_against_sql(spark):
    data = rows()
    got = {r.id: (r["size"], r.source_size, r.target, r.taken, r.first_slot, r.n_slots) for r in mixing.mix(docs(spark, data)).taken().collect()}
    con = duckdb.connect()
    import pandas as pd

    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "source"]))
    want = {r[0]: tuple(r[1:]) for r in con.execute(mixing.TAKEN_SQL).fetchall()}
    assert got == want and len(got) == len(data)


def test_targets_and_limits(spark):
    out = mixing.mix(docs(spark, rows())).taken().collect()
    per = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        per.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    total = 1.5 * sum(v[1] for v in per.values())
    assert all(abs(t - got) <= total * 1e-3 + 2 and got <= 2 * n and t <= 2 * n for t, n, got in per.values())
    assert abs(sum(v[0] for v in per.values()) - total) < 1e-6


def test_the_schedule_decides(spark, monkeypatch):
    """A source takes its slots' blocks, whatever their size; another sequence of points gives other words."""
    for block in (3, 64, 700):
        m = mixing.mix(docs(spark, rows()), block_words=block)
        sources = {r.src: r for r in m.sources.collect()}
        got = {r.src: r.w for r in m.segments.groupBy("src").agg(mixing.F.sum("words").alias("w")).collect()}
        for s, r in sources.items():
            assert got.get(s, 0) == r.cap and r.cap <= 2 * r.source_size and (r.cap == r.n_slots * block or r.cap in (int(r.limit), -(-r.target // 1)))
        slots = m.segments.groupBy("slot").agg(mixing.F.sum("words").alias("w"), mixing.F.countDistinct("src").alias("s"), mixing.F.max("src").alias("src")).collect()
        assert all(r.s == 1 and r.w <= block for r in slots) and sum(r.w < block for r in slots) <= len(sources)
    one = {r.id: r.taken for r in mixing.mix(docs(spark, rows()), block_words=700).taken().collect()}
    monkeypatch.setattr(mixing, "PHI", 0.4142135623730951)
    assert one != {r.id: r.taken for r in mixing.mix(docs(spark, rows()), block_words=700).taken().collect()}


def test_a_source_that_no_point_meets(spark):
    data = [(0, "w " * 30, "b")] + [(i, "w " * 5000, "a") for i in range(1, 9)]
    out = mixing.mix(docs(spark, data), weights=(1000, 1), share=1.0, block_words=1000).taken().collect()
    small = next(r for r in out if r.source == "b")
    assert small.target < 60 and small.taken == -(-small.target // 1) and small.n_slots == 2 and small.first_slot > max(r.first_slot or 0 for r in out if r.source == "a")


def test_many_repeats(spark):
    """Where a source may come twelve times, its documents come as often as the mixture asks."""
    data = [(0, "a b c d", "x"), (1, "e f", "x"), (2, "w " * 600, "y")]
    got = [r.doc_id for r in mixing.mixed_documents(docs(spark, data), weights=(1, 10), share=1.1, most=12.0).collect()]
    assert got.count(0) in (10, 11) and got.count(1) in (9, 10, 11, 12) and got.count(2) in (1, 2)


def test_documents_come_in_schedule_order(spark):
    got = [(r.doc_id, r.source) for r in mixing.mixed_documents(docs(spark, rows()), block_words=50).collect()]
    words = {i: len(t.split()) for i, t, _ in rows()}
    head = [g for g in got if words[g[0]]]
    assert got[: len(got) - len(head)] == [g for g in got if not words[g[0]]]  # documents without words come first
    total = {s: sum(words[i] for i, x in head if x == s) for s in {s for _, s in head}}
    for cut in (0.25, 0.5, 0.75):  # every stretch of the mixture has all sources in proportion
        part = head[: int(len(head) * cut)]
        for s in ("src0", "src1"):
            assert abs(sum(words[i] for i, x in part if x == s) / total[s] - sum(words[i] for i, _ in part) / sum(total.values())) < 0.15


def test_schedule_has_low_discrepancy(spark):
    src = spark.createDataFrame([(0, 60_000.0), (1, 30_000.0), (2, 10_000.0)], "src int, target double")
    got = sorted(mixing.schedule(src, 3, 100_000.0, 10).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(10_000))
    n = {0: 0, 1: 0, 2: 0}
    for i, r in enumerate(got):
        assert r.k == n[r.src]
        n[r.src] += 1
        if i > 50:
            assert all(abs(n[s] - (i + 1) * w) < 6 for s, w in ((0, 0.6), (1, 0.3), (2, 0.1)))


def test_edges(spark):
    assert mixing.mix(docs(spark, [])).taken().count() == 0
    odd = spark.createDataFrame([(None, "a b", None, 1), (1, None, "x", 1), (1, "a", "x", 1), (1, "a", "x", 1), (2, "w " * 50_000, "y", 1)], "doc_id bigint, text string, source string, size int")
    out = mixing.mix(odd).taken().collect()
    assert len(out) == 5 and sum(r.taken for r in out) <= 1.5 * sum(r["size"] for r in out)
    assert all(r.taken == 0 for r in mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).taken().collect())
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    own = ["h", "tie", "_row", "row", "size", "src", "slot", "a", "_id", "_n", "_copy", "times"]
    df = spark.createDataFrame([(i, "w " * (i + 1), "s", *range(len(own))) for i in range(4)] + [(None, "w w w", "s", *range(len(own)))] * 3, "doc_id bigint, text string, source string, " + ", ".join(f"{c} int" for c in own))
    got = mixing.mixed_documents(df, share=2.0).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([*map(str, range(4)), *["None"] * 3] * 2) and all(r.times == len(own) - 1 for r in got)
