import random

import corpus_pipeline as C
from tabulon.llm import packing, quality, simhash
from tests.llm import test_lines, test_simhash


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(12, 40))) + "." for _ in range(rng.randint(1, 5)))
    rows = [[i, text(), rng.choice(["en", "de", None]), f"s{i % 4}", 0] for i in range(160)]
    for i in range(100, 120):
        rows[i][1] = rows[i - 100][1]
    for i in range(120, 130):
        rows[i][1] = rows[i - 100][1] + "\n" + text()
    for i in range(130, 150):
        rows[i][1] = " ".join("ab***" for _ in range(50))
    rows[150][1], rows[151][1] = None, ""
    return [(*r[:4], len(r[1] or "")) for r in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 130 <= i < 150), 0) for i in range(0, 160, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before, d = rows, str(tmp_path)
    for name, stage in C.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), d)
        got = [tuple(r) for r in out.collect()]
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
            keep = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
            assert sorted(got) == sorted(r for r in before if r[0] in keep)
            assert not any(130 <= r[0] < 150 for r in got) and sum(r[0] < 130 for r in got) == 130
        elif name == "line_dedup":
            want = test_lines.brute([r[:2] for r in before], 10)
            kept = {i: t for i, (t, _, gone, *_) in want.items() if not gone or (t or "").strip()}
            assert {r[0]: r[1] for r in got} == kept and all(r[4] == len(r[1] or "") for r in got)
            assert not any(100 <= r[0] < 120 for r in got)
        elif name == "near_dedup":
            firsts = {c for _, _, c in test_simhash.brute([r[:2] for r in before])}
            assert sorted(got) == sorted(r for r in before if r[0] in firsts)
        elif name == "mixing":
            assert set(got) <= set(before) and all(1 <= got.count(r) <= 2 for r in set(got))
            size = lambda rs, s: sum(len((r[1] or "").split()) for r in rs if r[3] == s)
            total = sum(size(before, f"s{k}") for k in range(4))
            assert abs(sum(size(got, f"s{k}") for k in range(4)) - 1.5 * total) < 0.1 * total
            assert all(size(got, f"s{k}") <= 2 * size(before, f"s{k}") for k in range(4))
        else:
            encode = packing.encoder(*packing.tokenizer_paths())
            assert sum(r.length for r in out.collect()) == sum(len(encode(r[1] or "")) + 1 for r in before)
            seqs = {}
            for r in out.collect():
                seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for parts in seqs.values():
                parts.sort()
                assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
        if name != "packing":
            assert out.columns == docs.columns
            before = got


def test_run_and_empty_tables(spark, tmp_path):
    rows = corpus()[:40]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)][: len(part)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert (C.run(spark, f"{tmp_path}/{name}").count() > 0) == bool(part)
    assert simhash.SEGMENTS == 4


def test_near_dedup_reaches_the_similarity(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
        v = list(w)
        for k in range(1 + i % 6):  # at six changes 266 of 326 shingles are shared
            v[20 + 50 * k] = f"x{i}y{k}"
        rows += [(2 * i, " ".join(w), "en", "s", 1), (2 * i + 1, " ".join(v), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in C.near_dedup_stage(spark, docs, "").collect()} == set(range(0, 120, 2))
