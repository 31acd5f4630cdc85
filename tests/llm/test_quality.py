import os
import random
import re

import numpy as np
import pytest

from tabulon.llm import quality as Q


def test_statistics_against_plain_python(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "Ab cd. Ab\n12, é!"] + ["".join(rng.choice("aB é1.,!|#*\n\t") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in df.select("doc_id", *(v.alias(k) for k, v in Q.statistics(Q.F.col("text")).items())).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = {"chars": len(t), "words": len(w), "kinds": len(set(w)), "octets": len(t.encode()), "n_upper": sum(c.isupper() for c in t), "n_line": t.count("\n"), "n_mark": sum(c in "|#*" for c in t)}
        assert {k: r[k] for k in want} == want


def test_compiled_rules_score_as_the_matrix(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "An", "x***", "YES!!", "|"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score int")
    got = Q.with_shares(df, "text", ["doc_id"]).select("_k.*", "_s.*").toPandas().sort_values("doc_id")
    names = [c for c in got.columns if c != "doc_id"]
    x = got[names].to_numpy(float)
    y = (np.array([t.count("***") + t.count("!!") for t in texts]) < 8).astype(float)
    m = Q.fit_rules(x, y, names)
    z = Q.rule_matrix(x, names, m.rules).astype(float) @ m.weights + m.intercept
    out = {r.doc_id: r.score for r in Q.score(df, m).collect()}
    assert np.allclose([out[i] for i in range(400)], 1 / (1 + np.exp(-z))) and 0 < len(m.rules) < 200
    assert np.mean((z > 0) == (y > 0.5)) > 0.93
    kept = Q.accepted(df, m, 0.3)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in out.items() if s >= 0.3} and kept.columns == df.columns
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1 and plan.count("regexp_extract_all") <= len(Q._COUNTS)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    a = (rng.random((300, 12)) < 0.4).astype(np.float32)
    y = (a[:, 0] + 0.5 * a[:, 1] + rng.normal(size=300) * 0.3 > 0.6).astype(float)
    w = Q.lasso_logistic(a, y, 0.02, steps=4000)
    g = a.T @ (1 / (1 + np.exp(-(a @ w[:-1] + w[-1]))) - y) / 300
    assert np.all(np.abs(g) < 0.02 + 1e-3) and np.all(np.abs(g[w[:-1] != 0] + 0.02 * np.sign(w[:-1][w[:-1] != 0])) < 1e-3)
    assert (w[:-1] == 0).sum() >= 6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = Q.train(docs, labels)
    got = Q.score(docs, m, keep=["doc_id"]).where(Q.held_out(Q.F.col("doc_id"))).join(labels, "doc_id").select("score", "quality").toPandas()
    s, y = got["score"].to_numpy(), got["quality"].to_numpy()
    auc = np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))
    print(len(m.rules), auc, np.mean((s >= 0.3) == y), np.mean(s[y == 1] >= 0.3), np.mean(s[y == 0] < 0.3))
    assert auc > 0.9 and np.mean(s[y == 1] >= 0.3) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x " * 100_000, "c")], "doc_id bigint, text string, _s string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, quality int")
    m = Q.train(docs, labels)
    out = Q.score(docs, m).collect()
    assert len(out) == 3 and all(0 <= r.score <= 1 for r in out) and out[0]._s in "abc"
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels.limit(0))).count() == 0
