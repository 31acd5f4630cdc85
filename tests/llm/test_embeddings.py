import numpy as np
import pytest

from tabulon.llm import embeddings as E


def brute(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.all(np.isfinite(v)) and np.any(np.array(v, float))]
    ids, x = [i for i, _ in ok], np.stack([v for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    links = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    comp = {i: i for i, _ in rows}
    for k in np.argsort(ids):
        todo = [k] if comp[ids[k]] == ids[k] else []
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if comp[ids[j]] == ids[j] and ids[j] > ids[k]:
                    comp[ids[j]] = ids[k]
                    todo.append(j)
    return {i: (links.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def data(n, seed, noise=0.02):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 32)).astype(np.float32)
    rows = [v.tolist() for v in base]
    for _ in range(n // 3):
        v = base[rng.integers(n // 10)]
        rows.append((v + rng.normal(size=32) * noise).astype(np.float32).tolist())
    rows += [rows[0]] * 5 + [[3.0 * e for e in rows[1]]]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [2048, 32])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = data(600, 1)
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0] * 31 + [None]), (2004, [float("inf")] + [1.0] * 31), (2005, [])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows) and len(got) == len(rows)


def test_recall_near_the_limit(spark):
    """Pairs whose cosine is scattered around the limit: at least 0.9 of the true links are found, and none below it."""
    rows = data(1500, 2, noise=0.26)
    want = brute(rows)
    got = {r.id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    true = sum(n for n, _, _ in want.values())
    assert all(got[i] <= want[i][0] for i in got) and sum(got.values()) >= 0.97 * true > 100


def test_two_levels_of_lists(spark):
    """A list of sixteen members on average asks for a second level; recall stays."""
    rows = data(1500, 3, noise=0.1)
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    sample = E.unit_rows(np.array([v for _, v in rows]))
    index = E.fit_index(sample, len(rows), list_rows=16)
    assert len(index.fine) > 1 and (index.home(sample) < len(index.coarse) * len(index.fine)).all()
    got = {r.id: r.n_links for r in E.near_duplicates(df, list_rows=1).collect()}
    true = sum(n for n, _, _ in want.values())
    assert all(got[i] <= want[i][0] for i in got) and sum(got.values()) >= 0.95 * true > 100


@pytest.mark.parametrize("dim", [8, 64, 128, 200])
def test_look_ups_lose_no_link(spark, dim):
    """All lists probed: what is left to lose is the look-ups' alone, at lengths where codes are coarse as well."""
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(150, dim))
    near = base[:100] + rng.normal(size=(100, dim)) * 0.32
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), probes=10_000).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_every_length_has_its_index(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (6, [1.0, 0.01, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [2.0, 0.0])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.id: (r.n_links, r.component_id) for r in got} == {5: (1, 5), 6: (1, 5), 1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_ids_that_are_text(spark):
    got = E.near_duplicates(spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.001]), ("c", [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id string, embedding array<float>")).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == {"b": (1, "a", False), "a": (1, "a", True), "c": (0, "c", True), None: (0, None, True)}


def test_edges(spark):
    t = "vec_id bigint, embedding array<float>, node int, v string"
    assert E.near_duplicates(spark.createDataFrame([], t)).count() == 0
    only_bad = E.near_duplicates(spark.createDataFrame([(1, None, 1, "x"), (2, [0.0], 1, "x")], t)).collect()
    assert [(r.n_links, r.kept) for r in only_bad] == [(0, True)] * 2
    rows = [(None, [1.0, 0.0], 1, "x"), (4, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "x"), (9, [1.0, 0.01], 1, "x"), (7, [1.0], 1, "x"), (8, [1.0], 1, "x")]
    got = E.near_duplicates(spark.createDataFrame(rows, t)).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == {None: (0, None, True), 4: (2, 3, False), 3: (2, 3, True), 9: (2, 3, False), 7: (1, 7, True), 8: (1, 7, False)}
