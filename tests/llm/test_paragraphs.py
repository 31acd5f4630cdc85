import random

import numpy as np

from tabulon.llm import paragraphs as P


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def cut_words(text):
    """Paragraphs as tuples of words, through the class's bounds."""
    w = text.lower().split()
    c = P.Cut(text)
    return [tuple(w[a:b]) for a, b in zip(c.start, c.end)], c


def shingle_set(p):
    return {p[i : i + 5] for i in range(len(p) - 4)} or {p}


def brute(rows, least=0.8, min_words=16):
    paras = {(d, i): p for d, t in rows if d is not None for i, p in enumerate(cut_words(t or "")[0])}
    kinds = sorted(set(paras.values()))
    sets = [shingle_set(p) for p in kinds]
    root = list(range(len(kinds)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    cls = {place: find(kinds.index(p)) for place, p in paras.items()}
    count = {}
    for c in cls.values():
        count[c] = count.get(c, 0) + 1
    rep = sorted(place for place, c in cls.items() if count[c] > 1)
    out, run = set(), []
    for place in [*rep, (None, None)]:
        if run and (place[0] != run[-1][0] or place[1] != run[-1][1] + 1):
            if sum(len(paras[x]) for x in run) >= min_words:
                out |= set(run)
            run = []
        run.append(place)
    firsts = {}
    for place in sorted(cls):
        firsts.setdefault(cls[place], place)
    return {(place, cls[place], firsts[cls[place]] == place) for place in out}


def test_against_brute_force(spark):
    rng = random.Random(1)
    shared = [" ".join(words(rng, 60)) for _ in range(5)]
    long = [words(rng, 30) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines[0] += " " + rng.choice(shared) + " " + " ".join(words(rng, 9))
        if i % 4 == 0:
            w = rng.choice(long)[: rng.choice([28, 29, 30])]
            lines.append(" ".join(w))
        if i % 5 == 0:
            lines.append("a stock line of few words")
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, rows[3][1])]
    got = P.repeated_paragraphs(spark.createDataFrame(rows, "doc_id bigint, text string"), recall=0.9999).collect()
    want = brute(rows)
    assert {((r.doc, r.para), r.kept) for r in got} == {(p, k) for p, _, k in want} and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.component_id, set()).add((r.doc, r.para))
    wanted = {}
    for p, c, _ in want:
        wanted.setdefault(c, set()).add(p)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, wanted.values()))


def test_passages_inside_lines_are_caught_and_clean_texts_left(spark):
    rng = random.Random(2)
    rows, planted = [], set()
    for i in range(400):
        w = words(rng, rng.randint(80, 300))
        rows.append([i, w])
    for k in range(60):
        passage = words(rng, rng.randint(52, 90))
        for i in rng.sample(range(300), 2):
            at = rng.randrange(len(rows[i][1]))
            rows[i][1][at:at] = passage
            planted.add(i)
    got = P.repeated_paragraphs(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    found = {r.doc for r in got}
    assert len(found & planted) >= 0.97 * len(planted) and not found - planted


def test_blocks_and_forest(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = random.Random(3)
    sets = [sorted(set(range(40)) - {rng.randrange(40), rng.randrange(40)}) for _ in range(60)] + [list(range(100, 140))]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sets)], "key bigint, h bigint, shingles array<bigint>")
    comp = {r.node: r.component for r in P.connected_components(P.verified_links(df.select("key", "h"), df.select("h", "shingles"), 0.8)).collect()}
    assert set(comp) == set(range(60)) and set(comp.values()) == {0}
    assert len(P.near_links(np.array([1, 2, 1, 2, 1, 2]), np.array([0, 2, 4, 6]), np.arange(3), 0.8)[0]) == 2
    assert P.bands_for(0.8, 0.95) == 3


def test_removal(spark):
    rng = random.Random(4)
    a, b = " ".join(words(rng, 20)), " ".join(words(rng, 20))
    rows = [(1, f"{a}\n{b}", 5), (2, f"x  y\n {a}\nz", 6), (3, None, 7)]
    out = {r.doc_id: (r.text, r.para) for r in P.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, para int")).collect()}
    assert out == {1: (f"{a}\n{b}", 5), 2: ("x  y\n \nz", 6), 3: (None, 7)}


def test_edges(spark):
    t = "doc_id bigint, text string, line int, h string"
    assert P.repeated_paragraphs(spark.createDataFrame([], t)).count() == 0
    rng = random.Random(5)
    line = " ".join(words(rng, 30))
    rows = [(None, line, 1, "x"), (1, line, 1, "x"), (1, line, 1, "x"), (2, "w " * 150_000, 1, "x"), (3, None, 1, "x")]
    got = P.repeated_paragraphs(spark.createDataFrame(rows, t)).collect()
    assert {r.doc for r in got} == {1, 2} and sum(r.doc == 1 for r in got) == 2


def test_registered_query_loses_no_pair_at_the_similarity(spark, tmp_path):
    from tabulon.llm.queries import op4_substring_dedup

    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = words(rng, 24)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[2:], *words(rng, 2)]))]  # 18 of 22 shingles shared
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_substring_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(800)) and sum(r.kept for r in got) == 400


def test_near_copies_of_long_lines(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        w = words(rng, 100)
        v = list(w)
        v[25], v[75] = "edited", "twice"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, f"own {i}\n" + " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in P.remove_repeats(df).collect()}
    assert all(out[2 * i] == rows[2 * i][1] and out[2 * i + 1] == f"own {i}\n" for i in range(60))


def test_a_short_line_and_a_longer_near_copy(spark):
    rng = random.Random(8)
    w = words(rng, 36)
    got = P.repeated_paragraphs(spark.createDataFrame([(1, " ".join(w[:31])), (2, " ".join(w))], "doc_id bigint, text string")).collect()
    assert {(r.doc, r.first_word, r.words, r.kept) for r in got} >= {(1, 0, 31, True), (2, 0, 36, False)}
