import random

import duckdb
import pyarrow as pa
import pytest

from tabulon.llm import lines as L


def brute(rows, min_words):
    """Every run at every start against every earlier start: {id: (text, lines, removed, runs, longest)}. Rows must have ids of their own."""
    seq = [(d, i, s) for d, t in sorted(r for r in rows if r[0] is not None and r[1] is not None) for i, s in enumerate(t.split("\n"))]
    runs, end = {}, {}
    for p in range(len(seq)):
        best = 0
        for q in range(p):
            n = 0
            while p + n < len(seq) and seq[p + n][0] == seq[p][0] and seq[q + n][0] == seq[q][0] and seq[p + n][2] == seq[q + n][2]:
                n += 1
            best = max(best, n)
        d = seq[p][0]
        if best and p + best > end.get(d, 0):
            end[d] = p + best
            if sum(len(s[2].split()) for s in seq[p : p + best]) >= min_words:
                runs.setdefault(d, []).append((p, best))
    gone = {seq[p + j][:2] for rs in runs.values() for p, n in rs for j in range(n)}
    out = {}
    for d, t in rows:
        ls = t.split("\n") if t is not None else []
        r = runs.get(d, [])
        out[d] = ("\n".join(s for i, s in enumerate(ls) if (d, i) not in gone) if t is not None else None, len(ls), sum((d, i) in gone for i in range(len(ls))), len(r), max((n for _, n in r), default=0))
    return out


def found(spark, rows, min_words):
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=min_words).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.text, r.lines_before, r.lines_removed, r.n_runs, r.longest_run) for r in out}


def test_against_brute_force(spark):
    rng = random.Random(9)
    pool = ["a b c", "d", "", "e f g h i j", "k l m n o", "zz"] + [f"u{i}" for i in range(30)]
    rows = [(i, rng.choice([None, ""] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(8)])) for i in range(40)]
    rows += [(50, "\n".join(pool)), (51, "\n".join(pool)), (52, "\n".join(["d"] * 9)), (53, "x\n" + "\n".join(pool) + "\ny")]
    assert found(spark, rows, 4) == brute(rows, 4)


@pytest.mark.parametrize("seed", range(3))
def test_many_small_corpora_with_few_lines(spark, seed):
    """Ten corpora in a run, kept apart by lines of their own: ranks of shared lines must not run into one another."""
    rng = random.Random(seed)
    rows = []
    for c in range(10):
        kinds = [f"c{c} {'w ' * rng.randrange(4)}{k}" for k in range(rng.randint(2, 25))]
        rows += [(100 * c + i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 14)))) for i in range(14)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_ranks_follow_the_suffix_array_from_the_first(spark):
    rng = random.Random(3)
    ids = [rng.choice("abcde") for _ in range(60)]
    at = L.line_positions(spark.createDataFrame([(1, "\n".join(ids))], "doc_id bigint, text string"), "doc_id", "text")
    first = {r.h1: r["rank"] for r in L.first_ranks(at).collect()}
    by_line = {r.line: r.h1 for r in at.collect()}
    assert all(first[by_line[i]] == sum(first[by_line[j]] < first[by_line[i]] for j in range(60)) for i in range(60))  # places of smaller lines
    key = [first[by_line[i]] for i in range(60)]
    now = spark.createDataFrame([(1, 0, i, k, 0) for i, k in enumerate(key)], "doc bigint, tie bigint, line int, a bigint, b bigint")
    now = L.first_level(now, 2)
    for h in (1, 2, 4):
        now = L.next_level(L.double(now, h, 2))
        got = {r.line: r["rank"] for r in now.collect()}
        same = lambda p, q: key[p : p + 2 * h] == key[q : q + 2 * h]
        assert set(got) == {p for p in range(61 - 2 * h) if any(same(p, q) for q in range(61 - 2 * h) if q != p)}
        for p in got:
            for q in got:
                assert (got[p] < got[q]) == (key[p : p + 2 * h] < key[q : q + 2 * h])


def test_runs_have_their_exact_length(spark):
    rows = [(1, "a\nb\nc\nd\ne\nf\ng"), (2, "x\na\nb\nc\nd\ne\ny"), (3, "q\nc\nd\ne\nf\nr"), (4, "a\nb")]
    got = L.repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=3).collect()
    assert sorted((r.doc, r.line, r.lines, r.words) for r in got) == [(2, 1, 5, 5), (3, 1, 4, 4)]


def test_depth_decides(spark):
    """Single lines and pairs of lines are too short here; only the whole run has enough words."""
    run = "\n".join(f"line {i}" for i in range(5))
    rows = [(1, run), (2, "own\n" + run), (3, "line 0\nline 1\nline 2\nline 3\nother")]
    got = found(spark, rows, 9)
    assert got == brute(rows, 9) and got[2] == ("own", 6, 5, 1, 5) and got[3][2] == 0


def test_edges(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(None, "a b\nc d", 1, 2, 3), (1, "a b\nc d", 1, 2, 3), (1, "a b\nc d", 1, 2, 3), (2, "\n" * 3000, 1, 2, 3), (3, "w " * 100_000, 1, 2, 3), (4, "w " * 100_000, 1, 2, 3), (5, "a b\nc d", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, line int, doc int, lines_removed int")
    out = L.dedup_lines(df, min_words=4)
    got = out.collect()
    assert len(got) == 7 and sorted(out.columns) == sorted([*df.columns, "lines_before", "n_runs", "longest_run"])
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    assert by[None].text == "a b\nc d" and by[4].text == "" and by[2].text == "\n" * 3000 and by[3].text == "w " * 100_000 and by[5].text == ""
    assert [r.text for r in got if r.doc_id == 1] == ["a b\nc d"] * 2 and all(r.line == 1 and r.doc == 2 for r in got)


def test_clashing_names_and_ids_that_are_text(spark):
    own = ["doc", "tie", "line", "h1", "rank", "f", "lines", "_row", "id", "h", "gone", "part", "removed", "n_runs", "words", "upto", "a.b"]
    rows = [("x", "a b c\nd e f"), ("y", "z\na b c\nd e f"), ("y", "k\na b c\nd e f")]
    df = spark.createDataFrame([(*r, *range(len(own))) for r in rows], "key string, body string, " + ", ".join(f"`{c}` int" for c in own))
    out = L.dedup_lines(df, "key", "body", min_words=6)
    assert sorted(r.body for r in out.collect()) == ["a b c\nd e f", "k", "z"] and [r["a.b"] for r in out.collect()] == [len(own) - 1] * 3


def test_against_sql_after_a_hot_line(spark):
    rng = random.Random(13)
    rows = []
    for i in range(240):  # a hot first line with several continuations, and lines of their own that end alike
        body = [f"head{i % 40}", f"next{rng.randrange(12)}"] if i % 2 else ["hot", f"next{rng.randrange(12)}"]
        rows.append((i, "\n".join([*body, "the footer has one two three", "and the other four five six", *(f"own {i} {j}" for j in range(rng.randrange(3)))])))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=10)
    got = got.select("doc_id", "lines_before", "lines_removed", L.F.md5(L.F.col("text").cast("binary")), "n_runs", "longest_run").collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(map(tuple, got)) == sorted(con.execute(L.DEDUP_SQL).fetchall()) and sum(r.lines_removed for r in got) > 400
