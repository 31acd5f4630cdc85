import hashlib
import random

from tabulon.llm import fuzzy as Z


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_common_chunks_is_the_plain_table():
    rng = random.Random(1)
    a = [Z.np.array([rng.randrange(5) for _ in range(rng.randint(0, 64))], Z.np.uint16) for _ in range(60)]
    b = [Z.np.array([rng.randrange(5) for _ in range(rng.randint(0, 64))], Z.np.uint16) for _ in range(60)]
    assert Z.common_chunks(a, b).tolist() == [lcs(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_cuts_depend_on_their_window_only():
    rng = random.Random(2)
    x, y, tail = (bytes(rng.randrange(256) for _ in range(n)) for n in (50, 90, 300))
    assert (Z.cut_hashes(x + tail)[50 + Z.WINDOW :] == Z.cut_hashes(y + tail)[90 + Z.WINDOW :]).all()


def test_against_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 300 - 20, rng.choice([None, "", words(rng, 3), words(rng, 60), words(rng, 900)])) for i in range(120)]
    got = {r.id: r for r in Z.compare_edits(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_per_part=10).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = map(Z.Print, (t, new, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), str(a), str(b))
        assert [r.near_edited, r.near_next] == Z.likeness([(a, b), (a, c)]).tolist()


def test_ids_that_many_rows_share(spark):
    """A third of all rows, over several partitions: each row is followed by the next in order of id, hash of the text."""
    rng = random.Random(6)
    rows = [(9 if i % 3 == 0 else i, words(rng, 20) if i % 4 else "same") for i in range(150)] + [(None, "null")] * 40
    got = Z.compare_edits(spark.createDataFrame(rows, "doc_id bigint, text string"), rows_per_part=8).collect()
    signed = lambda t: (h := Z.xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((repr(i), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((repr(r.id), r.edited_sha256) for r in got) == sorted(want)


def test_edited_texts_are_nearer_than_strangers():
    rng = random.Random(4)
    near, far = [], []
    for n in (60, 200, 900, 3000):
        for _ in range(30):
            t, u = words(rng, n), words(rng, n)
            new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            a, b = Z.likeness([(Z.Print(t), Z.Print(new)), (Z.Print(t), Z.Print(u))])
            near.append(a)
            far.append(b)
    assert min(near) > 0.25 and sum(near) / len(near) > 0.45 and max(far) < 0.2


def test_edges(spark):
    assert Z.compare_edits(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = Z.compare_edits(spark.createDataFrame([(5, "ab")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one[0].near_next == 1.0
    rows = [(None, "x", 1, "g"), (None, None, 1, "g"), (2, "y " * 200_000, 1, "g"), (2, "y", 1, "g"), (2, "y", 1, "g")]
    got = Z.compare_edits(spark.createDataFrame(rows, "doc_id bigint, text string, bucket int, guest string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, 1, 400_000] and all(0 <= r.near_edited <= 1 for r in got)
    assert str(Z.Print("")) == "2::" and Z.likeness([(Z.Print(""), Z.Print("")), (Z.Print(""), Z.Print("a"))]).tolist() == [1.0, 0.0]
    f = Z.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string, bucket int, guest string")).collect()
    assert len(f) == 5 and len({r.fingerprint for r in f}) == 4
