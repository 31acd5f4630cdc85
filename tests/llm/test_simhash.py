import random
import re

import xxhash

from tabulon.llm import simhash as S


def brute(rows, k=3, most=3):
    """Plain Python: bit counts, all pairs, union-find."""
    fps = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = [" ".join(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, f"{fps[i]:016x}", find(i)) for i in fps}


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Ab", "cd", "éf", "g", "hij", "klm"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 200):
        w = rng.choice(base).split()
        if w:
            w[rng.randrange(len(w))] = rng.choice(["x", "cd"])
        rows.append((i, "\t ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.near_duplicates(df).select("id", S.fingerprint_hex(S.F.col("fp")).alias("h"), "component_id").collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)


def test_large_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(1)
    fps = {1 << 60 | 5}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    lone = {0x0F0F0F0F0F0F0F0F, 0x7070707070707070}
    df = spark.createDataFrame([(x,) for x in fps | lone], "fp bigint")
    comp = S.connected_components(S.candidate_links(df)).collect()
    assert {r.node for r in comp} == fps and {r.component for r in comp} == {min(fps)}


def test_ring_filter_loses_nothing():
    import numpy as np

    rng = random.Random(7)
    for _ in range(2000):
        d = 0
        for _ in range(rng.randint(0, 3)):
            d |= 1 << rng.randrange(64)
        held = S.chain_holds(np.full(4, d, np.uint64), np.arange(4), 3)
        assert held.any()
    assert not S.chain_holds(np.full(4, 0b1111, np.uint64), np.arange(4), 3).any()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, fp string, id string, component_id int")
    assert S.near_duplicates(none).count() == 0
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q r s t"), (2, "A b  c d")]
    got = S.near_duplicates(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, text string, fp string, id string, component_id int"))
    assert sorted((r.id is None, r.id or 0, r.component_id or 0) for r in got.collect()) == [(False, 2, 2), (False, 3, 2), (False, 3, 2), (True, 0, 0), (True, 0, 2)]
    long = spark.createDataFrame([(1, "w " * 200_000), (2, "w " * 200_001)], "doc_id bigint, text string")
    assert {r.component_id for r in S.near_duplicates(long).collect()} == {1}
    assert sorted(r.doc_id for r in S.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.doc_id) == [2]
