import random
import zlib

import numpy as np
import pytest

from tabulon.llm import packing as P


def exact_bins(lengths, most):
    """Fewest bins by search, for a handful of pieces."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= lengths[i]}:
            j = rooms.index(r)
            go(i + 1, rooms[:j] + [r - lengths[i]] + rooms[j + 1 :])
        go(i + 1, [*rooms, most - lengths[i]])

    go(0, [])
    return best[0]


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        most = rng.choice([10, 17, 30])
        x = [rng.randint(1, most) for _ in range(rng.randint(1, 9))]
        best = exact_bins(x, most)
        bins, offsets, fill = P.best_fit(np.array(x), most)
        assert P.lower_bound(np.array(x), most) <= best <= len(fill) and fill.max() <= most and fill.sum() == sum(x)


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    ranks, js = P.tokenizer_paths()
    slow, fast = Tokenizer.from_file(js), P.encoder(ranks, js)
    for t in ["", " ", "Ab  c\n\n\td ", "éüñ 123 don't", "x" * 3000, "a<|endoftext|>b", "  　x", "Ouwhea the of rend." * 50, "日本語 🙂", "\r\n \r\n"]:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [2048, 64])
def test_round_trip(spark, most):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "", "Ab c. " * rng.randint(1, 200), "zq é " * rng.randint(1, 40)])) for i in range(150)] + [(3, "again"), (None, "none"), (3, "again")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, start string")
    got = P.pack_documents(df, most=most, keep_ids=True).collect()
    ranks, js = P.tokenizer_paths()
    want = sorted((repr(i), tuple(P.encoder(ranks, js)(t or "").tolist() + [0])) for i, t in rows)
    docs, seqs = {}, {}
    for r in got:
        assert len(r.ids) == r.length <= most and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and (r.length == most or r.piece == 0)
        docs.setdefault((repr(r.id), r.piece), []).append((r.start, tuple(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    firsts = [(i, ids) for (i, p), v in docs.items() for s, ids in v if p == 0]
    assert sorted((i, ids[: len(ids)]) for i, ids in firsts) == sorted((i, ids[: len(ids) % most or min(len(ids), most)]) for i, ids in want)
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    assert len(seqs) <= P.lower_bound(np.array([r.length for r in got]), most) * 1.03 + 1


def bins_of(df):
    return df.select("sequence_id").distinct().count()


def test_gaps_are_exchanged(spark):
    """Pieces of just over and just under half a sequence: partitions have too many of either, and only an exchange brings them together."""
    rows = [(i, 1100 if i % 2 else 948) for i in range(240)]
    df = spark.createDataFrame(rows, "row bigint, length bigint")
    alone, once, all_rounds = (P.pack(df, 2048, rounds=r, per_partition=20) for r in (0, 1, 16))
    bound = P.lower_bound(np.array([n for _, n in rows]), 2048)
    assert bound == 120 and bins_of(alone) > bins_of(once) > bound == bins_of(all_rounds)
    got = all_rounds.join(df, "row").collect()
    assert len(got) == 240 == len({r.row for r in got}) and len({(r.sequence_id, r.offset) for r in got}) == 240
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048 for x in fill.values())


def test_certified_partitions_stay(spark):
    df = spark.createDataFrame([(i, 1024) for i in range(200)], "row bigint, length bigint")
    got = P.pack(df, 2048, per_partition=200)
    assert bins_of(got) == 100 and {r.sequence_id >> 56 for r in got.collect()} == {0}


def test_long_runs_of_one_character(spark):
    """The rank encoder gives up on these; the ids are the tokenizer's all the same."""
    from tokenizers import Tokenizer

    ranks, js = P.tokenizer_paths()
    slow, fast = Tokenizer.from_file(js), P.encoder(ranks, js)
    for t in (" " * 2_000_000 + "x", "\n" * 1_500_000, " \n" * 700_000):
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids
    got = P.pack_documents(spark.createDataFrame([(1, " " * 2_000_000), (2, "a" * 100_000)], "doc_id bigint, text string")).collect()
    assert sum(r.length for r in got if r.id == 1) == len(fast(" " * 2_000_000)) + 1 and {r.id for r in got} == {1, 2}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.pack_documents(none).count() == 0
    assert P.cut_pieces(5, 2) == [(0, 1), (1, 2), (3, 2)] and P.cut_pieces(4, 2) == [(0, 2), (2, 2)] and P.cut_pieces(1, 2) == [(0, 1)]
