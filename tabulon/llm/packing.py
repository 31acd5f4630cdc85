"""Best-fit packing with certified bin counts.

Documents are tokenised, cut into pieces of at most one sequence, and the pieces' lengths are dealt to partitions of bounded size. Each
partition packs by best fit decreasing and certifies its bin count with lower bounds from dual feasible functions. The same bound of all pieces together, from
their counts by length, certifies the whole: where all bins meet it, the packing is optimal and stays. Until then, partitions with gaps in
their bins (a partition's own certificate tells only that it can do no better by itself) exchange documents: all their pieces are dealt anew to half as many
partitions, or to fewer still, and packed again, for as long as that saves a bin. Partitions may grow by that to MOST_PER_PARTITION pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, drop_written, ship, written

#: Pieces that a partition packs at a time.
PER_PARTITION = 200_000
#: The same where partitions with gaps are put together.
MOST_PER_PARTITION = 1_600_000
#: What each document ends with.
END_ID = 0


def tokenizer_paths() -> tuple[str, str]:
    """(ranks, json) of the default public byte-level BPE; both files hold one vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def encoder(ranks_path: str, json_path: str):
    """text -> uint32 ids as the json file's tokenizer gives them (add_special_tokens=False). Texts that hold the text of a special token, or runs of
    white space too long for the rank encoder, go to that tokenizer itself; all others take the same vocabulary's faster rank encoder."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on runs of about a million spaces
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` ids but the first, which has the rest."""
    first = n % most or min(n, most)
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, keep_ids: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and END_ID, in pieces of at most `most`. A null text is empty."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    got = np.append(encode(text or ""), END_ID).astype("<u4")
                    for j, (s, n) in enumerate(cut_pieces(len(got), most)):
                        owner.append(i)
                        piece.append(j)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(got[s : s + n].tobytes()))
                        if keep_ids:
                            ids.append(got[s : s + n].astype(np.int32))
                cols = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return arrow_map(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), run, schema)


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: each piece's bin and offset, and each bin's fill. Open bins are kept by free room; a bit set finds the tightest fit."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    fill: list[int] = []
    rooms = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            at, room = len(fill), most
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += n
        left = room - n
        if not by_room[left]:
            rooms |= 1 << left
        by_room[left].append(at)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, most: int) -> int:
    return bound_of_counts(np.bincount(lengths, minlength=most + 1), most)


def bound_of_counts(count: np.ndarray, most: int) -> int:
    """For count[n] pieces of length n: a number of bins below which no packing can go: the largest bound over two families of dual feasible functions.

    The first raises pieces above most - a to a whole bin and drops those below a, for every a; the second rounds to multiples of
    1 / (k + 1) of a bin, for k up to 40. A dual feasible function maps any bin's pieces to a sum of at most one bin, so the sum over
    all pieces is a bound.
    """
    x = np.arange(most + 1)
    n_upto, s_upto = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * x)]  # index v: of pieces below v
    n_in = lambda a, b: n_upto[b + 1] - n_upto[a]
    s_in = lambda a, b: s_upto[b + 1] - s_upto[a]
    a = np.arange(0, most // 2 + 1)
    top, half = most - a, most // 2
    whole = np.where(top < most, n_upto[-1] - n_upto[np.minimum(top + 1, most + 1)], 0)
    large, large_sum = n_in(half + 1, np.maximum(top, half)), s_in(half + 1, np.maximum(top, half))
    small_sum = s_in(a, half)
    best = int((whole + large + np.maximum(0, -(-(small_sum - (large * most - large_sum)) // most))).max())
    for k in range(1, 41):
        scaled = np.where((k + 1) * x % most == 0, x * k, (k + 1) * x // most * most)
        best = max(best, int(-(-(count * scaled).sum() // (k * most))))
    return best


def _pack(items: DataFrame, parts: int, most: int, deal: int) -> DataFrame:
    """items(row, length) -> (row, length, part, bin, offset, bins, bound, free), packed in `parts` groups dealt by a hash of the row and `deal`."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, most)
        return pd.DataFrame({"row": group["row"], "length": lengths, "part": group["part"], "bin": bins, "offset": offsets, "bins": len(fill), "bound": lower_bound(lengths, most), "free": len(fill) * most - int(lengths.sum())})

    ship(items.sparkSession)
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(deal)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(run, "row bigint, length bigint, part bigint, bin bigint, offset bigint, bins bigint, bound bigint, free bigint")


def pack(items: DataFrame, most: int = 2048, rounds: int = 16, per_partition: int = PER_PARTITION) -> DataFrame:
    """(row, sequence_id, offset) for items(row, length): rows must be unique and not null, lengths 1 to `most`; no rows give no rows.

    After the first packing, and as long as the count is above the certificate of the whole, partitions with free room in their bins exchange their
    pieces, at most `rounds` times and while it saves bins.
    """
    n = items.count()
    if not n:
        return items.select("row", F.col("row").alias("sequence_id"), F.col("length").alias("offset"))
    counts = np.zeros(most + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # at most `most` rows
        counts[r[0]] = r[1]
    goal, kept = bound_of_counts(counts, most), 0
    now = written(_pack(items, -(-n // per_partition), most, 0))
    done: list[DataFrame] = []
    name = lambda df, r: df.select("row", (F.lit(r << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    fewer = 2
    for r in range(1, rounds + 1):
        per = now.groupBy("part").agg(F.count("*").alias("n"), F.max("bins").alias("bins"), F.max("free").alias("free"))  # one row for each partition
        gap = F.col("free") > 0
        parts, size, before, total = per.agg(F.count(F.when(gap, 1)), F.sum(F.when(gap, F.col("n"))), F.sum(F.when(gap, F.col("bins"))), F.sum("bins")).first()
        if parts < 2 or kept + total <= goal:
            break
        fewest = -(-size // max(per_partition, MOST_PER_PARTITION))
        deal = max(-(-parts // fewer), fewest)
        again = written(_pack(now.where(gap).select("row", "length"), deal, most, r))
        after = again.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if after < before:
            done.append(name(now.where(~gap), r))
            now, kept, fewer = again, kept + total - before, 2
        else:
            drop_written(again)
            if deal <= fewest:
                break
            fewer *= 2
    done.append(name(now, 0))
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, keep_ids: bool = False, paths: tuple[str, str] | None = None, rounds: int = 16) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every document and its place.

    Null and empty texts are the end id alone. Repeated and null ids are packed as rows of their own. An empty table gives no rows.
    """
    cut = pieces(docs, id_col, text_col, most, keep_ids, paths)
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()))
    return cut.join(pack(cut.select("row", "length"), most, rounds), "row").drop("row")
