"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes marks the places where a text is cut: those where its low bits are all ones, once in `block` bytes on average. The
place depends on its seven bytes alone, so an edit moves cuts near it and no others. Each chunk gives two base-64 characters of its hash,
and the chunks in order are the signature. The block size is the power of two at which a text of that length has 24 to 48 chunks; a
fingerprint holds the signatures at that size and at the next, "exponent:signature:signature", and two fingerprints are compared at
sizes they share. Likeness is 1 - d / (a + b) for signatures of a and b chunks, where d counts the chunks to delete and insert.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, in_order, written

WINDOW = 7
#: A block size is chosen for at most so many chunks on average; a signature has at most MOST, the last of which takes in the rest of the text.
AIM, MOST = 48, 64
LEAST_EXPONENT = 2
#: Blocks that a chunk holds at most (but for a signature's last).
LONGEST = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
#: Rows of documents that are handed on together.
ROWS = 512


def cut_hashes(data: bytes) -> np.ndarray:
    """A 32-bit hash of the WINDOW bytes that end at each byte (fewer at the start count as zeros before)."""
    n = len(data)
    x = np.zeros(n + WINDOW - 1, np.uint32)
    x[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    x += np.uint32(1)
    h = x[:n].copy()
    for j in range(1, WINDOW):
        h *= np.uint32(0x01000193)
        h += x[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def exponent_for(n: int) -> int:
    """The block size of n bytes, as a power of two."""
    e = LEAST_EXPONENT
    while (AIM << e) < n:
        e += 1
    return e


def signature(data: bytes, ends: np.ndarray, block: int) -> np.ndarray:
    """One number below 4096 for each chunk; ends are where chunks end before the end of the text. Where a text repeats itself and marks no place,
    a chunk ends LONGEST blocks after the one before."""
    gaps = np.diff(np.r_[0, ends, len(data)])
    if (more := np.maximum(gaps - 1, 0) // (LONGEST * block)).any():
        extra = np.repeat(np.r_[0, ends], more) + LONGEST * block * np.concatenate([np.arange(1, m + 1) for m in more])
        ends = np.sort(np.r_[ends, extra])
    ends = [*ends[: MOST - 1].tolist(), len(data)]
    if len(ends) > 1 and ends[-2] == ends[-1]:
        ends.pop()
    h, out, at = xxhash.xxh64_intdigest, [], 0
    for e in ends:
        out.append(h(data[at:e]) & 4095)
        at = e
    return np.array(out, np.uint16)


class Print:
    """A fingerprint: exponent, and signatures at that block size and twice that."""

    __slots__ = ("coarse", "exponent", "fine")

    def __init__(self, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        self.exponent = e = exponent_for(len(data))
        if not data:
            self.fine = self.coarse = np.zeros(0, np.uint16)
            return
        h = cut_hashes(data)
        low = np.uint32((1 << e) - 1)
        ends = np.flatnonzero((h & low) == low)
        self.fine = signature(data, ends + 1, 1 << e)
        self.coarse = signature(data, ends[(h[ends] >> np.uint32(e)) & np.uint32(1) == 1] + 1, 2 << e)

    def __str__(self) -> str:
        return f"{self.exponent}:{''.join(PAIRS[c] for c in self.fine)}:{''.join(PAIRS[c] for c in self.coarse)}"

    def at(self, exponent: int) -> np.ndarray | None:
        return self.fine if exponent == self.exponent else self.coarse if exponent == self.exponent + 1 else None


def common_chunks(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Lengths of the longest common subsequences of signature pairs, all pairs at once, bit-parallel in 64-bit words."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    wide = max(map(len, b))
    left, right = np.full((n, MOST), 65535, np.uint16), np.full((n, max(wide, 1)), 65534, np.uint16)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)] = x
        right[i, : len(y)] = y
    v = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(wide):
        match = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & match
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def likeness(pairs: list[tuple[Print, Print]]) -> np.ndarray:
    """0 to 1 for each pair; 1 if the fingerprints are equal, 0 if they share no block size. The better of the sizes they share counts."""
    out = np.zeros(len(pairs))
    where, a, b = [], [], []
    for i, (p, q) in enumerate(pairs):
        if p is q or p.exponent == q.exponent and np.array_equal(p.fine, q.fine) and np.array_equal(p.coarse, q.coarse):
            out[i] = 1.0
            continue
        for e in {p.exponent, p.exponent + 1} & {q.exponent, q.exponent + 1}:
            x, y = p.at(e), q.at(e)
            if len(x) and len(y):
                where.append(i)
                a.append(x)
                b.append(y)
    common = common_chunks(a, b)
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    np.maximum.at(out, np.array(where, np.int64), 2 * common / np.maximum(total, 1))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of whole texts, a row for each row, repeated and null ids as well; a null text counts as empty ("2::"). Other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(Print(t or "")) for t in part.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), run, f"id {kind}, fingerprint string")


RESULT = ("n_chars bigint", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double")


class Edits:
    """Result columns of rows and their successors, filled row by row."""

    def __init__(self) -> None:
        self.ids, self.n_chars, self.sha, self.own, self.edited, self.pairs = [], [], [], [], [], []

    def add(self, i: object, text: str, own: Print, after: str, then: Print) -> None:
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        p = Print(new)
        self.ids.append(i)
        self.n_chars.append(len(text))
        self.sha.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
        self.own.append(str(own))
        self.edited.append(str(p))
        self.pairs += [(own, p), (own, then)]

    def columns(self, kind: pa.DataType) -> list[pa.Array]:
        near = likeness(self.pairs)
        return [pa.array(self.ids, kind), pa.array(self.n_chars, pa.int64()), *(pa.array(x, pa.string()) for x in (self.sha, self.own, self.edited)), pa.array(near[::2]), pa.array(near[1::2])]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_part: int = 4000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document, in order of
    id (null ids first), hash of the text (after the last comes the first; a lone row follows itself). Null texts count as empty. An empty table gives no
    rows; other columns aren't read.

    Rows are sorted over partitions in one shuffle, as many as they need, and rows that share an id can be in several. A task holds one row and its successor;
    the last row of a partition is joined with the first of the next, one pair for each partition.
    """
    rows = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    rows = in_order(rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("own")), ["id", "tie", "own"], rows_per_part)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of rows whose successor is in the partition; and the text of each partition's first row (place 1) and last (2)."""
        held = kind = None  # part, id, text, print

        def end(row: tuple, place: int) -> pa.RecordBatch:
            cols = [pa.array([row[1]], kind), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([row[0]], pa.int32()), pa.array([place], pa.int32()), pa.array([row[2]], pa.string())], names=names)

        for b in batches:
            kind = b.column(1).type
            for at in range(0, b.num_rows, ROWS):
                part, done, ends = b.slice(at, ROWS), Edits(), []
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    now = (*row, Print(row[2]))
                    if held is not None and held[0] == now[0]:
                        done.add(held[1], held[2], held[3], now[2], now[3])
                    else:
                        ends += [end(x, k) for x, k in ((held, 2), (now, 1)) if x is not None]
                    held = now
                n = len(done.ids)
                yield pa.RecordBatch.from_arrays([*done.columns(kind), pa.nulls(n, pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
                yield from ends
        if held is not None:
            yield end(held, 2)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = Edits()
            for i, text, after in zip(*(c.to_pylist() for c in b.columns)):
                done.add(i, text, Print(text), after, Print(after))
            yield pa.RecordBatch.from_arrays(done.columns(b.column(0).type), names=names[:7])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join((f"id {kind}", *RESULT))
    names = ["id", *(c.split()[0] for c in RESULT), "part", "place", "edge"]
    got = written(arrow_map(rows.select("part", "id", "text"), inside, f"{schema}, part int, place int, edge string"))
    first, last = (got.where(F.col("place") == k).select("part", "id", F.col("edge").alias(f"text{k}")) for k in (1, 2))
    by_part = Window.orderBy("part")  # one row for each partition, numbers only
    follow = first.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("then"))
    pairs = last.join(follow, "part").join(first.select(F.col("part").alias("then"), "text1"), "then").select("id", "text2", "text1")
    return got.where("place = 0").select(*names[:7]).unionAll(arrow_map(pairs, across, schema))
