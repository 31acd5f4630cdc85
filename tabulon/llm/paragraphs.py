"""Substring dedup by paragraph MinHash banding.

A paragraph is a line; a line of more than MOST words is cut further where the content says so (after a word whose hash, with the next word's,
ends in zeros), so a passage inside a longer line falls into the same pieces wherever it stands. Such a line is a paragraph as a whole, too, so
that its near copies are found though an edit keeps pieces apart. A paragraph's set is its five-word
shingles of lower-cased words (the whole, if it has fewer words). Bands of MinHash values are keys; paragraphs that collide in a band are
verified by exact Jaccard similarity, and components of the verified links, with equal paragraphs, are the classes. All copies of a
class but the first (by document id, then place) are removals; a passage counts from `min_words` words of such paragraphs in a row.

A piece's bands are the least values of one hash, as many as prefix filtering asks for: two sets that are similar enough share one of
them for certain. A whole line's bands are the least values of several hashes, as many as `recall` asks for. Lines and pieces are separate classes.

Equal paragraphs are one vertex. Buckets are cut into blocks of bounded size and give spanning forests, not pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, arrow_map, column, drop_written, packed, unpacked, written
from .components import connected_components

#: Words of a paragraph cut out of a longer line: at least, at most, and one cut in so many words on average.
LEAST, MOST, CUT_EVERY = 6, 32, 8
SHINGLE = 5
#: Values in a band, of a whole line here and of a whole text in simhash.py.
LINE_ROWS, BAND_ROWS = 1, 2
#: Paragraphs whose keys a task remembers to have given, so that it doesn't give them again for a copy.
REMEMBERED = 500_000
#: Paragraphs in a block of a bucket.
BLOCK = 1024

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def bands_for(similarity: float, recall: float, rows: int = BAND_ROWS) -> int:
    """The fewest bands of `rows` values with which a pair of that similarity collides with probability `recall`."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache
def band_factors(bands: int) -> np.ndarray:
    """An odd factor for each band, which makes its hash."""
    return mixed(np.arange(1, bands + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE)], dtype=np.uint64)
    return _powers[:n]


class Cut:
    """One text's paragraphs: bounds as word numbers, line, first word in the line; and the hashes of its shingles. `least` is the similarity that counts."""

    def __init__(self, text: str, least: float = 0.8) -> None:
        words, counts = [], []
        for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
            w = line.split()
            words += w
            counts.append(len(w))
        h = xxhash.xxh64_intdigest
        self.hashes = x = np.fromiter(map(h, words), np.uint64, len(words))
        n = len(words)
        line_start = np.r_[0, np.cumsum(counts)]
        follow = np.r_[x[1:], np.zeros(min(n, 1), np.uint64)]
        marks = np.flatnonzero(mixed(x * _MULT + follow) % np.uint64(CUT_EVERY) == 0) + 1
        starts = []
        for i, c in enumerate(counts):
            a, b = int(line_start[i]), int(line_start[i + 1])
            if not c:
                continue
            starts.append(a)
            if c <= MOST:
                continue
            at = a
            for m in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b - LEAST, "right")].tolist():
                while m - at > MOST:
                    at += MOST
                    starts.append(at)
                if m - at >= LEAST:
                    at = m
                    starts.append(at)
            while b - at > MOST + LEAST:
                at += MOST
                starts.append(at)
        self.start = np.array(starts, np.int64)
        self.end = np.r_[self.start[1:], n] if len(starts) else self.start
        self.line = np.searchsorted(line_start, self.start, "right") - 1
        self.first = self.start - line_start[self.line] if len(starts) else self.start
        #: Whole lines, numbered after the pieces: those cut further, and shorter ones that can be near copies of such.
        self.long = np.flatnonzero(np.array(counts) >= max(SHINGLE, least * (MOST + 2 - SHINGLE) + SHINGLE - 1 - 1e-9))
        self.long_start, self.long_end = line_start[self.long], line_start[self.long + 1]
        self._shingles()

    def _shingles(self) -> None:
        x, n = self.hashes, len(self.hashes)
        self.identity = self.long_identity = np.zeros(0, np.uint64)
        self.shingles = np.zeros(n, np.uint64)
        self.valid = np.zeros(n, bool)
        if not n:
            return
        p = powers(n + 1)
        prefix = np.r_[np.uint64(0), np.cumsum(x * p[:n], dtype=np.uint64)]
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, back)], dtype=np.uint64)
        size, long = self.end - self.start, (self.long_end - self.long_start).astype(np.uint64)
        self.identity = mixed((prefix[self.end] - prefix[self.start]) * inverse[self.start] + size.astype(np.uint64) * _MULT)
        self.long_identity = mixed((prefix[self.long_end] - prefix[self.long_start]) * inverse[self.long_start] + long * _MULT + _BASE)
        last = np.minimum(np.arange(n) + SHINGLE, n)
        self.shingles = mixed((prefix[last] - prefix[:n]) * inverse[:n])
        stop = np.repeat(np.maximum(self.end - SHINGLE + 1, self.start + 1), size)
        self.valid = np.arange(n) < stop
        short = np.flatnonzero(size < SHINGLE)
        self.shingles[self.start[short]] = self.identity[short]

    def prefix_keys(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys of pieces, and each one's piece, in order: pieces with Jaccard similarity >= least, if they differ, have a key in common."""
        at = np.flatnonzero(self.valid)
        owner = np.searchsorted(self.start, at, "right") - 1
        v = mixed(self.shingles[at] ^ _MULT)
        order = np.lexsort((v, owner))
        v, owner = v[order], owner[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (owner[1:] != owner[:-1])][: len(v)]
        v, owner = v[new], owner[new]
        size = np.bincount(owner, minlength=len(self.start))
        need = np.ceil(least * size - 1e-9).astype(np.int64)  # shared shingles, at least
        depth = np.where(size >= least * (size + 1) - 1e-9, size - need + 1, 0)  # smaller sets are similar to equal ones only
        first = np.arange(len(v)) - np.r_[0, np.cumsum(size)][owner] < depth[owner]
        return v[first], owner[first]

    def band_keys(self, bands: int) -> np.ndarray:
        """A key for each whole line and band: the least value of the line's shingles under the band's hash."""
        if not len(self.long):
            return np.zeros((0, bands), np.uint64)
        stop = np.stack([self.long_start, self.long_end - SHINGLE + 1], 1).ravel()
        values = self.shingles[:, None] * band_factors(bands)
        return mixed(np.minimum.reduceat(values, stop, axis=0)[::2] + np.arange(1, bands + 1, dtype=np.uint64))

    def set_of(self, i: int) -> np.ndarray:
        if i >= len(self.start):
            i -= len(self.start)
            return np.unique(self.shingles[self.long_start[i] : self.long_end[i] - SHINGLE + 1])
        a, b = self.start[i], self.end[i]
        return np.unique(self.shingles[a:b][self.valid[a:b]])

    def rows(self, least: float, bands: int) -> tuple[np.ndarray, ...]:
        """Columns line, first word, words, identity, keys, number of keys: pieces, then whole lines."""
        keys, of = self.prefix_keys(least)
        lines = self.band_keys(bands)
        n = np.r_[np.bincount(of, minlength=len(self.start)), np.full(len(self.long), bands)]
        words = np.r_[self.end - self.start, self.long_end - self.long_start]
        return np.r_[self.line, self.long], np.r_[self.first, np.zeros(len(self.long), np.int64)], words, np.r_[self.identity, self.long_identity], np.r_[keys, lines.ravel()], n


def paragraphs(docs: DataFrame, id_col: str, text_col: str, least: float, bands: int) -> DataFrame:
    """(doc, para, line, first_word, words, h, whole, keys): every paragraph of every text with a non-null id; `whole` are lines beside their pieces. A copy that a task
    meets again may have no keys, since those of its first are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cuts = [Cut(t or "", least) for t in part.column(1).to_pylist()]
                n = [len(c.start) + len(c.long) for c in cuts]
                line, first, words, h, keys, many = (np.concatenate(x) for x in zip(*(c.rows(least, bands) for c in cuts)))
                para = np.concatenate([np.arange(k) for k in n])
                whole = np.concatenate([np.arange(k) >= len(c.start) for k, c in zip(n, cuts)])
                if len(seen) > REMEMBERED:
                    seen.clear()
                new = np.array([x not in seen and not seen.add(x) for x in h.tolist()], bool)
                keys, many = keys[np.repeat(new, many)], np.where(new, many, 0)
                cols = [
                    part.column(0).take(pa.array(np.repeat(np.arange(len(cuts)), n))), *(pa.array(x.astype(np.int32)) for x in (para, line, first, words)), pa.array(h.view(np.int64)), pa.array(whole),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(keys.view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "para", "line", "first_word", "words", "h", "whole", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(column(id_col).isNotNull()).select(column(id_col).alias("id"), column(text_col).alias("text"))
    return arrow_map(rows, run, f"doc {kind}, para int, line int, first_word int, words int, h bigint, whole boolean, keys array<bigint>")


def _semi(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of big whose `on` is in keys, by shuffle whatever the size, so the cost grows in proportion."""
    return big.join(keys, on, "left_semi")


def near_links(flat: np.ndarray, at: np.ndarray, h: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets flat[at[i]:at[i+1]] with Jaccard similarity >= least, breadth first. Where a set's values stand in others is looked up by
    value, so what sets don't share costs nothing."""
    size = np.diff(at)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    by_value = owner[np.argsort(value, kind="stable")]
    begin = np.r_[0, np.cumsum(times)]
    left = np.ones(n, bool)
    src, dst = [], []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            v = value[at[i] : at[i + 1]]
            v = v[times[v] > 1]
            t = times[v]
            spots = np.repeat(begin[v] - np.r_[0, np.cumsum(t)[:-1]][: len(t)], t) + np.arange(t.sum())
            common = np.bincount(by_value[spots], minlength=n)
            near = np.flatnonzero(left & (common > 0) & (common >= least * (size + size[i] - common) - 1e-12))
            left[near] = False
            queue += near.tolist()
            src += [int(h[i])] * len(near)
            dst += h[near].tolist()
    return src, dst


def near_pairs(flat: np.ndarray, at: np.ndarray, first: np.ndarray, least: float) -> np.ndarray:
    """For groups of two sets each, first[i] and first[i] + 1: whether their Jaccard similarity is at least `least`, all at once."""
    size = np.diff(at)
    total = size[first] + size[first + 1]
    group = np.repeat(np.arange(len(first)), total)
    spots = np.repeat(at[first] - np.r_[0, np.cumsum(total)[:-1]][: len(first)], total) + np.arange(total.sum())
    v = flat[spots]
    order = np.lexsort((v, group))
    v, group = v[order], group[order]
    common = np.bincount(group[1:][(v[1:] == v[:-1]) & (group[1:] == group[:-1])], minlength=len(first))
    return (common > 0) & (common >= least * (total - common) - 1e-12)


def verified_links(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(src, dst) from groups(key, h), distinct rows, and sets(h, shingles), a row for each h. Sets travel once to each block that needs them."""
    sizes = groups.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = groups.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "h").join(sets, "h").select("key", "x", "y", "h", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            key, x, y, h = (t.column(c).to_numpy() for c in range(4))
            sets = t.column(4).combine_chunks()
            flat, off = sets.flatten().to_numpy(), np.r_[0, np.cumsum(sets.value_lengths().to_numpy())]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            size = np.diff(np.r_[first, len(key)])
            two = first[size == 2]
            two = two[near_pairs(flat, off, two, least)]
            src, dst = h[two].tolist(), h[two + 1].tolist()
            for a, b in zip(first[size > 2], (first + size)[size > 2]):
                s, d = near_links(flat[off[a] : off[b]], off[a : b + 1] - off[a], h[a:b], least)
                src += s
                dst += d
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            last = np.ones(len(t), bool)
            for c in range(3):
                v = t.column(c).to_numpy()
                last &= v == v[-1]
            done = int(np.argmax(last)) if last.all() else len(t) - int(np.argmin(last[::-1]))
            held = t.slice(done)
            if done:
                yield emit(t.slice(0, done))
        if held is not None and len(held):
            yield emit(held)

    return arrow_map(dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"), run, "src bigint, dst bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(h, shingles) for wanted(doc, para), which has one place for each h: the texts are cut again, only where a candidate stands."""
    per = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.array_sort(F.collect_list("para")).alias("_paras"))  # bounded by a document's paragraphs
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(per, F.col("id") == F.col("_doc")).select("text", "_paras")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, h, sets = b.slice(at, 256), [], []
                for text, paras in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c = Cut(text or "", least)
                    identity = np.r_[c.identity, c.long_identity]
                    for i in paras:
                        if i < len(identity):
                            h.append(identity[i])
                            sets.append(c.set_of(i).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])

    return arrow_map(rows, run, "h bigint, shingles array<bigint>").dropDuplicates(["h"])


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.9999, min_words: int = 16) -> DataFrame:
    """(doc, para, line, first_word, words, component_id, kept): the paragraphs of repeated passages.

    component_id is the class (a number, the smallest paragraph hash of the class); kept marks its first paragraph by doc, para. Only paragraphs that stand in a row of at least
    min_words words of paragraphs with a copy are returned. No link of pieces is lost; whole lines at the similarity itself collide with
    probability `recall`. A whole line is returned, beside its pieces and numbered after them, if its class has unequal lines, one of them
    cut further. Pieces of a removed line are never kept, so a piece's first copy elsewhere is.
    Null texts have no paragraphs; rows with a null id are left out and lend no copies; rows that
    share an id are texts of one document. Paragraphs are equal if their 64-bit hashes are.
    """
    t = written(paragraphs(docs, id_col, text_col, similarity, bands_for(similarity, recall, LINE_ROWS)))
    keyed = t.select("h", F.explode("keys").alias("key"))
    near = written(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("key"))
    groups = written(_semi(keyed, near, "key").distinct())
    drop_written(near)
    places = t.groupBy("h").agg(F.min(F.struct("doc", "para")).alias("p"))  # before the join: a paragraph with most rows is one row from each task
    places = written(_semi(places, groups.select("h").distinct(), "h").select("p.doc", "p.para"))
    sets = written(shingle_sets(docs, places, id_col, text_col, similarity))
    drop_written(places)
    comp = connected_components(verified_links(groups, sets, similarity)).select(F.col("node").alias("h"), "component")
    drop_written(groups)
    drop_written(sets)
    many = t.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").join(comp, "h", "full")
    classes = written(many.select("h", F.coalesce("component", "h").alias("component_id"), F.col("component").isNotNull().alias("_near")))
    rows = written(t.drop("keys").join(classes, "h").where("NOT whole OR _near"))  # one join and nothing else by this key, so AQE can split a hot one
    lines, rows = rows.where("whole"), rows.where("NOT whole")
    line_classes = lines.groupBy("component_id").agg(F.max("words").alias("_most"), F.min(F.struct("doc", "para")).alias("_f")).where(F.col("_most") > MOST)
    lines = _semi(lines, line_classes.select("component_id"), "component_id").where(F.col("words") >= min_words)
    line_first = line_classes.select("component_id", "_f.doc", "_f.para", F.lit(True).alias("_kept"))
    lines = written(lines.join(line_first, ["doc", "para", "component_id"], "left").withColumn("_kept", F.coalesce("_kept", F.lit(False))))
    gone = lines.where("NOT _kept").select("doc", "line", F.lit(True).alias("_gone")).distinct()
    stay = rows.join(gone, ["doc", "line"], "left_anti")
    first = stay.groupBy("component_id").agg(F.min(F.struct("doc", "para")).alias("_f")).select("component_id", "_f.doc", "_f.para", F.lit(True).alias("_kept"))
    by_place = Window.partitionBy("doc").orderBy("para")
    rows = rows.withColumn("_new", F.when(F.col("para") - F.lag("para").over(by_place) <= 1, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(by_place)).withColumn("_total", F.sum("words").over(Window.partitionBy("doc", "_run")))
    rows = rows.where(F.col("_total") >= min_words).join(first, ["doc", "para", "component_id"], "left")  # by place, so a class with most rows is spread
    out = ["doc", "para", "line", "first_word", "words", "component_id", F.coalesce("_kept", F.lit(False)).alias("kept")]
    return rows.select(*out).unionAll(lines.select(*out))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the removals: each goes from its first word to the next paragraph's, the rest of the text stays as it is. Columns are those of docs, whatever their names.

    Null and empty texts and rows with a null id stay as they are. Of rows that share an id, each loses the paragraphs (by place) that are removals in any of
    them. An empty table gives no rows.
    """
    gone = repeated_paragraphs(docs, id_col, text_col, **how).where("NOT kept").groupBy("doc")
    gone = gone.agg(F.array_sort(F.collect_list(F.struct("line", "first_word", "words"))).alias("gone"))  # bounded by a document's paragraphs
    rows = packed(docs, column(id_col).alias("id"), column(text_col).alias("text")).join(gone, F.col("id") == F.col("doc"), "left").select("_row", "text", "gone")
    kind = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(t, g) if g else t for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_row", "text"])

    return unpacked(arrow_map(rows, run, kind), docs.columns, **{text_col: F.col("text")})


def without(text: str | None, gone: list[dict]) -> str | None:
    """text without the given (line, first_word, words)."""
    if text is None:
        return None
    lines, head = text.split("\n"), {}
    for g in gone:
        if not g["first_word"]:
            head[g["line"]] = max(head.get(g["line"], 0), g["words"])
    gone = [g for g in gone if g["first_word"] + g["words"] > head.get(g["line"], 0) or not g["first_word"] and g["words"] == head[g["line"]]]  # pieces of a whole line go with it
    for g in sorted(gone, key=lambda g: (-g["line"], -g["first_word"])):
        if g["line"] < len(lines):
            line = lines[g["line"]]
            spots = [m.span() for m in re.finditer(WORD, line)]
            a, b = g["first_word"], g["first_word"] + g["words"]
            if a < len(spots):
                lines[g["line"]] = line[: spots[a][0]] + (line[spots[b][0] :] if b < len(spots) else line[spots[min(b, len(spots)) - 1][1] :])
    return "\n".join(lines)
