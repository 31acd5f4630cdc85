"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into four ring segments of 16 bits. If two fingerprints differ in at most k bits, some segment starts a chain
in which the first l segments together differ in at most l * k / 4 bits, for every l. For k = 3 that means: the first segment is
equal, the first two differ in at most 1 bit, the first three in at most 2, all four in at most 3. The first two conditions give
the join key: the start segment, and one half (8 bits) of the next, since one differing bit leaves one half whole. What the
longer chains don't allow is dropped before the full Hamming distance, which is the last link of the chain, accepts a pair.

Distinct fingerprints are the vertices, so exact copies cost one row. A bucket of more than BLOCK fingerprints is cut into
blocks, and each pair of blocks is a task's group of bounded size; a group gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_written, shingle_hashes, words_of, written
from .components import connected_components
from .paragraphs import BAND_ROWS, bands_for, mixed, verified_links

SEGMENTS, SEGMENT_BITS = 4, 16
#: Fingerprints in a block; a group holds two blocks at most.
BLOCK = 4096
#: Groups up to this size are compared by shifting whole batches, larger ones by search from each member.
SMALL_GROUP = 12
#: Shingle hashes turned to bits at a time.
HASHES_AT_ONCE = 1 << 16
#: Words of a shingle where the likeness of texts counts, and the probability that a pair at the similarity is compared.
LIKE_WORDS, LIKE_RECALL = 5, 0.9999


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes: the 64-bit word whose bits are set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    set_bits = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part, own = hashes[at : at + HASHES_AT_ONCE], owner[at : at + HASHES_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        set_bits[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    for b in range(64):
        out |= (2 * set_bits[:, b] > counts).astype(np.uint64) << np.uint64(b)
    return out


def fingerprint_texts(texts: list[str | None], shingle_words: int) -> np.ndarray:
    per = [shingle_hashes(words_of(t), shingle_words) for t in texts]
    counts = np.fromiter(map(len, per), np.int64, len(per))
    flat = np.fromiter((h for x in per for h in x), np.uint64, int(counts.sum()))
    return bit_majorities(flat, counts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp bigint, h bigint): SimHash over whole texts, and the hash of their words. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # keeps the hashes of a few hundred texts in memory
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                fps = fingerprint_texts(texts, shingle_words)
                h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words_of(t))) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), pa.array(h.view(np.int64))], names=["id", "fp", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint, h bigint")


def ring_keys(fp: Column) -> Column:
    """Eight join keys: start segment i, half h of the next. Bits 24 and up name (i, h)."""
    keys = []
    for i in range(SEGMENTS):
        s = SEGMENT_BITS * i
        ring = fp if i == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))
        for h, at in ((0, 40), (1, 32)):
            key = F.shiftleft(F.shiftrightunsigned(ring, 48), 8).bitwiseOR(F.shiftrightunsigned(ring, at).bitwiseAND(F.lit(255)))
            keys.append(key + F.lit((2 * i + h) << 24))
    return F.array(*keys)


def chain_holds(diff: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the chain from segment `start` keeps within the budgets l * distance / 4; the last link is the whole Hamming distance."""
    s = (start * SEGMENT_BITS).astype(np.uint64)
    ring = (diff << s) | np.where(s > 0, diff >> ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
    ok = np.ones(len(diff), bool)
    for length in range(1, SEGMENTS + 1):
        live = np.flatnonzero(ok)
        if not len(live):
            break
        ok[live] = np.bitwise_count(ring[live] >> np.uint64(64 - SEGMENT_BITS * length)) <= length * distance // SEGMENTS
    return ok


def _forest(fps: np.ndarray, start: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one group, by breadth-first search; each member is taken out once."""
    left, out = fps.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = chain_holds(left ^ at, np.full(len(left), start), distance)
            if near.any():
                found = left[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
                left = left[~near]
    return out


def links_in_groups(group: np.ndarray, start: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same group (consecutive rows), enough to connect all that are linked there."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(size <= SMALL_GROUP, size)
    for gap in range(1, int(min(size.max(initial=0), SMALL_GROUP))):
        at = np.flatnonzero(small[:-gap] & (group[gap:] == group[:-gap]))
        at = at[chain_holds(fps[at] ^ fps[at + gap], start[at], distance)]
        found.append((fps[at], fps[at + gap]))
    for f, n in zip(first[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        found += _forest(fps[f : f + n], int(start[f]), distance)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *(a for a, _ in found)]), np.concatenate([empty, *(b for _, b in found)])


def candidate_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """(src, dst): links between the distinct fingerprints in nodes.fp, enough to connect whatever is within `distance` bits."""
    keyed = nodes.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(many, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = dealt.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, x, y, fp = cols
            change = np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            a, b = links_in_groups(np.cumsum(change), key >> 25, fp.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), bool)  # the group that may go on in the next batch
            for c in cols[:3]:
                last &= c == c[-1]
            done = int(np.argmax(last)) if last.all() else len(last) - int(np.argmin(last[::-1]))
            held = [c[done:] for c in cols]
            if done:
                yield emit([c[:done] for c in cols])
        if len(held[0]):
            yield emit(held)

    sorted_groups = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return arrow_map(sorted_groups, run, "src bigint, dst bigint")


def text_sets(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text the hash of its words and the set of its shingles of LIKE_WORDS words."""
    words = [words_of(t) for t in texts]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w)) for w in words), np.uint64, len(words))
    return h, [np.unique(np.array(shingle_hashes(w, LIKE_WORDS), np.uint64)) for w in words]


def like_links(docs: DataFrame, fps: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(src, dst) of fingerprints: texts whose shingle sets have Jaccard similarity >= similarity, by MinHash bands and verified exactly. Texts
    without words or with a null id have no link."""
    bands = bands_for(similarity, LIKE_RECALL)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mixed(np.arange(1, bands * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        salt = np.arange(1, bands + 1, dtype=np.uint64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                h, sets = text_sets(part.column(1).to_pylist())
                out = np.zeros((len(sets), bands), np.uint64)
                for i, x in enumerate(sets):
                    if len(x):
                        least = np.stack([(part[:, None] * odd).min(axis=0) for part in np.array_split(x, -(-len(x) // 4096))]).min(axis=0).reshape(bands, BAND_ROWS)
                        key = salt
                        for r in range(BAND_ROWS):
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
                        out[i] = key
                some = pa.array([len(x) > 0 for x in sets])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h.view(np.int64)), lists], names=["id", "h", "keys"]).filter(some)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                h, sets = text_sets(b.slice(at, 256).column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["h", "shingles"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    t = written(arrow_map(rows, keys, f"id {kind}, h bigint, keys array<bigint>"))
    keyed = t.select("h", F.explode("keys").alias("key"))
    near = written(keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("key"))
    groups = written(keyed.join(near, "key", "left_semi").distinct())
    drop_written(near)
    some = written(t.groupBy("h").agg(F.min("id").alias("id")).join(groups.select("h").distinct(), "h", "left_semi"))
    drop_written(t)
    sets = arrow_map(rows.join(some.select("id").distinct(), "id", "left_semi").select("text"), sets_of, "h bigint, shingles array<bigint>").dropDuplicates(["h"])
    links = written(verified_links(groups, written(sets), similarity))
    drop_written(groups)
    fp = written(fps.select("h", "fp").join(some.select("h"), "h", "left_semi").distinct())
    a, b = fp.select(F.col("h").alias("src"), F.col("fp").alias("a")), fp.select(F.col("h").alias("dst"), F.col("fp").alias("b"))
    return links.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of fingerprints that differ in at most `distance` (0 to 3) bits.

    Null and empty texts have fingerprint 0 and link like any other. Repeated ids give repeated rows; a null id takes the component
    of its fingerprint but is never the smallest (null if its component has null ids only). Extra columns aren't read.
    With `similarity`, texts whose sets of five-word shingles have that Jaccard similarity are linked, too.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must be 0 to {SEGMENTS - 1}")
    fps = written(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    links = candidate_links(nodes, distance) if distance else None
    if similarity is not None:
        like = like_links(docs, fps, id_col, text_col, similarity)
        links = like if links is None else links.unionAll(like)
    comp = connected_components(links) if links is not None else None
    if comp is None:
        return fps.join(nodes, "fp").select("id", "fp", F.col("least").alias("component_id"))
    root = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    root = written(root)
    best = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(best, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """The documents whose id is the smallest of its near-duplicate group; rows with a null id stay, and so do all rows of a repeated smallest id."""
    gone = near_duplicates(docs, id_col, text_col, shingle_words, distance, similarity).where("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
