"""Embedding near-dedup by product quantisation over coarse inverted lists.

Vectors are scaled to length one. A coarse k-means (fitted to a bounded sample) names the inverted lists, and a vector's residual to its
list's centroid is coded by one of up to 256 centroids in each of 16 subspaces. Every vector is a member of its nearest list and a query to
several nearest lists. There a table of subspace distances from the query's residual gives an approximate distance to each member by
look-ups; what isn't shown to be too far, given how far the member is from its code, is compared again by exact cosine in double precision. Only the probes can miss a link.

In a large table a coarse list is divided by a second k-means of what the first leaves, so lists have about LIST_ROWS members up to two thousand million vectors.

Lists are cut into blocks of bounded size. A task's group is one block and the queries to it, and it returns a count for each vector and
a spanning forest of the links, never the pairs. Vectors with equal components are one vertex, counted as many times as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, written
from .components import connected_components

#: Vectors that the index is fitted to, at most.
SAMPLE_ROWS = 16_384
SUBSPACES, CODES = 16, 256
#: Sampled vectors of each length, at least (or all there are).
LEAST_SAMPLE = 256
#: Members of a list, on average at most, while the second level has room; and how many times more lists are probed where there is one.
LIST_ROWS, FINE_PROBES = 2048, 4
#: Members of a block, and queries that are compared with it at a time.
BLOCK, QUERIES = 2048, 512


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows; an empty centroid keeps its place."""
    x = x.astype(np.float64)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((c**2).sum(axis=1) - 2 * part @ c.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """Of vectors of one length: coarse centroids, centroids of what is left after them (one, zero, for a small table), and for each subspace the codebook of
    the residuals. A list is a pair of the first two. Size depends on the bounds above alone."""

    coarse: np.ndarray
    fine: np.ndarray
    books: list[np.ndarray]
    probes: int

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(x, cuts, axis=1)

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def home(self, x: np.ndarray) -> np.ndarray:
        """Each row's list."""
        first = nearest(x, self.coarse)
        return first * len(self.fine) + nearest(x - self.coarse[first], self.fine)

    def probe_lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest lists of each row: of the nearest coarse centroids, all pairs compete."""
        d = (self.coarse**2).sum(axis=1) - 2 * x @ self.coarse.T
        p = min(self.probes, len(self.coarse))
        near = np.argpartition(d, p - 1, axis=1)[:, :p]
        k = len(self.fine)
        if k == 1:
            return near
        out = np.empty((len(x), min(FINE_PROBES * self.probes, p * k)), np.int64)
        size = (self.fine**2).sum(axis=1)
        for i, (row, first) in enumerate(zip(x, near)):
            left = row - self.coarse[first]
            all_d = (left**2).sum(axis=1)[:, None] - 2 * left @ self.fine.T + size
            pick = np.argpartition(all_d.ravel(), out.shape[1] - 1)[: out.shape[1]]
            out[i] = first[pick // k] * k + pick % k
        return out

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each residual is from what its codes stand for."""
        codes = [nearest(part, book) for part, book in zip(self.parts(residual), self.books)]
        off = sum(((part - book[c]) ** 2).sum(axis=1) for part, book, c in zip(self.parts(residual), self.books, codes))
        return np.stack(codes, axis=1).astype(np.uint8), np.sqrt(off)

    def table_distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances from uncoded query residuals to coded members, by table look-up."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for m, (part, book) in enumerate(zip(self.parts(residual), self.books)):
            table = ((part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)).astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_index(sample: np.ndarray, rows: int, probes: int = 8, list_rows: int = LIST_ROWS) -> Index:
    """sample: unit rows. The number of coarse centroids is about twice the root of the number of rows that the index will hold, within what the sample can support; where
    their lists would be longer than list_rows on average, the second level divides them, so lists stay short as tables grow."""
    rng = np.random.default_rng(0)
    k = int(max(1, min(1024, len(sample) // 16 or 1, round(2 * rows**0.5))))
    coarse = kmeans(sample, k, 8, rng)
    residual = sample - coarse[nearest(sample, coarse)]
    second = int(max(1, min(1024, len(sample) // 16 or 1, -(-rows // (k * list_rows)))))
    fine = kmeans(residual, second, 8, rng) if second > 1 else np.zeros((1, sample.shape[1]))
    residual = residual - fine[nearest(residual, fine)]
    cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    books = [kmeans(residual[:4096, c], min(CODES, len(residual)), 6, rng) for c in cuts]
    return Index(coarse, fine, books, probes)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, v, d, least, n) from rows(id, v): vectors that can link (not null, not zero, all components finite), numbered, with their length, their smallest id and how
    often they come."""
    v = F.col("v")
    fine = F.size(v) > 0
    fine &= ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    own = rows.where(v.isNotNull() & F.col("id").isNotNull()).where(fine)
    return own.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "v", F.size("v").alias("d"), "least", "n")


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def place(vectors: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """(d, list, is_query, node, n, v, home, probes): each vector once as a member of its list, and as a query to each list it probes."""
    names = ["d", "list", "is_query", "node", "n", "v", "home", "probes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                one, index = b.take(pa.array(np.flatnonzero(dims == dim))), indexes[dim]
                for at in range(0, one.num_rows, 2048):
                    part = one.slice(at, 2048)
                    x = unit_rows(_vectors(part.column(0), dim))
                    lists, home = index.probe_lists(x).astype(np.int32), index.home(x).astype(np.int32)
                    n, p = lists.shape
                    rows = np.concatenate([np.arange(n), np.repeat(np.arange(n), p)])
                    take = pa.array(rows)
                    probes = pa.FixedSizeListArray.from_arrays(pa.array(lists[rows].ravel()), p).cast(pa.list_(pa.int32()))
                    cols = [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.concatenate([home, lists.ravel()])), pa.array(np.arange(len(rows)) >= n), part.column(1).take(take), part.column(2).take(take), part.column(0).take(take)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(home[rows]), probes], names=names)

    kind = vectors.schema["v"].dataType.simpleString()
    return arrow_map(vectors.select("v", "node", "n", "d"), run, f"d int, list int, is_query boolean, node bigint, n bigint, v {kind}, home int, probes array<int>")


def find_links(placed: DataFrame, indexes: dict[int, Index], least: float) -> DataFrame:
    """(src, dst, times): a link where dst is set; where it is null, src has `times` more linked vectors.

    A member is compared exactly unless the look-up shows it to be too far: a linked pair is at most sqrt(2 - 2 least) apart, and a member is as far from its code
    as was measured when it was coded, so by the triangle inequality no link of a probed list is lost. A pair that both sides look for is counted by the smaller
    node only. Whole vectors travel to the lists, because only there pairs can be checked without handing on every pair of a group.
    """
    sizes = placed.where("NOT is_query").groupBy("d", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # one row for each list, 2^20 at most for a length
    dealt = placed.join(F.broadcast(sizes), ["d", "list"])
    own = F.when(F.col("is_query"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    dealt = dealt.withColumn("block", F.explode(own)).select("d", "list", "block", "is_query", "node", "n", "v", "home", "probes")
    apart = (2 - 2 * least) ** 0.5

    def compare(members: dict, q: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(q["node"]), QUERIES):
            s = slice(at, at + QUERIES)
            d = members["index"].table_distances(q["x"][s] - members["centre"], members["codes"])
            i, j = np.nonzero(d <= ((apart + members["off"] + 1e-3) ** 2).astype(np.float32))
            x, y = q["node"][s][i], members["node"][j]
            both = (members["probes"][j] == q["home"][s][i][:, None]).any(axis=1)
            keep = (x != y) & (~both | (x < y))
            i, j, x, y = i[keep], j[keep], x[keep], y[keep]
            near = np.concatenate([np.einsum("ij,ij->i", q["x"][s][i[a : a + 65536]], members["x"][j[a : a + 65536]]) for a in range(0, len(i), 65536)]) >= least if len(i) else np.zeros(0, bool)
            yield x[near], y[near], q["n"][s][i[near]], members["n"][j[near]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            dims, lists, blocks, is_query, node, n, home = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 4, 5, 7))
            change = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1])])
            for lo, hi in zip(change, np.r_[change[1:], b.num_rows]):
                now = (dims[lo], lists[lo], blocks[lo])
                x = unit_rows(_vectors(b.column(6).slice(lo, hi - lo), int(dims[lo])))
                probes = b.column(8).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                m = np.flatnonzero(~is_query[lo:hi].astype(bool))
                if now != key:
                    key, members = now, None
                if len(m):
                    index = indexes[int(dims[lo])]
                    centre = index.centroid(lists[lo : lo + 1])
                    codes, off = index.encode(x[m] - centre)
                    new = {"node": node[m + lo], "n": n[m + lo], "x": x[m], "probes": probes[m], "codes": codes, "off": off}
                    members = {k: v if members is None else np.concatenate([members[k], v]) for k, v in new.items()} | {"index": index, "centre": centre}
                q = np.flatnonzero(is_query[lo:hi].astype(bool))
                if members is None or not len(q):
                    continue
                for a, c, na, nc in compare(members, {"node": node[q + lo], "n": n[q + lo], "x": x[q], "home": home[q + lo]}):
                    if not len(a):
                        continue
                    ids, at = np.unique(np.concatenate([a, c]), return_inverse=True)
                    times = np.bincount(at, np.concatenate([nc, na])).astype(np.int64)
                    forest = _forest(a, c)
                    src = [*ids.tolist(), *(e[0] for e in forest)]
                    dst = [None] * len(ids) + [e[1] for e in forest]
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array([*times.tolist(), *[0] * len(forest)], pa.int64())], names=["src", "dst", "times"])

    return arrow_map(dealt.repartition("d", "list", "block").sortWithinPartitions("d", "list", "block", "is_query"), run, "src bigint, dst bigint, times bigint")


def fit_indexes(nodes: DataFrame, probes: int, sample_rows: int, list_rows: int) -> dict[int, Index]:
    """An index for each length of vectors, fitted to its share of sample_rows, LEAST_SAMPLE at least: those with the smallest hash."""
    counts = {r["d"]: r["count"] for r in nodes.groupBy("d").count().collect()}  # one row for each length
    out = {}
    for dim, n in sorted(counts.items()):
        rows = max(min(LEAST_SAMPLE, sample_rows), sample_rows * n // sum(counts.values()))
        sample = nodes.where(F.col("d") == dim).orderBy(F.xxhash64("v"), "node").limit(rows).select("v").toPandas()["v"]
        out[dim] = fit_index(unit_rows(np.stack(sample.to_list())), n, probes, list_rows)
    return out


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, probes: int = 8, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row of table.

    n_links: other vectors linked directly (cosine >= least, exact, in double precision); component_id: the smallest id reachable, in the ids' own type and order (numbers or
    text). Null and zero vectors, those with null or non-finite components, and rows with a null id link with nothing. Vectors of different lengths
    don't link; each length has an index of its own. Rows that share an id are one vertex in component_id. Only the indexes are fitted to a
    sample (sample_rows in all, by hash, but LEAST_SAMPLE for each length); every vector is a member and a query. An empty table gives no rows; other columns aren't read.
    """
    rows = table.select(column(id_col).alias("id"), column(vector_col).alias("v"))
    nodes = written(distinct_vectors(rows))
    indexes = fit_indexes(nodes, probes, sample_rows, list_rows)
    if not indexes:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(find_links(place(nodes, indexes), indexes, least))
    comp = connected_components(found.where("dst IS NOT NULL"))
    times = found.where("dst IS NULL").groupBy("src").agg(F.sum("times").alias("times"))
    known = nodes.join(comp, "node", "left").join(times, F.col("node") == F.col("src"), "left")
    known = written(known.select("v", "least", F.coalesce("component", "node").alias("root"), (F.coalesce("times", F.lit(0)) + F.col("n") - 1).alias("links")))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("v").alias("w"), "links", "component")
    out = rows.join(known, (F.col("v") == F.col("w")) & F.col("id").isNotNull(), "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
