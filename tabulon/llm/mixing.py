"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot i of the schedule is the golden-ratio point frac(i * phi). Cumulative target weights cut the unit interval into one stretch for
each source, and the stretch a point falls in names the slot's source; so every prefix of the schedule is within a few blocks of the
target weights. The slots of a source are ranked, its documents are shuffled by a hash, laid end to end and cut into blocks of equal
words, the same for all sources, and the slot of rank k takes block k. So a source gives as many blocks as it was dealt slots. Beyond its end its documents come
again, and where it would go beyond the repeat limit, its last blocks are short or empty.

Ranks and running sums go over partitions of neighbouring rows, and then over the partitions' totals, so a source with a third of all rows is spread
like any other, and so are many sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, packed, running_totals, unpacked, word_count, written

#: 1 / golden ratio, and the fraction of 2^20 times it: a slot's point is made of the two halves of its number, so that it stays exact for large ones.
PHI, PHI_HIGH = 0.6180339887498949, 0.607787409740351
#: Words of a block, and the least number of blocks that a mixture is cut into (then a block has fewer words).
BLOCK_WORDS, LEAST_BLOCKS = 1024, 100_000
#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 50_000
#: Slots that a task makes.
SLOTS_PER_TASK = 1_000_000


def _joined(big: DataFrame, small: DataFrame, on: Column | list[str], rows: int, how: str = "inner") -> DataFrame:
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, src, source_size, weight, limit, target) for sizes(source, size): one row for each source.

    Sources by code point, null last, take the weights in turn and share `share` of all words. A target stops at `most` times its
    source's size and the excess is shared anew, until none is above: the rate per weight is (what is left) / (weights left) of the sources below their
    limit, and rises, round by round, to its last value. A round is one sum over the sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    per = running_totals(per, ["last", "source"], "source_size").withColumnRenamed("nth", "src")
    turn = F.element_at(F.array(*map(F.lit, weights)), F.pmod("src", F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("weight", turn).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    per = written(per.select("source", "src", "source_size", "weight", "limit", (F.col("limit") / F.col("weight")).alias("ratio")))
    rate, stopped = 0.0, -1
    while True:
        full = F.col("ratio") < rate
        n, used, left, words = per.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if n == stopped or not left:
            break
        stopped, rate = n, (float(share) * words - used) / left
    target = F.when(F.col("ratio") < rate, F.col("limit")).otherwise(F.least(F.col("limit"), F.lit(rate) * F.col("weight")))
    return per.select("source", "src", "source_size", "weight", "limit", target.alias("target"))


def point(slot: Column) -> Column:
    """frac(slot * phi)."""
    x = F.expr("id div 1048576") * F.lit(PHI_HIGH) + slot % 1048576 * F.lit(PHI)
    return x - F.floor(x)


def schedule(sources: DataFrame, n_sources: int, total: float, block: int) -> DataFrame:
    """(src, k, slot): the schedule's slots, ranked within their source; sources needs src and target. A source that no point met has none."""
    spark = sources.sparkSession
    slots, cells = max(1, int(-(-total // block))), max(1024, 4 * n_sources)
    edge = running_totals(sources.where("target > 0").select("src", "target"), ["src"], "target")
    last = edge.agg(F.max("src")).first()[0]
    hi = F.when(F.col("src") == F.lit(last), 2.0).otherwise((F.col("before") + F.col("target")) / F.lit(total))
    edge = edge.select("src", (F.col("before") / F.lit(total)).alias("lo"), hi.alias("hi")) if last is not None else edge.select("src", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    cell = lambda c: F.least(F.lit(cells - 1), F.floor(F.col(c) * cells)).cast("int")
    grid = edge.select("src", "lo", "hi", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    points = spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, -(-slots // SLOTS_PER_TASK)))
    points = points.select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("cell", cell("u"))
    met = _joined(points, grid, ["cell"], cells + n_sources).where("u >= lo AND u < hi").select("src", "slot", F.lit(1).alias("one"))
    ranked = written(running_totals(met, ["src", "slot"], "one", SLOTS_PER_TASK).select("src", "slot", "nth"))
    first = ranked.groupBy("src").agg(F.min("nth").alias("first"))
    return _joined(ranked, first, ["src"], n_sources).select("src", (F.col("nth") - F.col("first")).alias("k"), "slot")


@dataclass
class Mix:
    """sources: (source, src, source_size, weight, limit, target, n_slots, cap), where cap is the words it gives; rows: one for each document, (row, id, h, tie, src,
    size, start); segments: what each slot takes, (slot, src, k, row, epoch, a, words), where a counts the source's words from its first document."""

    sources: DataFrame
    rows: DataFrame
    segments: DataFrame

    def taken(self) -> DataFrame:
        """(id, source, size, source_size, target, taken, first_slot, n_slots) for every document: words taken, repeats counted, the first slot that takes
        some of it (null for none) and how many do, counted anew for each repeat."""
        got = self.segments.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n"))
        out = self.rows.join(got, "row", "left").join(self.sources.select("src", "source", "source_size", "target"), "src")
        return out.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_slots"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int | None = None) -> Mix:
    """The mixture of all documents, in blocks of block_words words: by default BLOCK_WORDS, or the LEAST_BLOCKS-th part of the mixture if that is less, so a source
    is within a few hundred-thousandths of the mixture from its target at any size.

    A null text has no words, a null source is the last source. Documents without words take part in
    nothing. Reruns agree: the shuffle is MD5 of the id, ties by size, hash of the text, and equal rows may swap places. A source takes its slots' blocks, never
    more than `most` times its size; one that no point met takes a single block, short of the target's. Repeated and null ids are rows of their own; an empty table gives empty
    results. Other columns aren't read.
    """
    rows = docs.select(column(id_col).alias("id"), column(source_col).alias("source"), word_count(column(text_col)).alias("size"), F.xxhash64(column(text_col)).alias("tie"))
    rows = written(rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("own", F.monotonically_increasing_id()))
    sources = written(source_targets(rows, weights, share, most))
    n_sources, total = sources.agg(F.count("*"), F.round(F.coalesce(F.sum("target"), F.lit(0.0)), 3)).first()
    block = block_words or int(max(1, min(BLOCK_WORDS, total // LEAST_BLOCKS)))
    slots = written(schedule(sources, n_sources, total, block))
    dealt = slots.groupBy("src").agg(F.count("*").alias("n_slots"))
    unmet = F.col("n_slots").isNull() & (F.col("target") > 0)
    own = F.when(unmet, F.least(F.lit(float(block)), F.ceil("target"))).otherwise(F.coalesce("n_slots", F.lit(0)) * F.lit(block))
    sources = sources.join(dealt, "src", "left").withColumn("cap", F.least(F.floor("limit"), own).cast("bigint"))
    sources = written(sources.withColumn("n_slots", F.when(unmet, 1).otherwise(F.coalesce("n_slots", F.lit(0))).cast("bigint")))
    late = sources.join(dealt.select("src"), "src", "left_anti").where("target > 0").select("src", F.lit(0).cast("bigint").alias("k"), (F.lit(int(-(-total // block))) + F.col("src")).cast("bigint").alias("slot"))

    rows = _joined(rows, sources.select("src", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), n_sources)
    rows = running_totals(rows.select("id", "h", "tie", "src", "size", "own"), ["src", "h", "size", "tie", "own"], "size")
    rows = written(rows.select(F.col("nth").alias("row"), "id", "h", "tie", "src", "size", "before"))
    first = written(rows.groupBy("src").agg(F.min("before").alias("first")))
    rows = _joined(rows, first, ["src"], n_sources).withColumn("start", F.col("before") - F.col("first")).drop("before", "first")

    laid = _joined(rows.where("size > 0"), sources.select("src", "source_size", "cap"), ["src"], n_sources).where("start < cap")
    laid = laid.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(cap - start - 1) div source_size"))))
    laid = laid.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("cap")))
    laid = laid.withColumn("k", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
    x, y = F.greatest(F.col("a"), F.col("k") * block), F.least(F.col("b"), (F.col("k") + 1) * block)
    laid = laid.select("row", "src", "epoch", "k", x.alias("a"), (y - x).alias("words"))
    return Mix(sources, rows, laid.join(slots.unionByName(late), ["src", "k"]).select("slot", "src", "k", "row", "epoch", "a", "words"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Whole documents in the mixture's proportions and in the order of the schedule: a document comes taken / size times, rounded, each time at the first slot that
    takes words of that repeat. Documents without words come once, at the head. Columns are those of docs.

    Rows equal in id and text are told apart by nothing, so each stands for any of them; null ids are ids like others. An empty table gives no rows.
    """
    m = mix(docs, id_col, text_col, **how)
    per = m.segments.groupBy("row", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"), F.min("a").alias("a"))
    copies = m.rows.join(per.groupBy("row").agg(F.sum("words").alias("taken")), "row").select("row", "h", "tie", F.round(F.col("taken") / F.col("size")).alias("times"))
    places = per.join(copies, "row").where("epoch < times").select("h", "tie", "slot", "a")
    places = places.unionAll(m.rows.where("size = 0").select("h", "tie", F.lit(-1).cast("bigint").alias("slot"), F.col("row").alias("a")))
    h = F.md5(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = packed(docs, h.alias("h"), F.xxhash64(column(text_col)).alias("tie")).groupBy("h", "tie").agg(F.first("_row").alias("_row"))
    return unpacked(rows.join(places, ["h", "tie"]).orderBy("slot", "a"), docs.columns)


#: The same mixture in DuckDB SQL, written from the definition: range joins and one global window where the operator works in partitions.
TAKEN_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
s1 AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, row_number() OVER (ORDER BY ratio, src) AS place FROM s2),
s4 AS (SELECT source, src, source_size, lim, least(lim, weight * (SELECT arg_min(rate, place) FROM s3 WHERE rate <= ratio)) AS target FROM s3),
t AS (SELECT round(sum(target), 3) AS total, CAST(greatest(1, least(1024, floor(round(sum(target), 3) / 100000))) AS BIGINT) AS block FROM s4),
e AS (SELECT src, sum(target) OVER (ORDER BY src) / (SELECT total FROM t) AS hi FROM s4 WHERE target > 0),
e1 AS (SELECT src, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo, CASE WHEN lead(hi) OVER (ORDER BY src) IS NULL THEN 2 ELSE hi END AS hi FROM e),
i AS (SELECT i, (i // 1048576) * 0.607787409740351::DOUBLE + (i % 1048576) * 0.6180339887498949::DOUBLE AS x FROM range((SELECT CAST(greatest(1, ceil(total / block)) AS BIGINT) FROM t)) r(i)),
p AS (SELECT src, i AS slot, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS k FROM (SELECT i, x - floor(x) AS u FROM i) JOIN e1 ON u >= lo AND u < hi),
n AS (SELECT src, count(*) AS n FROM p GROUP BY src),
c AS (SELECT s4.*, block, CAST(least(floor(lim), CASE WHEN n IS NULL AND target > 0 THEN least(block, ceil(target)) ELSE coalesce(n, 0) * block END) AS BIGINT) AS cap FROM s4 LEFT JOIN n USING (src), t),
q AS (SELECT src, k, slot FROM p UNION ALL SELECT src, 0, (SELECT count(*) FROM i) + src FROM c WHERE target > 0 AND src NOT IN (SELECT src FROM n)),
w AS (SELECT d.doc_id, d.size, c.*,
        coalesce(CAST(sum(d.size) OVER (PARTITION BY c.src ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS a
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(a + size, cap) - a) + greatest(0, least(a + size + source_size, cap) - a - source_size) AS BIGINT) AS taken,
  CASE WHEN size > 0 AND a < cap THEN slot END AS first_slot,
  CAST(CASE WHEN size > 0 AND a < cap THEN (least(a + size, cap) - 1) // block - a // block + 1 ELSE 0 END
     + CASE WHEN size > 0 AND a + source_size < cap THEN (least(a + size + source_size, cap) - 1) // block - (a + source_size) // block + 1 ELSE 0 END AS BIGINT) AS n_slots
FROM w LEFT JOIN q ON q.src = w.src AND q.k = a // block
"""
