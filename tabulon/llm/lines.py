"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

Every line becomes an ID (the number of positions of smaller lines, among the lines that occur more than once); a document is a sequence of IDs, and a line that occurs
once ends every common prefix, so its suffix needs no place in the array. Prefix doubling then ranks suffixes by their first 1, 2, 4, ...
lines: the pair (rank at p, rank at p + h) orders suffixes by 2h lines. Suffixes with equal rank after a round are an interval of the suffix
array whose longest common prefix is at least 2h lines; suffixes alone in their interval are finished and leave the table.

The intervals of all other prefix lengths come from the rounds' ranks by binary lifting, from the longest round down: suffixes of an interval of
l lines that agree in the rank, by h lines, of what follows those l lines are an interval of l + h lines. A suffix rests in the deepest interval of
which it isn't the earliest member, and that interval's length is exactly how long a run at an earlier place repeats at this one. Only an interval's
earliest member and those that rest in it are carried on, so the table has at most two rows for each suffix, however deep intervals are nested.

Runs that lie inside the run of the line before aren't maximal and go; a maximal run is a later copy, and deleted, if its lines have enough words together.

Ranks are order-preserving: rank = rank of the first half + place of the second half among its companions. Only distinct pairs with two
or more suffixes are ordered, in buckets of bounded width, so a line that fills a third of all positions is one row to the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, packed, unpacked, word_count, written

#: Buckets that order the distinct lines by hash.
LINE_BUCKETS = 4096
#: What names a document: its id, and the hash of its text, which tells rows that share an id apart.
DOC = ["doc", "tie"]
PLACE = [*DOC, "line"]


def split_lines(text: Column) -> Column:
    """Lines end at LF; null has none, empty text has one."""
    return F.split(text, "\n", -1)


def line_positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, line, h1, h2, words): every line's place and 128-bit ID."""
    lines = docs.select(column(id_col).alias("doc"), F.xxhash64(column(text_col)).alias("tie"), F.posexplode(split_lines(column(text_col))).alias("line", "s"))
    return lines.select(*PLACE, F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("second"), "s").alias("h2"), word_count(F.col("s")).alias("words"))


def _offsets(per: DataFrame, group: list[str], bucket: str, n: str) -> DataFrame:
    """per(group..., bucket, n) with `n0`, the sum of n over earlier buckets of the group; one row for each bucket."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*group, bucket, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("n0"))


def first_ranks(positions: DataFrame) -> DataFrame:
    """(h1, h2, rank): the repeated lines, ranked by ID. A rank is the number of positions of smaller lines, so it leaves room for its line's continuations."""
    kept = positions.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    kept = written(kept.select("h1", "h2", "n", F.shiftrightunsigned("h1", 64 - LINE_BUCKETS.bit_length() + 1).alias("bucket")))
    base = _offsets(kept.groupBy("bucket").agg(F.sum("n").alias("n")), [], "bucket", "n")  # at most LINE_BUCKETS rows
    w = Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return kept.withColumn("r", before).join(F.broadcast(base), "bucket").select("h1", "h2", (F.col("n0") + F.col("r")).alias("rank"))


def rank_pairs(pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, f, rank) of the pairs that occur more than once, from pairs(doc, tie, line, a, b): f is the earliest place of the pair's interval.
    `width` is the range of second ranks that a bucket orders, so a window's group has at most so many rows."""
    keys = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("f")).where("n > 1")
    keys = keys.withColumn("bucket", F.floor(F.col("b") / width))
    base = _offsets(keys.groupBy("a", "bucket").agg(F.sum("n").alias("n")), ["a"], "bucket", "n")
    w = Window.partitionBy("a", "bucket").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("n1", F.coalesce(F.sum("n").over(w), F.lit(0))).join(base, ["a", "bucket"])
    return ranked.select("a", "b", "f", (F.col("a") + F.col("n0") + F.col("n1")).alias("rank"))


def first_level(at: DataFrame, width: int) -> DataFrame:
    """(doc, tie, line, rank, f) by one line, from at(doc, tie, line, a, b)."""
    return at.select(*PLACE, "a", "b").join(rank_pairs(at, width), ["a", "b"]).select(*PLACE, "rank", "f")


def double(level: DataFrame, h: int, width: int) -> DataFrame:
    """level(doc, tie, line, rank, f) by h lines with `next_rank` and `next_f`, the same by 2h lines; null for suffixes that are alone by then."""
    ahead = F.max("rank").over(Window.partitionBy(*DOC).orderBy("line").rangeBetween(h, h))
    pairs = level.select(*PLACE, F.col("rank").alias("a"), ahead.alias("b"), "f")
    ranked = rank_pairs(pairs.where("b IS NOT NULL"), width).select("a", "b", F.col("f").alias("next_f"), F.col("rank").alias("next_rank"))
    return pairs.join(ranked, ["a", "b"], "left").select(*PLACE, F.col("a").alias("rank"), "f", "next_rank", "next_f")


def next_level(doubled: DataFrame) -> DataFrame:
    return doubled.where("next_rank IS NOT NULL").select(*PLACE, F.col("next_rank").alias("rank"), F.col("next_f").alias("f"))


def _later(f: str = "f") -> Column:
    """Whether the row's place isn't the earliest of its interval."""
    return F.struct(*PLACE) != F.col(f)


def longest_copies(levels: list[DataFrame]) -> DataFrame:
    """(doc, tie, line, lines, f): for each place where a run starts that also stands at an earlier place, the longest such run and the earliest place
    of its interval. levels[i] is double() from 2^i lines."""
    now = None
    row = lambda lines, f: F.struct(*PLACE, lines.alias("lines"), f.alias("f"))
    for i in reversed(range(len(levels))):
        h, level = 1 << i, levels[i]
        new = level.where(_later() & ~F.coalesce(_later("next_f"), F.lit(False)))  # the others rest at twice the length or deeper
        new = new.select(*PLACE, F.lit(h).alias("lines"), "f")
        rows = new.unionAll(new.select("f").distinct().select(*(F.col("f").getField(c).alias(c) for c in PLACE), F.lit(h).alias("lines"), "f"))
        if now is not None:
            ahead = level.select(*DOC, F.col("line").alias("at"), "rank")
            seen = now.withColumn("at", F.col("line") + F.col("lines")).join(ahead, [*DOC, "at"], "left").drop("at")
            parts = seen.where("rank IS NOT NULL").groupBy("f", "lines", "rank").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("g")).where("n > 1").drop("n")
            seen = seen.join(parts, ["f", "lines", "rank"], "left")
            deeper, earliest = F.coalesce(_later("g"), F.lit(False)), F.coalesce(~_later("g"), F.lit(False))
            longer = row(F.col("lines") + h, F.col("g"))
            rests = F.when(deeper, longer).otherwise(row(F.col("lines"), F.col("f")))
            rows = rows.unionAll(seen.select(F.explode(F.when(earliest, F.array(rests, longer)).otherwise(F.array(rests))).alias("r")).select("r.*"))
        now = written(rows)
    return now.where(_later())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, rank_width: int = 1_000_000) -> DataFrame:
    """(doc, tie, line, lines, words): the maximal line runs that are later copies, with their exact length in lines and words. They can overlap.

    A run is a later copy if the same lines stand at an earlier place (by id, hash of the text, line; the two may overlap), and is reported if it has
    at least `min_words` words and isn't part of the run that starts a line earlier. Null texts have no lines; rows with a null id have no runs and lend
    none; rows equal in id and text are one document. An empty table has no runs.
    """
    positions = line_positions(docs.where(column(id_col).isNotNull()), id_col, text_col)
    at = positions.join(first_ranks(positions), ["h1", "h2"]).select(*PLACE, F.col("rank").alias("a"), F.lit(0).cast("bigint").alias("b"), "words").dropDuplicates(PLACE)
    at = written(at)
    levels: list[DataFrame] = []
    level = written(first_level(at, rank_width))
    while not level.isEmpty():
        levels.append(written(double(level, 1 << len(levels), rank_width)))
        level = next_level(levels[-1])
    if not levels:
        return at.where("false").select(*PLACE, F.lit(0).alias("lines"), "words")
    by_line = Window.partitionBy(*DOC).orderBy("line")
    end = F.col("line") + F.col("lines") - 1
    runs = longest_copies(levels).select(*PLACE, "lines", end.alias("end"), F.lag(end).over(by_line).alias("before"))
    runs = runs.where("before IS NULL OR end > before")  # ends never fall along a document, so the line before decides
    upto = written(at.select(*PLACE, "words", F.sum("words").over(by_line).alias("upto")))
    runs = runs.join(upto.select(*PLACE, (F.col("upto") - F.col("words")).alias("w0")), PLACE).join(upto.select(*DOC, F.col("line").alias("end"), "upto"), [*DOC, "end"])
    return runs.select(*PLACE, "lines", (F.col("upto") - F.col("w0")).alias("words")).where(F.col("words") >= min_words)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """docs with `text` without the later copies of repeated line runs, and new columns lines_before, lines_removed, n_runs (maximal runs
    deleted, which can overlap) and longest_run (lines of the longest). A column of such a name is replaced; no other column matters, whatever its name.

    Null texts stay null with 0 lines. A document with a null id is left as it is and lends no copies. Of rows that share an id, the
    one whose text has the smaller hash is the earlier one; rows equal in id and text are one document and keep the same lines. An empty table gives no rows.
    """
    by_line = Window.partitionBy(*DOC).orderBy("line")
    runs = repeated_runs(docs, id_col, text_col, min_words).withColumn("end", F.col("line") + F.col("lines") - 1)
    reach = F.max("end").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("line") <= F.coalesce(reach, F.lit(-1)), 0).otherwise(1)).withColumn("part", F.sum("new").over(by_line))
    parts = runs.groupBy(*DOC, "part").agg(F.min("line").alias("from_line"), F.max("end").alias("to_line"), F.count("*").alias("n_runs"), F.max("lines").alias("longest_run"))
    gone = parts.groupBy(*DOC).agg(  # bounded by one document's lines
        F.array_sort(F.collect_list(F.struct("from_line", "to_line"))).alias("gone"), F.sum("n_runs").alias("n_runs"), F.max("longest_run").cast("bigint").alias("longest_run"), F.sum(F.col("to_line") - F.col("from_line") + 1).alias("removed")
    )
    rows = packed(docs, column(id_col).alias("id"), column(text_col).alias("text"), F.xxhash64(column(text_col)).alias("h"))
    out = rows.join(gone, (F.col("id") == F.col("doc")) & (F.col("h") == F.col("tie")), "left")
    lines, runs_of = split_lines(F.col("text")), F.col("gone")
    start = lambda i: F.coalesce(F.get(runs_of, i - 1)["to_line"] + 1, F.lit(0))
    stop = lambda i: F.coalesce(F.get(runs_of, i)["from_line"], F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))
    text = F.when(runs_of.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return unpacked(out, docs.columns, **{text_col: text, "lines_before": n, "lines_removed": zero("removed"), "n_runs": zero("n_runs"), "longest_run": zero("longest_run")})


#: The same by definition: windows of 1, 2, 3, ... lines, each named by the first place where it stands, for as long as one of them stands twice.
DEDUP_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, i, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (ORDER BY doc_id, i) AS pos
  FROM (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, i, pos, min(pos) OVER (PARTITION BY s) AS id, count(*) OVER (PARTITION BY s) AS n, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto, words FROM l),
w AS (
  SELECT 1 AS lines, doc_id, i, pos, id FROM e WHERE n > 1
  UNION ALL
  SELECT lines + 1, doc_id, i, pos, id FROM (
    SELECT w.lines, w.doc_id, w.i, w.pos, min(w.pos) OVER (PARTITION BY w.id, e.id) AS id, count(*) OVER (PARTITION BY w.id, e.id) AS n
    FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = w.i + w.lines AND e.n > 1) WHERE n > 1),
m AS (SELECT doc_id, i, max(lines) AS lines FROM w WHERE id < pos GROUP BY ALL),
x AS (SELECT *, lag(i + lines) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m),
r AS (SELECT x.doc_id, x.i, x.lines FROM x JOIN e a ON a.doc_id = x.doc_id AND a.i = x.i JOIN e b ON b.doc_id = x.doc_id AND b.i = x.i + x.lines - 1
      WHERE (before IS NULL OR x.i + x.lines > before) AND b.upto - a.upto + a.words >= 10),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + lines - 1)) AS i FROM r),
k AS (SELECT l.doc_id, count(*) AS lines_before, count(g.i) AS lines_removed, coalesce(string_agg(s, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n_runs, max(lines) AS longest_run FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.lines_before, 0) AS lines_before, coalesce(k.lines_removed, 0) AS lines_removed, md5(k.kept) AS kept_md5,
  coalesce(c.n_runs, 0) AS n_runs, coalesce(c.longest_run, 0)::BIGINT AS longest_run
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
