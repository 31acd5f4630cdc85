"""From raw documents to packed sequences: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads back as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import lines, mixing, packing, quality, simhash
from tabulon.llm.common import column, drop_written, packed, unpacked, written

#: Documents whose score is lower go.
KEEP_SCORE = 0.3
#: Near-duplicates are at least so similar.
LIKE = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted to the labels in sf_dir, doesn't reject. Null texts are scored as empty ones; equal texts have equal scores; null ids
    have no label, and a score like any others. No rows give none, and without labels nothing is rejected but by the labels' share."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, KEEP_SCORE).select(*map(column, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs. A document that was nothing but later copies goes: all of it stands elsewhere. n_chars follows the text.
    Null and empty texts, and rows with a null id, stay as they are; rows equal in id and text keep the same lines; no rows give none."""
    out = lines.dedup_lines(packed(docs, column("doc_id").alias("doc_id"), column("text").alias("text")))
    left = F.coalesce(F.length(F.trim(F.translate("text", "\n\t\r", "   "))), F.lit(0)) > 0
    out = out.where((F.col("lines_removed") == 0) | left)
    chars = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("_row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, text=F.col("text"), n_chars=chars)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id: linked by SimHash, or by Jaccard similarity of five-word shingles from LIKE up.
    Texts without words are one group; rows with a null id stay, and so do all rows that share the smallest id; no rows give none."""
    return simhash.keep_first(docs, similarity=LIKE).select(*map(column, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the proportions of the mixture, in the order of its schedule; a document can come twice, or not at all. A null source is a source, null ids are ids;
    documents without words come once; rows equal in id and text stand for each other; no rows give none."""
    return mixing.mixed_documents(docs).select(*map(column, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens. Null and empty texts are an end mark alone; a document that comes twice is
    packed twice; no rows give none."""
    return packing.pack_documents(docs, most=2048).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the fitted classifier, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is dropped when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop_written(before)
        before = docs
    return docs
