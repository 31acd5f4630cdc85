"""One query for each operator over its whole table, and the SQL that DuckDB can run for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import DEDUP_SQL
from .mixing import TAKEN_SQL
from .sharding import SHARDS_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(_docs(spark, sf_dir), shingle_words=3, distance=3)
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _is(kind: str):
    """The element if it is kind, else null."""
    return lambda x: F.when(x == kind, x)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, train

    docs = _docs(spark, sf_dir)
    found = find_personal_data(docs, train(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.array_compact(F.transform("base.kind", _is(k)))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("bigint").alias("n_added")
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), added)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    rows = assign_shards(_docs(spark, sf_dir), shards=40)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_docs(spark, sf_dir), min_words=10)
    return out.select("doc_id", "lines_before", "lines_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"), "n_runs", "longest_run")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fuzzy import compare_edits

    return compare_edits(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraphs import repeated_paragraphs

    return repeated_paragraphs(_docs(spark, sf_dir), similarity=0.8).withColumnRenamed("doc", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score, train

    docs = _docs(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)
    return found.withColumnRenamed("id", "vec_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), most=2048).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_docs(spark, sf_dir), weights=(5, 2, 1), share=1.5, most=2.0).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_slots")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_fingerprints, op4_substring_dedup, op5_quality, op6_embeddings, op7_packing, op8_mixing, op9_pii, op10_sharding)}

ORACLES: dict[str, str] = {"op2_line_dedup": DEDUP_SQL, "op8_mixing": TAKEN_SQL, "op10_sharding": SHARDS_SQL}
