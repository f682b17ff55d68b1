"""The registered queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import bpe, collocations, decontamination, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, near_dedup, periodic_runs, pii, sharding, url_filter
from wayloom.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """Where the public tokenizer file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents")).select("row.doc_id", "n_entities", "kinds", "text")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages")).withColumn("score", F.round(F.col("score") + 1.3e-8, 6))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encoding(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), limits=line_dedup.LIMITS)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_assignment(table(spark, sf_dir, "documents")).select("row.doc_id", "n_bytes", "shard", "depth", "page", "shard_bytes", "oversize")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One text in ten, by the CRC of its doc_id, repeats some of its words from a place on; the others stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    g, n = F.floor(h / 10), F.size("words")
    a = (F.col("g") % F.greatest("n", F.lit(1))).cast("int")
    p = (F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1).cast("int")
    placed = docs.withColumn("words", words).withColumns({"g": g, "n": n}).withColumn("a", a).withColumn("p", p)
    repeated = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> if(i < a, words[i], words[a + (i - a) % p])))")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = str(Path(__file__).resolve().parent.parent.parent)
    if root not in sys.path:
        sys.path.insert(0, root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_surrogates, op3_minhash_near_dedup, op4_url_filter, op5_html_text, op6_decontamination, op7_bpe, op8_line_dedup, op9_sharding, op10_language_id,
        op11_embedding_near_dedup, op12_collocations, op13_periodic_runs, pipeline,
    )
}
ORACLE = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op11_embedding_near_dedup": embedding_dedup.OP11_SQL, "op12_collocations": collocations.OP12_SQL, "op4_url_filter": url_filter.url_sql(), "op9_sharding": sharding.OP9_SQL}
