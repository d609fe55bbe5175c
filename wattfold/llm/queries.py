"""Registered queries of the operators: each one over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.llm import ann, centroids, chatfmt, decontam, divergence, extract, langid, linededup, mixing, pii, quality, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.coalesce(_fold(3), F.lit(0)) == 1).alias("held_out"))
    return langid.predict(docs, langid.learn(docs.where("not held_out")), ["doc_id", "held_out"])


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(_fold(5) != 0)
    made = toxicity.score(docs, toxicity.learn(docs, labels)).withColumnRenamed("id", "doc_id")
    return made.withColumns({"held_out": F.coalesce(_fold(5) == 0, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -1L conv_id, turn, role, :own text from values (0L, 'user'), (1L, 'assistant') t(turn, role)", {"own": own})
    ranks = chatfmt.vocabulary(spark)
    made = chatfmt.read_back(chatfmt.format_turns(given.unionByName(extra), ranks), ranks)
    return made.drop("n_tokens", "loss_tokens")  # what a vocabulary makes of the texts has no counterpart in SQL


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_pii_surrogates,
        op3_quality_classifier,
        op4_toxicity,
        op5_source_mixing,
        op6_multiprobe_ann,
        op7_simhash_dedup,
        op8_benchmark_decontamination,
        op9_html_extraction,
        op10_chat_formatting,
        op11_line_dedup,
        op12_centroid_clustering,
        op13_source_divergence,
    )
}
