"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import bpe, clusters, fill_middle, media, mixing, ngram_join, pii, quality, sql, substring_dedup, token_count, token_store, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, at the top of the repository

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_pii": _on("documents", pii.op1),
        "op2_ngram_jaccard_join": _on("documents", lambda d: ngram_join.similar_documents(d.select("doc_id", "text"))),
        "op3_token_store": _on("documents", token_store.op3),
        "op4_substring_dedup": _on("documents", substring_dedup.op4),
        "op5_exact_top_k": _on("embeddings", topk.op5),
        "op6_quality_classifier": op6,
        "op7_url_filter": _on("pages", url_filter.op7),
        "op8_media": _on("documents", media.op8),
        "op9_mixing": _on("documents", mixing.op9),
        "op10_bpe": _on("documents", bpe.op10),
        "op11_token_counts": _on("documents", token_count.op11),
        "op12_clusters": _on("embeddings", clusters.op12),
        "op13_fill_middle": _on("documents", fill_middle.op13),
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": sql.NGRAM_JOIN,
        "op4_substring_dedup": sql.SUBSTRING_DEDUP,
        "op5_exact_top_k": topk.SQL,
        "op9_mixing": mixing.SQL,
        "op12_clusters": clusters.SQL,
        "op13_fill_middle": fill_middle.SQL,
    }
