"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import documents

_PIECES = "piece_bpe_32k.model"


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality_rules(documents(spark, sf_dir)).select(*columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_hits

    return benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    columns = "doc_id n_words n_base first_word last_word base_labels labels score".split()
    return license_scan(documents(spark, sf_dir)).select(*columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_viterbi import encode

    return encode(documents(spark, sf_dir), public_tokenizers.path(_PIECES))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked_search

    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    found = (
        op1_quality_classifier, op2_substring_dedup, op3_jaccard_join, op4_token_counts, op5_quality_rules, op6_benchmark_decontamination,
        op7_license_scan, op8_toxicity, op9_sentencepiece, op10_url_filter, op11_source_mix, op12_ranked_search, op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express.  The others (trained models, tokenizers, edit distance, hashed cuts) are tested against brute force."""
    from . import sql

    found = {"op3_jaccard_join": sql.JACCARD, "op5_quality_rules": sql.QUALITY, "op7_license_scan": sql.LICENSE}
    return found | {"op11_source_mix": sql.MIX, "op12_ranked_search": sql.SEARCH, "op13_hard_negatives": sql.NEGATIVES}
