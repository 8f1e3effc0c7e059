"""A pipeline over the documents table; each stage is written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.decontaminate import decontaminated
from fleetlens.llm.jaccard_join import without_near_copies
from fleetlens.llm.sentencepiece_viterbi import encode
from fleetlens.llm.shared import Scratch, documents
from fleetlens.llm.substring_dedup import substring_dedup
from fleetlens.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays; every row is judged by its own text."""
    return without_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that an earlier document (or place) has are cut out; n_chars follows the text."""
    out = substring_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of what is left."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_items),
    ("sentencepiece", encode_pieces),
]
#: Trained scores and encodings are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
