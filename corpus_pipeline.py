"""The corpus pipeline: five stages of the training-data operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, neardup, quality, token_store
from quillspark.llm.common import read_documents, store
from quillspark.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


#: The stage takes pairs from 80 % on (op6_neardup from 85 %); a pair at 80 % shares no band with a chance of 6e-7.
NEAR = neardup.NearParams(percent=80, bands=36, rows=5)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_first(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their targets: a document has as many rows as it is drawn times."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids are stored by content and read back: doc_id, start, n_tokens, ids_crc32, verified."""
    return token_store.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token store", token_stage),
]

#: The stages are not expressible in SQL as a whole; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage{k}")
    return docs
