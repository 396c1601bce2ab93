"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage works on all that its predecessor kept, and its decisions take effect on the next one.

Defined results: null, blank and very short texts fail the quality rules and go; so do texts that repeat themselves. Rows
without id or source are documents like any other: near-dedup keeps such a row where no named one is in its group, no
passage of it is cut, and its source is one of its own, last in order. Of rows that repeat an id in a group the first by text stays. A document that
substring dedup empties stays with an empty text, of which the mix takes nothing. Texts of any length are taken whole. Documents that
the mix takes twice or three times come as often. An empty table gives an empty result. Extra columns pass through all stages
but the last, which returns the id with counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdica.llm import bpe, mixing, quality, simhash, substring
from verdica.llm.common import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document stays even if nothing of it is left."""
    cut = substring.dedup(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In smaller batches than alone: the executors' heaps have grown by then."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, batch_bytes=2 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing_sources),
    ("byte-level BPE", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
