"""A training corpus from raw documents: each stage takes what its predecessor kept.

Stages: toxicity (rejected documents go), line dedup (repeated three-line windows go, and documents that consist of nothing
else), n-gram Jaccard join (one document of each group of linked ones stays), benchmark decontamination (documents with a window
of any item go), SentencePiece encoding (ids, and a check that decoding gives the text back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm._common import materialize, table
from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.jaccard_join import keep_first
from riskweave.llm.line_dedup import dedup_lines
from riskweave.llm.sentencepiece_codec import encode
from riskweave.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, drop_emptied=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Toxicity fits a model and SentencePiece walks a lattice; SQL expresses neither. tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
