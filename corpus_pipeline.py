"""The corpus pipeline: each stage gets the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orpheon.llm.common import release, stored, table, written
from orpheon.llm.decontaminate import decontamination_stage
from orpheon.llm.language_id import language_stage
from orpheon.llm.line_dedup import line_stage
from orpheon.llm.near_dedup import near_duplicate_stage
from orpheon.llm.sentencepiece import encode_stage

#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's documents.
STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encode_stage),
]

#: SQL cannot express the stages (a learned classifier, edit distances, a Viterbi path); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted once its successor's documents are written."""
    docs, first = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
        release(spark, since=first, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
