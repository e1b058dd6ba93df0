"""A corpus pipeline of five stages over `documents`; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelark.llm.op01_line_dedup import lines_stage
from tidelark.llm.op02_pieces import pieces_stage
from tidelark.llm.op03_language import language_stage
from tidelark.llm.op07_mixing import mixing_stage
from tidelark.llm.op08_minmax_dedup import dedup_stage
from tidelark.llm.shared import cut

STAGES = [
    ("language", language_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Compression, min-max hashing and SentencePiece are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
