"""From raw documents to a training mixture: five stages, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents, and more columns pass through all of them.

Null texts and those without a letter go in the first stage, so the others
meet none in the pipeline; called alone, they count as empty texts, which are
equal to each other and contaminated by nothing. Of rows that repeat an id and
a text one is left by the second or third stage. Null ids rank last. An empty
table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontaminate, exact, language, mixing, neardup
from gridlore.llm._common import free_name, shared_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told ("und": null texts and those without a letter) go, and no others, even if nothing is learned."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held))
    if not model.parsers:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return language.identify(docs, model, "text", lang, score).where(F.col(lang) != "und").drop(lang, score)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one with the smallest id stays."""
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at 0.8 of five-word shingles, one document stays."""
    return neardup.near_dedup(docs, width=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in a random order."""
    return mixing.poisson_mix(docs, alpha=0.5, epochs=1.0, seed=42)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mixing", mixing_stage),
]

#: Suffix automata, SimHash and sketches have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/gridlore/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
