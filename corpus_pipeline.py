"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
reread as the next one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import lines, mixing, neardup, packing, quality
from corpusloom.llm.common import table
from corpusloom.llm.queries import tokenizer_path
from corpusloom.session import forget, forget_since, made, stored


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that keep no word go."""
    return recounted(lines.dedup_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: Jaccard similarity of five-word shingles 0.8 or more, SimHash first."""
    return neardup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken."""
    return recounted(mixing.mixed_documents(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Links, components, schedules and packings are beyond SQL; a brute-force test takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each reading what the one before wrote; what a stage wrote beside its documents goes with it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, number = docs, made(spark)
        docs = stored(stage(spark, docs, sf_dir), name)
        forget_since(spark, number, docs)
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
