"""The corpus pipeline: documents through the stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.decontaminate import remove_passages
from tallyfield.llm.line_dedup import drop_repeated_lines
from tallyfield.llm.mixing import take_mix
from tallyfield.llm.ngram_join import keep_one
from tallyfield.llm.quality import keep_good
from tallyfield.llm.registry import table
from tallyfield.session import cut_lineage


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays."""
    return _recounted(drop_repeated_lines(docs))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, five words and a similarity of 0.8, the smallest id stays."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; every document stays."""
    return _recounted(remove_passages(docs, table(spark, sf_dir, "benchmark")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes words of, with their size, target and words taken."""
    return take_mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
]

# stages 1 and 5 hash texts in ways SQL engines do not share; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
