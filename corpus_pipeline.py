"""The curation pipeline: quality, repeated lines, near copies, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorops.llm.common import crc_mod, materialize, sheltered
from floorops.llm.decontamination import benchmark_hits
from floorops.llm.lines import dedup_lines
from floorops.llm.packing import pack
from floorops.llm.quality import keep_quality
from floorops.llm.simhash import dedup_simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose calibrated quality score is below 0.3.

    Null and empty texts are scored as empty ones; rows with one id and text
    stay or go together; all columns come through, whatever their names.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 5) != 0)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that have an earlier match; ``n_chars`` follows the text, and documents without a line left go.

    Null and empty texts stay; null ids come first in the order of documents;
    all columns come through, whatever their names.
    """
    hidden, back = sheltered(docs, "doc_id", "text")
    out = dedup_lines(hidden)
    out = back(out.filter(F.size("removed") < F.greatest("n_lines", F.lit(1))))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest id; null, empty and word-free texts are one group."""
    return dedup_simhash(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window; null and empty texts stay; all columns come through."""
    hidden, back = sheltered(docs, "doc_id", "text")
    return back(benchmark_hits(hidden, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4,096 tokens."""
    out = pack(docs, 4096)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each writing what the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
