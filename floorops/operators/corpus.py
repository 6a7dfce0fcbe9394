"""Corpus curation: verdicts, de-duplication, chunks, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _kept(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).withColumn("kept_path", F.first("path").over(w))


def dedup_exact(files: DataFrame) -> DataFrame:
    """Every file with the path that stands for its content: the first in (category, path) order."""
    return _kept(files, ["hash"], ["category", "path"]).select("path", "kept_path", (F.col("rn") > 1).alias("duplicate"))


def dedup_ranked(files: DataFrame) -> DataFrame:
    """One file per content: PDF before others, then category and path."""
    return _kept(files, ["hash"], [F.when(F.col("ext") == ".pdf", 0).otherwise(1), "category", "path"]).filter("rn = 1").select("path", "hash")


def dedup_pairs(files: DataFrame) -> DataFrame:
    """Of one category and stem: all PDFs if there are PDF and DOCX, else the largest."""
    group = W.partitionBy("category", "stem")
    both = F.max((F.col("ext") == ".pdf").cast("int")).over(group) + F.max((F.col("ext") == ".docx").cast("int")).over(group) == 2
    rn = F.row_number().over(group.orderBy(F.desc("size"), "path"))
    return files.select("path", "category", "stem", "ext", both.alias("both"), rn.alias("rn")).filter((F.col("both") & (F.col("ext") == ".pdf")) | (~F.col("both") & (F.col("rn") == 1))).select("path", "category", "stem", "ext")


def corpus_stats(chunks: DataFrame, source: str, has_vector) -> DataFrame:
    return chunks.agg(F.count_distinct(source).alias("sources"), F.count_distinct(F.when(has_vector, F.col(source))).alias("embedded"), F.count("*").alias("n_rows"))


def embed_progress(files: DataFrame, target: int | None = None) -> DataFrame:
    """Distinct files and chunks per category, with a total line, in one pass; with a ``target`` also the files' share of it in percent."""
    cat = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unknown"))
    got = files.withColumn("category", cat).rollup("category").agg(F.grouping("category").alias("g"), F.count_distinct("path").alias("files"), F.count("*").alias("chunks"))
    share = [] if target is None else [F.round(F.col("files") * 100.0 / target, 1).alias("share") if target else F.lit(0.0).alias("share")]
    return got.select(F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "files", "chunks", *share)


def filter_report(files: DataFrame) -> DataFrame:
    """Language and category counts in one pass."""
    got = files.groupingSets([["lang"], ["category"]], "lang", "category").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"))
    return got.select(F.when(F.col("g") == 0, "lang").otherwise("category").alias("dim"), F.when(F.col("g") == 0, F.col("lang")).otherwise(F.col("category")).alias("key"), "n")


def chunk_fixed(docs: DataFrame, size: int = 1000, overlap: int = 100, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap))
    rows = docs.filter(n > 0).select("*", F.posexplode(starts).alias("chunk_index", "_at"))
    return rows.withColumn("content", F.substring(F.col(text), F.col("_at"), F.lit(size))).drop("_at", text)


def changed(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Files that are new or have another hash than before."""
    k = known.select(key, F.col("hash").alias("old"))
    return files.join(k, key, "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).drop("old")


def pending(src: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return src.join(done.select(*keys), keys, "left_anti")


def upsert_chunks(target: DataFrame, new: DataFrame, source: str = "source_file", index: str = "chunk_index", keep: tuple[str, ...] = ("category", "created_at")) -> DataFrame:
    """Replace rows by (source, index) and drop a source's tail beyond its new last index.

    A row that is replaced keeps its old values of the columns ``keep``, as far
    as there are such.
    """
    old = [c for c in target.columns if c in keep]
    if old:
        before = target.select(source, index, F.struct(*old).alias("_old"))
        joined = new.join(before, [source, index], "left")
        new = joined.select(*[F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col(c)).alias(c) if c in old else F.col(c) for c in new.columns])
    last = new.groupBy(source).agg(F.max(index).alias("_last"))
    kept = target.join(new.select(source, index), [source, index], "left_anti").join(last, source, "left").filter(F.col("_last").isNull() | (F.col(index) <= F.col("_last"))).drop("_last")
    return kept.unionByName(new)


def replace_sources(target: DataFrame, new: DataFrame, source: str = "source_file") -> DataFrame:
    return target.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def progress_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    got = rows.groupBy("category").pivot("status", statuses).agg(F.count(F.lit(1)))
    return got.na.fill(0)


def progress_report(files: DataFrame, statuses: list[str], done: tuple[str, ...] = ("embedded", "skipped", "parsed")) -> DataFrame:
    """Files (path, status) by status, in total and done, with the share done in percent: a line for each category and one overall.

    The category is a path's first folder, ``unknown`` for a bare name; a
    missing status is ``pending``; statuses of other names count in the total.
    """
    status = F.coalesce("status", F.lit("pending"))
    category = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("unknown")
    rows = files.select(category.alias("category"), status.alias("status"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    got = rows.rollup("category").agg(F.grouping("category").alias("g"), *counts, F.count("*").alias("total"), F.count_if(F.col("status").isin(*done)).alias("done"))
    share = F.when(F.col("total") > 0, F.round(F.col("done") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    return got.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), *statuses, "total", "done", share.alias("done_pct"))
