"""The removal funnel of a folder of manuals: drafts, equal contents, pairs of one name; and sketches of what a corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.functions.verdicts import classify_filename, is_draft

STAGES = ("draft", "hash_duplicate", "docx_pdf_pair", "same_stem_duplicate")
#: log2 of a sketch's registers; its error is some 1.04 / sqrt(2 ** this), below one in a hundred.
REGISTERS = 14


def funnel(files: DataFrame, name: str = "name") -> DataFrame:
    """``files`` (path, category, stem, ext, size, hash) with ``removed_by``, the first stage that removes the row, null for survivors.

    Drafts and copies by name go first; of equal contents the first stays (PDF
    before others, then category and path); of one category and stem all PDFs
    stay where there are PDF and DOCX, else the largest. A stage looks at what
    those before it left. One scan, and a shuffle for each of the last two
    stages.
    """
    pdf = F.col("ext") == ".pdf"
    rows = files.withColumn("_draft", F.coalesce(is_draft(F.col(name)), F.lit(False)))
    first = F.row_number().over(W.partitionBy("hash", "_draft").orderBy(F.when(pdf, 0).otherwise(1), "category", "path")) == 1
    rows = rows.withColumn("_left", ~F.col("_draft") & (first | F.col("hash").isNull()))
    group = W.partitionBy("category", "stem", "_left")
    both = (F.max((F.col("ext") == ".pdf").cast("int")).over(group) + F.max((F.col("ext") == ".docx").cast("int")).over(group)) == 2
    rows = rows.withColumn("_both", both).withColumn("_rn", F.row_number().over(group.orderBy(F.desc("size"), "path")))
    removed = F.when(F.col("_draft"), STAGES[0]).when(~F.col("_left"), STAGES[1]).when(F.col("_both") & ~pdf, STAGES[2]).when(~F.col("_both") & (F.col("_rn") > 1), STAGES[3])
    return rows.withColumn("removed_by", removed).drop("_draft", "_left", "_both", "_rn")


def funnel_report(tagged: DataFrame) -> DataFrame:
    """(dim, key, n) of a funnel: ``input``, ``removed`` by each stage, ``output``, and the survivors by language and category, in one pass."""
    stages = tagged.groupBy("removed_by", "lang", "category").agg(F.count("*").alias("n"))
    kept = F.col("removed_by").isNull()
    lines = F.array(
        F.struct(F.lit("input").alias("dim"), F.lit("all").alias("key")),
        F.when(kept, F.struct(F.lit("output").alias("dim"), F.lit("all").alias("key"))).otherwise(F.struct(F.lit("removed").alias("dim"), F.col("removed_by").alias("key"))),
        F.when(kept, F.struct(F.lit("lang").alias("dim"), F.col("lang").alias("key"))),
        F.when(kept, F.struct(F.lit("category").alias("dim"), F.col("category").alias("key"))),
    )
    return stages.select("n", F.explode(F.array_compact(lines)).alias("line")).groupBy("line.dim", "line.key").agg(F.sum("n").alias("n"))


def write_survivors(tagged: DataFrame, path: str) -> dict[str, int]:
    """Write a funnel's survivors by category, and return how many rows came in, went at each stage and came out, counted on the way."""
    seen = Observation("funnel")
    counts = [F.count("*").alias("input"), *[F.count_if(F.col("removed_by") == s).alias(s) for s in STAGES], F.count_if(F.col("removed_by").isNull()).alias("output")]
    rows = tagged.observe(seen, *counts).filter("removed_by is null").drop("removed_by")
    rows.write.mode("overwrite").partitionBy("category").parquet(path)
    return seen.get


def corpus_sketches(chunks: DataFrame, source: str, has_vector: Column, day: str | Column) -> DataFrame:
    """(day, n_rows, sources, embedded): a day's rows and sketches of its sources, all and those with a vector, to be kept and merged."""
    name = F.col(source).cast("string")
    day = F.col(day) if isinstance(day, str) else day
    return chunks.groupBy(day.alias("day")).agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg(name, REGISTERS).alias("sources"), F.hll_sketch_agg(F.when(has_vector, name), REGISTERS).alias("embedded")
    )


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """(sources, embedded, n_rows) of sketches of any days: the numbers of sources are estimates, rows are exact, and no chunk is read."""
    sizes = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("sources", "embedded")]
    return sketches.agg(*[F.coalesce(s, F.lit(0)).alias(c) for s, c in zip(sizes, ("sources", "embedded"), strict=True)], F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def classified(files: DataFrame, name: str = "name") -> DataFrame:
    """``files`` (path, category, hash) with ``verdict``: manual, excluded or duplicate, and ``reason``, the rule that spoke.

    Only manuals can be duplicates: of equal contents the first by category and path stays.
    """
    rows = files.withColumn("_v", classify_filename(F.col(name))).withColumn("_m", F.coalesce(F.col("_v")["is_manual"], F.lit(False)))
    first = F.row_number().over(W.partitionBy("hash", "_m").orderBy("category", "path")) == 1
    verdict = F.when(~F.col("_m"), "excluded").when(first | F.col("hash").isNull(), "manual").otherwise("duplicate")
    return rows.withColumn("verdict", verdict).withColumn("reason", F.col("_v")["reason"]).drop("_v", "_m")


def classification_report(rows: DataFrame) -> DataFrame:
    """(dim, key, total, manual, excluded, duplicate) of classified files: overall, by category, and by the reason of excluded ones."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("manual", "excluded", "duplicate")]]
    rows = rows.select("category", "verdict", F.when(F.col("verdict") == "excluded", F.col("reason")).alias("reason"))
    got = rows.groupingSets([[], ["category"], ["reason"]], "category", "reason").agg(F.grouping_id("category", "reason").alias("g"), *counts)
    dim = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "category").otherwise("reason")
    key = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.col("category")).otherwise(F.col("reason"))
    return got.filter("g <> 2 or reason is not null").select(dim.alias("dim"), key.alias("key"), "total", "manual", "excluded", "duplicate")
