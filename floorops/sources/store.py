"""A folder of chunks that takes upserts by rewriting only the partitions that a batch touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorops.operators.corpus import upsert_chunks


def part_of(source: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(parts)).cast("int")


def _stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All rows of the newest version of each part, the marker rows of their batches too; None if nothing is stored."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    marks = rows.filter("_mark")
    if before is not None:
        marks = marks.filter(F.col("_batch") < before)
    newest = marks.groupBy("_part").agg(F.max_by("_slot", "_batch").alias("_slot"))
    return rows.join(newest, ["_part", "_slot"], "left_semi")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that ``write_chunks`` has left in ``path``."""
    rows = _stored(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows.filter("not _mark").drop("_part", "_slot", "_batch", "_mark")


def write_chunks(new: DataFrame, path: str, batch: int, sources: DataFrame | None = None, parts: int = 256, source: str = "source_file", index: str = "chunk_index") -> None:
    """Upsert a batch of chunks into the folder: ``upsert_chunks``, and away with the chunks of ``sources`` that now have none.

    A chunk lies in the part that the hash of its source names. Of the parts
    that a batch touches, the rows are read, changed and written anew, by
    Spark's dynamic partition overwrite; files of other parts are not touched,
    whatever the size of the folder.

    A part has two slots, and a batch writes to the one that does not hold the
    newest version from before it. So a batch that runs again, after a crash
    too, starts from the same rows and writes the same result; a write that is
    torn leaves the older version readable; and no more than two versions of a
    part ever exist. ``batch`` numbers must rise, as those of a stream's
    checkpoint do.
    """
    spark = new.sparkSession
    named = new.select(source) if sources is None else new.select(source).unionByName(sources.select(source))
    named = named.filter(F.col(source).isNotNull()).distinct().withColumn("_part", part_of(F.col(source), parts))
    touched = named.select("_part").distinct()
    old = _stored(spark, path, batch)
    rows = new.filter(F.col(source).isNotNull())
    if old is not None:
        slots = old.filter("_mark").select("_part", (1 - F.col("_slot")).alias("_slot"))
        old = old.filter("not _mark").join(touched, "_part", "left_semi").drop("_part", "_slot", "_batch", "_mark")
        bare = named.select(source).join(rows.select(source), source, "left_anti")
        old = old.join(bare, source, "left_anti")
        for c in set(rows.columns) - set(old.columns):
            old = old.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        for c in set(old.columns) - set(rows.columns):
            rows = rows.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
        rows = upsert_chunks(old, rows.select(*old.columns), source, index)
        touched = touched.join(slots, "_part", "left")
    else:
        touched = touched.withColumn("_slot", F.lit(0))
    touched = touched.select("_part", F.coalesce("_slot", F.lit(0)).cast("int").alias("_slot"), F.lit(batch).cast("long").alias("_batch"))
    marks = touched.withColumn("_mark", F.lit(True))
    rows = rows.withColumn("_part", part_of(F.col(source), parts)).join(touched, "_part").withColumn("_mark", F.lit(False))
    out = rows.unionByName(marks, allowMissingColumns=True)
    out = out.hint("rebalance", "_part")  # a part to a task, unless it is large
    out.write.partitionBy("_part", "_slot").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
