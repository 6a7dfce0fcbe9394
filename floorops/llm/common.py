"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and driver and executors are one process
    (local tests) is a temporary folder used; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders by a column if one is named, and read it back.

    Cuts the lineage, keeps the result when executors are lost, and lets later
    passes read single columns. Spark is told to remove the shuffle files of
    the write at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/floorops-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add.

    Names compare as Spark compares them, so an input column ``Shard`` clashes
    with a new ``shard`` and gives way to it.
    """
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df if len(keep) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in keep])


def sheltered(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``used`` under neutral names, and a function that gives them back, in place.

    For operators that add columns or replace clashing ones: what they return
    can be turned into rows with exactly the columns of ``df``.
    """
    neutral = {c: c if c in used else f"in_{i}_" for i, c in enumerate(df.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) if n != c else F.col(f"`{c}`") for c, n in neutral.items()])

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in neutral.items()]), back


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: str, mod: int):
    """crc32 of an id's decimal text, modulo ``mod``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def labelled_sample(labels: DataFrame, target: str, keep, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``bound`` labelled ids of each class: (id, y, weight).

    ``keep`` is the condition that training rows fulfil. Contradicting labels
    of one id are averaged, ties counting as 1; null ids and labels are left
    out. Above ``bound`` rows of a class are picked by a hash of their id, so
    that the choice repeats; ``weight`` is how many labelled ids of its class a
    row stands for (counted / kept, 1 in a class that is whole), so that weighted
    sums have the class rate of all labels. The result's size is bounded by
    ``2 * bound`` short rows, which is why callers may broadcast it.
    """
    rows = (
        labels.filter(F.col(id_col).isNotNull() & F.col(target).isNotNull())
        .filter(keep)
        .groupBy(id_col)
        .agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("y"))
    )

    def counted(of: DataFrame) -> dict[int, int]:
        return {r["y"]: r["n"] for r in of.groupBy("y").agg(F.count("*").alias("n")).collect()}

    counts = counted(rows)
    if max(counts.values(), default=0) <= bound:
        return rows.withColumn("weight", F.lit(1.0))
    share = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))
    limit = F.lit(0)
    for y in (0, 1):
        cut = (1 << 20) if counts.get(y, 0) <= bound else int((1 << 20) * bound / counts[y])
        limit = F.when(F.col("y") == y, F.lit(cut)).otherwise(limit)
    some = rows.filter(share < limit)
    weight = F.lit(1.0)
    for y, kept in counted(some).items():
        weight = F.when(F.col("y") == y, F.lit(counts[y] / kept)).otherwise(weight)
    return some.withColumn("weight", weight)
