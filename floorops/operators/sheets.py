"""Chunks of spreadsheets, cut at prefix sums of row lengths, so that a sheet of any size spreads over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.functions.verdicts import ustrip


def _bucket(rows: DataFrame, order: str, buckets: int) -> Column:
    """A number that rises with ``order`` and parts the table's rows about evenly; its bounds are a fixed number of percentiles."""
    marks = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx(order, marks, 10_000)).first()[0] if marks else []
    bounds = sorted(set(bounds or []))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)


def chunk_sheets(rows: DataFrame, sheet: list[str], order: str, cells: list[str], size: int = 1000, overlap: int = 100, buckets: int | None = None) -> DataFrame:
    """(sheet..., chunk_index, content): a sheet's non-empty rows, cells joined by `` | `` under its name, in chunks of ``size``.

    The rows of a sheet are one paragraph, the heading ``## name`` another:
    if both fit together they are one chunk, else the rows are cut into windows
    of ``size`` characters, each ``size - overlap`` after the one before. Blank
    lines inside a cell become line breaks.

    Where a row lies in its sheet is a prefix sum of the lengths before it: in
    a bucket of rows by a window, between buckets by their totals. Each row
    gives its pieces to the windows it reaches, and a window gathers ``size``
    characters at most, so no task holds a sheet. ``order`` is a number, a date
    or a time without repeats.
    """
    step = size - overlap
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws(" | ", *[F.nullif(ustrip(F.col(c).cast("string")), F.lit("")) for c in cells])
    lines = rows.select(*sheet, F.col(order).alias("_order"), _bucket(rows, order, n).alias("_bucket"), F.regexp_replace(text, r"\n{2,}", "\n").alias("_line"))
    lines = lines.filter("_line <> ''").withColumn("_n", F.char_length("_line").cast("long") + 1)

    totals = lines.groupBy(*sheet, "_bucket").agg(F.sum("_n").alias("_sum"))
    whole = W.partitionBy(*sheet)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).withColumn("_chars", F.sum("_sum").over(whole) - 1)

    keys = [*sheet, "_bucket"]
    other = totals.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], "_base", "_chars")
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)])
    inner = W.partitionBy(*keys).orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("_at", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(other, same).withColumn("_at", F.col("_at") + F.col("_base"))

    single = F.col("_chars") <= size
    end = F.least(F.col("_at") + F.col("_n"), F.col("_chars"))  # the last line break does not count
    first = F.when(single, F.lit(0)).otherwise(F.greatest(F.lit(0), F.expr(f"(_at - {size}) div {step}") + F.when(F.col("_at") >= size, 1).otherwise(0)))
    last = F.when(single, F.lit(0)).otherwise(F.floor((end - 1) / step))

    def piece(k: Column) -> Column:
        a, b = F.greatest(F.col("_at"), k * step), F.least(end, F.when(single, F.col("_chars")).otherwise(k * step + size))
        return F.struct(k.alias("_k"), F.substring(F.concat("_line", F.lit("\n")), (a - F.col("_at") + 1).cast("int"), (b - a).cast("int")).alias("_piece"))

    cut = placed.withColumn("_cut", F.explode(F.transform(F.sequence(first.cast("long"), last.cast("long")), piece))).select(*sheet, "_chars", "_at", "_cut.*")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), "")
    made = cut.groupBy(*sheet, "_chars", "_k").agg(joined.alias("_text"))

    head = F.concat(F.lit("## "), F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in sheet]))
    width = F.char_length(head)
    apart = width + F.col("_chars") + 1 > size
    # a heading longer than a chunk is cut as any paragraph is
    heads = F.transform(F.sequence(F.lit(0), F.when(width <= size, F.lit(0)).otherwise(F.floor((width - 1) / step).cast("int"))), lambda i: F.substring(head, (i * step + 1).cast("int"), F.lit(size)))
    here = F.struct(F.when(apart, F.size(heads) + F.col("_k")).otherwise(0).cast("int").alias("chunk_index"), F.when(apart, F.col("_text")).otherwise(F.concat(head, F.lit("\n\n"), F.col("_text"))).alias("content"))
    above = F.transform(heads, lambda h, i: F.struct(i.cast("int").alias("chunk_index"), h.alias("content")))
    out = F.when(apart & (F.col("_k") == 0), F.concat(above, F.array(here))).otherwise(F.array(here))
    return made.select(*sheet, F.explode(out).alias("_out")).select(*sheet, "_out.*")
