"""Byte-balanced sharding by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import partitions, without


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Cut ``docs`` into ``n_shards`` contiguous shards of near equal bytes.

    Adds ``size`` (UTF-8 bytes of the text plus one), ``shard`` (0 to
    ``n_shards - 1``) and ``slot`` (place in the shard, gapless from 0).

    The global order is (bucket, id, size, text hash), where the bucket hashes
    id and size. The first pass sums the bytes and rows of each bucket; their
    prefix sums give every bucket its global offset. A row belongs to the shard
    in whose equal share of all bytes its first byte lies, so no shard is off
    its share by more than one document. Only buckets that a cut runs through
    (fewer than ``n_shards``) are read a second time, to learn how many of
    their rows lie before the cut. The driver sees one line of totals for each
    bucket and no rows.

    Defined cases: a null text has size 1; a null id sorts first; repeated rows
    are rows like others; an empty table gives an empty result; input columns
    called like the new ones are replaced.
    """
    spark = docs.sparkSession
    b = buckets or 4 * partitions(spark)
    d = without(docs, "size", "shard", "slot", "_bucket", "_tie")
    d = d.withColumn("size", (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long"))
    d = d.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col), F.col("size")), F.lit(b)).cast("int"))

    totals = {r[0]: (r[1], r[2]) for r in d.groupBy("_bucket").agg(F.sum("size"), F.count("*")).collect()}
    total = sum(v[0] for v in totals.values())
    offsets, start, row = [], 0, 0
    for k in sorted(totals):
        offsets.append((k, start, row, start + totals[k][0], totals[k][1]))
        start, row = start + totals[k][0], row + totals[k][1]
    base = spark.createDataFrame([o[:3] for o in offsets], "_bucket int, _start long, _row long")

    in_bucket = W.partitionBy("_bucket").orderBy(F.col(id_col).asc_nulls_first(), "size", "_tie")
    before = in_bucket.rowsBetween(W.unboundedPreceding, -1)

    def placed(rows: DataFrame) -> DataFrame:
        """_at: the row's global number; shard by its first byte. ``base`` has one short line a bucket."""
        return (
            rows.withColumn("_tie", F.xxhash64(F.col(text_col)))
            .join(F.broadcast(base), "_bucket")
            .withColumn("_first", F.col("_start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
            .withColumn("_at", F.col("_row") + F.row_number().over(in_bucket) - 1)
            .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"_first * {n_shards}L div {max(1, total)}L")).cast("int"))
        )

    def cut(first: int) -> int:
        return min(n_shards - 1, first * n_shards // max(1, total))

    # a bucket whose first and last possible byte fall into one shard needs no second look
    crossed = [o for o in offsets if cut(o[1]) != cut(max(o[1], o[3] - 1))]
    firsts: dict[int, int] = {}
    for _, lo, at, _, _ in offsets:
        firsts[cut(lo)] = min(at, firsts.get(cut(lo), at))
    if crossed:
        inside = placed(d.filter(F.col("_bucket").isin([o[0] for o in crossed])))
        for shard, at in inside.groupBy("shard").agg(F.min("_at")).collect():
            firsts[shard] = min(at, firsts.get(shard, at))
    heads = F.lit(0)
    for shard, at in firsts.items():
        heads = F.when(F.col("shard") == shard, F.lit(at)).otherwise(heads)
    out = placed(d).withColumn("slot", (F.col("_at") - heads).cast("long"))
    return out.drop("_bucket", "_start", "_row", "_first", "_at", "_tie")
