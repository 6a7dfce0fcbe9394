"""Feedback on cached answers: scores that are clipped at every step, folded in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores are kept as ten-thousandths, so that sums are exact.
UNIT = 10_000
#: Stands for no bound.
FAR = 1 << 60


def compose(key: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step for each key of steps in order, keys lying together.

    A step takes x to min(high, max(low, x + shift)), and two such steps are
    one such step. Neighbours are joined in pairs until one is left of each
    key, some twice as much work as there are steps.
    """
    while len(key) > 1 and (key[1:] == key[:-1]).any():
        first = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero(place % 2 == 0)
        right = np.minimum(left + 1, len(key) - 1)
        both = (right > left) & (key[right] == key[left])
        lo2, hi2, s2 = (np.where(both, x[right], y) for x, y in ((low, -FAR), (high, FAR), (shift, 0)))
        low, high = (np.clip(np.where(np.abs(x[left]) < FAR, x[left] + s2, x[left]), lo2, hi2) for x in (low, high))
        key, shift = key[left], shift[left] + s2
    return key, low, high, shift


def _fold(up: int, down: int):
    """Arrow batches (key, good), sorted by key and time -> one step for each key of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        kept = None  # the last key may go on in the next batch

        def steps(keys: pa.Array, number: np.ndarray, *step: np.ndarray):
            number, low, high, shift = compose(number, *step[:3])
            good, bad = (np.bincount(step[3], step[i], len(number)).astype(np.int64) for i in (4, 5))
            return pa.RecordBatch.from_arrays([keys, *map(pa.array, (np.full(len(number), chunk), low, high, shift, good, bad))], names=["key", "chunk", "low", "high", "shift", "good", "bad"])

        for batch in batches:
            if not batch.num_rows:
                continue
            good = batch.column(1).to_numpy(zero_copy_only=False)
            keys, n = batch.column(0), batch.num_rows
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            low, high, shift = np.where(good, -FAR, 0), np.where(good, UNIT, FAR), np.where(good, up, -down)
            goods, bads = good.astype(np.int64), 1 - good.astype(np.int64)
            if kept is not None:
                if kept.column(0)[0] == keys[0] or (not kept.column(0)[0].is_valid and not keys[0].is_valid):
                    old = [kept.column(i).to_numpy() for i in (2, 3, 4, 5, 6)]
                    low, high, shift, goods, bads = (np.concatenate([a, b]) for a, b in zip(old, (low, high, shift, goods, bads), strict=True))
                    code = np.concatenate([code[:1], code])
                    keys, n = pa.concat_arrays([keys.slice(0, 1), keys]), n + 1
                else:
                    yield kept
            first = np.concatenate([[True], code[1:] != code[:-1]])
            number = np.cumsum(first) - 1
            out = steps(keys.take(pa.array(np.flatnonzero(first))), number, low, high, shift, number, goods, bads)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            kept = out.slice(out.num_rows - 1)
        if kept is not None:
            yield kept

    return run


def feedback_steps(events: DataFrame, key: str, good: Column, order: list[str], bad: Column | None = None, up: float = 0.05, down: float = 0.15) -> DataFrame:
    """(key, steps, good_count, bad_count): what the events of each key do to a score, as at most one step a partition, in order.

    Events are ranged by key and time, so a key with very many of them lies in
    many partitions, and each partition composes its own into one step
    (low, high, shift). Nothing gathers the events of a key. Events that are
    neither good nor bad, or null, count for nothing.
    """
    bad = ~good if bad is None else bad
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.when(good, True).when(bad, False).alias("good"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).filter("good is not null")
    by = ["key", *[f"o{i}" for i in range(len(order))]]
    ranged = rows.repartitionByRange(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    steps = ranged.select("key", "good").mapInArrow(_fold(round(up * UNIT), round(down * UNIT)), f"key {kind}, chunk long, low long, high long, shift long, good long, bad long")
    listed = F.sort_array(F.collect_list(F.struct("chunk", "low", "high", "shift")))
    return steps.groupBy("key").agg(listed.alias("steps"), F.sum("good").alias("good_count"), F.sum("bad").alias("bad_count"))


def after(score: Column, steps: Column) -> Column:
    """A score after its steps."""
    start = F.round(score * UNIT).cast("long")
    return F.aggregate(steps, start, lambda x, s: F.least(s["high"], F.greatest(s["low"], x + s["shift"]))) / UNIT


def feedback_fold(events: DataFrame, key: str, good: Column, order: list[str], start: float = 0.5, bad: Column | None = None) -> DataFrame:
    """Score per key from ``start``: good adds .05 up to 1, bad takes .15 down to 0, in event order."""
    steps = feedback_steps(events, key, good, order, bad)
    return steps.select(F.col("key").alias(key), F.round(after(F.lit(start), F.col("steps")), 4).alias("score"), "good_count", "bad_count")


def apply_feedback(cache: DataFrame, events: DataFrame, rating: str, order: list[str], key: str = "id") -> DataFrame:
    """The answer cache (key, score, good_count, bad_count, ...) after ratings ``good`` and ``bad`` in event order.

    Other ratings, and ratings of answers that the cache does not hold, change nothing.
    """
    steps = feedback_steps(events, key, F.col(rating) == "good", order, F.col(rating) == "bad").withColumnsRenamed({"good_count": "_good", "bad_count": "_bad", "key": "_key"})
    joined = cache.join(steps, cache[key] == steps["_key"], "left")
    new = {"score": F.when(F.col("_key").isNull(), F.col("score")).otherwise(after(F.col("score"), F.col("steps")))}
    new |= {f"{k}_count": F.col(f"{k}_count") + F.coalesce(f"_{k}", F.lit(0)) for k in ("good", "bad")}
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in cache.columns])
