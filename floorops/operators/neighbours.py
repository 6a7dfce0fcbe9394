"""Nearest neighbours for many queries, merged corpora and the answer cache."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.functions.text import cosine

#: Bytes of a block of queries and of what is kept for them, about.
BLOCK = 16 << 20
#: Queries and rows of the corpus that are compared at a time.
ROWS, COLUMNS = 512, 2048


def best_columns(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best finite entries of each row, ties to the smaller id; only those from the k-th on are sorted."""
    kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k] if sim.shape[1] > k else np.full(len(sim), -np.inf)
    row, col = np.nonzero((sim >= kth[:, None]) & np.isfinite(sim))
    order = np.lexsort((ids[col], -sim[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, "left")
    some = np.arange(len(row)) - first < k
    return row[some], col[some]


def keep_best(kept: np.ndarray, kept_ids: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
    """Let the entries of ``sim`` compete with the best so far of its rows, in place; rows with nothing better are left out."""
    k = kept.shape[1]
    some = np.flatnonzero(sim.max(axis=1) >= kept[:, -1])
    row, col = best_columns(sim[some], ids, k)
    both = np.full((len(some), 2 * k), -np.inf)
    both_ids = np.zeros((len(some), 2 * k), np.int64)
    both[:, :k], both_ids[:, :k] = kept[some], kept_ids[some]
    place = k + np.arange(len(row)) - np.searchsorted(row, row, "left")
    both[row, place], both_ids[row, place] = sim[some][row, col], ids[col]
    order = np.lexsort((both_ids, -both), axis=1)[:, :k]
    kept[some], kept_ids[some] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def knn(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` nearest by cosine of (id, embedding) rows for (query_id, embedding) rows.

    Queries are a stated set: they go to the tasks in blocks of about ``BLOCK``
    bytes, which bounds the broadcast, and the corpus is read where it lies,
    once for each block. Tasks compare ``ROWS`` queries with ``COLUMNS`` vectors
    at a time and keep the best so far of each query, so that their memory
    grows neither with the queries nor with the corpus; each task gives at most
    ``k`` rows a query, which a window merges.
    Null, zero and non-finite vectors and vectors of another length take no part. Ties go
    to the smaller id; similarities are in double and rounded to 6 digits
    before they are ranked, so that the order of the sums does not matter.
    """
    spark = corpus.sparkSession
    queries = queries.filter("embedding IS NOT NULL").select("query_id", "embedding")
    size = queries.agg(F.sum(F.size("embedding") * F.lit(8).cast("bigint") + 16 * k)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))

    def unit(rows) -> tuple[np.ndarray, np.ndarray]:
        m = np.stack([np.asarray(r, float) for r in rows])
        size = np.linalg.norm(m, axis=1)
        ok = np.isfinite(size) & (size > 0)
        return np.where(ok[:, None], m, 0) / np.where(ok, size, 1)[:, None], ok

    def by_width(ids, rows) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width = np.array([len(v) for v in rows], int)
        out = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            out[w] = (np.asarray(ids, np.int64)[at], *unit([rows[i] for i in at]))
        return out

    def search(sent):
        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = {w: (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)) for w, (ids, _, _) in sent.value.items()}
            for batch in batches:
                for w, (c_ids, c, c_ok) in by_width(batch["id"], batch["embedding"].tolist()).items():
                    if w not in sent.value:
                        continue
                    q, q_ok = sent.value[w][1:]
                    for at in range(0, len(c), COLUMNS):
                        cols = slice(at, at + COLUMNS)
                        for lo in range(0, len(q), ROWS):
                            some = slice(lo, lo + ROWS)
                            sim = q[some] @ c[cols].T
                            np.round(sim, 6, out=sim)
                            sim[~q_ok[some]] = -np.inf
                            sim[:, ~c_ok[cols]] = -np.inf
                            keep_best(best[w][0][some], best[w][1][some], sim, c_ids[cols])
            for w, (sims, ids) in best.items():
                for lo in range(0, len(sims), ROWS):
                    row, col = np.nonzero(np.isfinite(sims[lo : lo + ROWS]))
                    yield pd.DataFrame({"query_id": sent.value[w][0][lo + row], "vec_id": ids[lo + row, col], "similarity": sims[lo + row, col]})

        return nearest

    parts, found = corpus.filter("embedding IS NOT NULL").select("id", "embedding"), None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast(by_width(block["query_id"], block["embedding"].tolist()))
        some = parts.mapInPandas(search(sent), "query_id long, vec_id long, similarity double")
        found = some if found is None else found.unionByName(some)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_many(query: list[float], corpora: Mapping[str, DataFrame], k: int) -> DataFrame:
    """The ``k`` best of each corpus of (id, embedding), with its name: one scan of each, ``k`` rows kept a partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = None
    for name, df in corpora.items():
        best = df.select(F.lit(name).alias("corpus"), "id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity")).filter("similarity IS NOT NULL")
        best = best.orderBy(F.desc("similarity"), "id").limit(k)
        out = best if out is None else out.unionByName(best)
    return out


def hybrid_vector(query: list[float], corpora: Mapping[str, DataFrame], k: int) -> DataFrame:
    """The ``k`` best of all corpora."""
    return search_many(query, corpora, k).orderBy(F.desc("similarity"), "corpus", "id").limit(k)


def cache_lookup(queries: DataFrame, cache: DataFrame, threshold: float = 0.92, least: float = 0.5) -> DataFrame:
    """For each question its nearest cached one: a hit from ``threshold`` on, usable if its score is at least ``least``."""
    best = knn(queries, cache.select("id", "embedding"), 1).drop("rank")
    joined = best.join(cache.select(F.col("id").alias("vec_id"), "score"), "vec_id")
    hit = F.col("similarity") >= threshold
    return joined.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"), hit.alias("hit"), (hit & (F.col("score") >= least)).alias("usable"))


def cache_save(cache: DataFrame, new: DataFrame, threshold: float = 0.98) -> DataFrame:
    """The cache after new answers (id, embedding, answer, score): those nearest at ``threshold`` overwrite and reset counters, others are added.

    Of several new answers for one entry, the largest id is kept.
    """
    best = knn(new.select(F.col("id").alias("query_id"), "embedding"), cache.select("id", "embedding"), 1).filter(F.col("similarity") >= threshold)
    over = new.join(best.select(F.col("query_id").alias("id"), F.col("vec_id").alias("target")), "id", "left")
    fresh = over.filter("target IS NULL").select("id", "answer", "score", F.lit(0).alias("use_count"))
    last = over.filter("target IS NOT NULL").groupBy("target").agg(F.max_by(F.struct("answer", "score"), "id").alias("n")).withColumnRenamed("target", "id")
    kept = cache.join(last, "id", "left").select("id", F.coalesce("n.answer", "answer").alias("answer"), F.coalesce("n.score", "score").alias("score"), F.when(F.col("n").isNull(), F.col("use_count")).otherwise(0).alias("use_count"))
    return kept.unionByName(fresh)
