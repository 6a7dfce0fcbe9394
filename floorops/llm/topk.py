"""Exact inner-product top-k with a ball tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import materialize

LEAF = 64
#: Candidates are taken in waves by a hash class of their id, of 64: each wave is three times as many as all before.
WAVES = (0, 1, 4, 16, 64)
#: Sums of products below this are exact in double precision, and below the next in 64 bits.
EXACT, LONG = 2.0**52, 2.0**63
LOW = np.iinfo(np.int64).min


def products(q: np.ndarray, qf: np.ndarray, x: np.ndarray, f: np.ndarray):
    """A function (queries, first, last) -> their exact integer inner products with the rows from first to last.

    ``qf`` and ``f`` are ``q`` and ``x`` as doubles. By the components' sizes
    doubles are multiplied, or integers where doubles would round; where 64
    bits might not hold a sum, an error tells so.
    """
    most = float(np.abs(qf).max()) * float(np.abs(f).max()) * max(1, q.shape[1]) if q.size and x.size else 0.0
    if most >= LONG:
        raise OverflowError(f"inner products may reach {most:.3g}, beyond 64 bits: use a smaller scale")
    if most < EXACT:
        return lambda who, lo, hi: (qf[who] @ f[lo:hi].T).astype(np.int64)
    return lambda who, lo, hi: q[who] @ x[lo:hi].T


class BallTree:
    """Balls around integer vectors; a node bounds q.x by q.center + |q| * radius."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(x))
        self.f = x.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left, right
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.visited = self.leaves_scored = 0
        if len(x):
            self._build(0, len(x))
        self.x, self.f, self.ids = x[self.order], self.f[self.order], ids[self.order]

    def _build(self, lo: int, hi: int) -> int:
        own = self.f[self.order[lo:hi]]
        center = own.mean(axis=0)
        apart = np.sqrt(((own - center) ** 2).sum(axis=1))
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, -1))
        self.center.append(center)
        self.radius.append(float(apart.max()))
        if hi - lo > LEAF and apart.max() > 0:
            a = own[int(apart.argmax())]
            b = own[int(((own - a) ** 2).sum(axis=1).argmax())]
            split = np.argsort(own @ (b - a), kind="stable")
            self.order[lo:hi] = self.order[lo:hi][split]
            mid = (lo + hi) // 2
            left = self._build(lo, mid)
            right = self._build(mid, hi)
            self.nodes[me] = (lo, hi, left, right)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: (query, ids, scores) of its best k here, none below its ``floor``.

        Branch and bound for all queries at once: of the nodes that are open,
        the one with the largest upper bound over its queries is next. Queries
        whose current k-th score exceeds their own bound there leave it, and a
        node without queries is dropped with all that lies below it.
        """
        n = len(q)
        best = np.full((n, k), LOW)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.copy()
        if not self.nodes or not n:
            return
        qf = q.astype(np.float64)
        length = np.sqrt((qf * qf).sum(axis=1))
        scored = products(q, qf, self.x, self.f)
        opened: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def open_node(node: int, who: np.ndarray) -> None:
            center, radius = self.center[node], self.radius[node]
            reach = length[who] * (radius + np.sqrt(center @ center))
            bound = qf[who] @ center + length[who] * radius + reach * 1e-9 + 1e-6  # above any rounding
            go = bound >= kth[who]
            if go.any():
                heapq.heappush(opened, (-float(bound[go].max()), node, who[go], bound[go]))

        open_node(0, np.arange(n))
        while opened:
            _, node, who, bound = heapq.heappop(opened)
            who = who[bound >= kth[who]]
            if not len(who):
                continue
            self.visited += 1
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                open_node(left, who)
                open_node(right, who)
                continue
            self.leaves_scored += 1
            score = scored(who, lo, hi)
            here = self.ids[lo:hi]
            score[here[None, :] == own[who][:, None]] = LOW
            hit = (score >= kth[who][:, None]).any(axis=1)
            who, score = who[hit], score[hit]
            all_score = np.concatenate([best[who], score], axis=1)
            all_id = np.concatenate([best_id[who], np.broadcast_to(here, score.shape)], axis=1)
            all_id[all_score == LOW] = np.iinfo(np.int64).max
            take = np.lexsort((all_id, -1 - all_score), axis=1)[:, :k]  # -1 - x turns the order around without overflow
            best[who] = np.take_along_axis(all_score, take, 1)
            best_id[who] = np.take_along_axis(all_id, take, 1)
            kth[who] = np.maximum(kth[who], best[who][:, -1])
        for i in range(n):
            ok = (best[i] > LOW) & (best[i] >= floor[i])
            if ok.any():
                yield i, best_id[i][ok], best[i][ok]


def quantized(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, label_col: str | None = None) -> DataFrame:
    """(id, v), and label if a column is named for it: floor(scale * x) of each component, a bigint; vectors that are null, empty or hold null or non-finite components are left out.

    A product of 2^62 or more is an error, as no bigint would hold its sums.
    """
    x = F.col(vec_col).cast("array<double>")

    def whole(v):
        return F.when(F.abs(v * scale) < 2.0**62, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits: use a smaller scale")))

    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        .filter((F.size(vec_col) > 0) & F.coalesce(fine, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"), *([F.col(label_col).cast("long").alias("label")] if label_col else []))
    )


def by_wave(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with an id) written once, in folders by ``wave``: each wave is three times as many rows as all before, by a hash of the id."""
    turn = F.pmod(F.xxhash64("id"), F.lit(WAVES[-1]))
    wave = sum((turn >= hi).cast("int") for hi in WAVES[1:-1])
    return materialize(rows.withColumn("wave", wave), name, by="wave")


def _by_length(ids: pa.Array, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (ids, matrix) of the vectors of that length."""
    sizes = vectors.value_lengths().to_numpy()
    ids = ids.to_numpy()
    out = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        some = vectors if len(at) == len(sizes) else vectors.take(pa.array(at))
        out[d] = (ids[at], some.flatten().to_numpy().astype(np.int64).reshape(len(at), d))
    return out


def topk(queries: DataFrame, candidates: DataFrame, k: int = 20, shard_rows: int = 16384, block_bytes: int = 32 << 20) -> DataFrame:
    """The ``k`` largest integer inner products of each query, ties to the smaller id.

    Both inputs are (id long, v array<bigint>); a query's own row is no
    candidate of its own. Returns query_id, rank (from 1), vec_id, score.

    The candidates are written once, in four waves, a 64th first, each three
    times as many as all before. Queries go to the tasks in blocks of about
    ``block_bytes``, which bounds the broadcast; for each block every wave is
    read once. A task builds a ball
    tree over each ``shard_rows`` rows that it reads, without a shuffle, and
    searches it for the block. After each wave the best k so far are merged,
    and each query's k-th score goes along with it into the next wave, where it
    cuts branches from the start: so shards return some ten times k rows a
    query in all, however many shards there are. Building a tree takes some
    thousandth of searching it for a full block, so trees are not kept.

    Vectors of another length than a query's are not compared with it. Repeated
    ids are candidates each, and a repeated query id is asked once, with its
    smallest vector. Empty inputs give an empty result. Scores are exact in 64
    bits (``products``); if one might not fit, that is an error.
    """
    spark = candidates.sparkSession
    queries = materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = queries.agg(F.sum(F.size("v") * F.lit(8).cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    candidates = by_wave(candidates.select("id", "v"), "candidates")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = None
    for b in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b).toArrow().combine_chunks()
        block = _by_length(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns)) if len(got) else {}
        running, floors = None, {}
        for wave in range(len(WAVES) - 1):
            floor = {d: np.array([floors.get(i, LOW) for i in ids.tolist()], np.int64) for d, (ids, _) in block.items()}
            sent = spark.sparkContext.broadcast((block, floor))
            found = candidates.filter(F.col("wave") == wave).select("id", "v").mapInArrow(_search(sent, k, shard_rows), "query_id long, vec_id long, score long")
            found = found if running is None else running.unionByName(found)
            running = materialize(found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k), "topk").select("query_id", "vec_id", "score", "rank")
            if wave < len(WAVES) - 2:
                floors = dict(running.filter(F.col("rank") == k).select("query_id", "score").collect())  # one for each query of the block
                running = running.drop("rank")
            sent.unpersist()
        done = running if done is None else done.unionByName(running)
    return done.select("query_id", "rank", "vec_id", "score")


def _search(sent, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floor = sent.value

        def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            if not len(rows):
                return
            for d, (ids, x) in _by_length(*(c.combine_chunks() for c in rows.columns)).items():
                if d not in block:
                    continue
                own, q = block[d]
                found = list(BallTree(x, ids).search(q, own, k, floor[d]))
                if found:
                    asked = np.repeat(own[[i for i, _, _ in found]], [len(w) for _, w, _ in found])
                    who, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(who), pa.array(score)], names=["query_id", "vec_id", "score"])

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(lo, shard_rows))
                n += held[-1].num_rows
                if n >= shard_rows:
                    yield from shard(held)
                    held, n = [], 0
        if held:
            yield from shard(held)

    return run
