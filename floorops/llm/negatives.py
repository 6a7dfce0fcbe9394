"""Hard negatives by a multiway hyperplane tree whose siblings are cut by distance ranges."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.llm.common import materialize
from floorops.llm.topk import LOW, WAVES, by_wave, products

LEAF = 128
SPLITS = 12
HIGH = np.iinfo(np.int64).max


def distances(a: np.ndarray, a2: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, a2[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


class Gnat:
    """A node deals its rows to the nearest of some split points and keeps, for each split point and each sibling, the range of distances."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.order = np.arange(len(x))
        self.f = x.astype(np.float64)
        self.n2 = (self.f * self.f).sum(axis=1)
        self.label = labels
        self.random = np.random.default_rng(len(x))
        self.nodes: list[tuple] = []  # first, last, split points, children, ranges, and of each child: lengths and labels
        self.beyond = self.within = self.leaves = 0
        if len(x):
            self._build(0, len(x))
        self.x, self.f, self.ids, self.label = x[self.order], self.f[self.order], ids[self.order], labels[self.order]

    def _build(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, None, [], None, None, None))
        if hi - lo <= LEAF:
            return me
        own = self.order[lo:hi].copy()
        some = own[self.random.permutation(hi - lo)[: 4 * SPLITS]]
        picked = [some[0]]
        far = distances(self.f[some], self.n2[some], self.f[picked])[:, 0]
        while len(picked) < SPLITS and far.max() > 0:  # each next split point is far from those before
            picked.append(some[int(far.argmax())])
            far = np.minimum(far, distances(self.f[some], self.n2[some], self.f[picked[-1:]])[:, 0])
        points = self.f[picked]
        apart = distances(self.f[own], self.n2[own], points)
        cell = apart.argmin(axis=1)
        size = np.bincount(cell, minlength=len(picked))
        if size.max() == hi - lo:
            return me
        self.order[lo:hi] = own[np.argsort(cell, kind="stable")]
        cells = [j for j in range(len(picked)) if size[j]]
        least = np.stack([apart[cell == j].min(axis=0) for j in cells], axis=1)
        most = np.stack([apart[cell == j].max(axis=0) for j in cells], axis=1)
        length = np.array([[f(self.n2[own[cell == j]]) for f in (np.min, np.max)] for j in cells])
        label = np.array([[f(self.label[own[cell == j]]) for f in (np.min, np.max)] for j in cells])
        at, children = lo, []
        for j in cells:
            children.append(self._build(at, at + int(size[j])))
            at += int(size[j])
        self.nodes[me] = (lo, hi, points, children, (least, most), length, label)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, target: Best) -> None:
        """Give ``target`` all rows that it may want, of the leaves that are left.

        What a query wants is a window of scores, and so, with the lengths of a
        subtree's rows, a ring of distances around it. A sibling is dropped for
        a query if for some split point the rows there are all beyond the
        ring's outer radius or all within its inner one, or if their labels are
        out of the question. The ring narrows as the target fills.
        """
        if not self.nodes or not len(q):
            return
        qf = q.astype(np.float64)
        q2 = (qf * qf).sum(axis=1)
        slack = 1e-7 * (np.sqrt(q2) + float(np.sqrt(self.n2.max()))) + 1e-6
        score = products(q, qf, self.x, self.f)
        open_ = [(0.0, 0, np.arange(len(q)), np.zeros(len(q)), float(self.n2.max()))]
        while open_:
            _, node, who, near, longest = heapq.heappop(open_)
            low, _ = target.window(who)
            still = near <= np.sqrt(np.maximum(0.0, q2[who] + longest - 2 * low)) + slack[who]
            who = who[still]
            if not len(who):
                continue
            lo, hi, points, children, ranges, lengths, labels = self.nodes[node]
            if points is None:
                self.leaves += 1
                s = score(who, lo, hi)
                same = self.label[None, lo:hi] == label[who][:, None]
                s[(self.ids[None, lo:hi] == own[who][:, None]) | (same != target.same)] = LOW
                target.take(who, s, self.ids[lo:hi])
                continue
            low, high = target.window(who)
            to = distances(qf[who], q2[who], points)
            for j, child in enumerate(children):
                least, most = ranges[0][:, j], ranges[1][:, j]
                near = np.maximum(to - most[None, :], least[None, :] - to).max(axis=1)
                far = (to + most[None, :]).min(axis=1)
                outer = q2[who] + lengths[j, 1] - 2 * low
                inner = np.sqrt(np.maximum(0.0, q2[who] + lengths[j, 0] - 2 * high))
                beyond = (outer < -slack[who]) | (near > np.sqrt(np.maximum(0.0, outer)) + slack[who])
                within = far < inner - slack[who]
                a, b = labels[j]
                wrong = (label[who] < a) | (label[who] > b) if target.same else (label[who] == a) & (a == b)
                self.beyond += int(beyond.sum())
                self.within += int((within & ~beyond).sum())
                go = ~(beyond | within | wrong)
                if go.any():
                    heapq.heappush(open_, (float(near[go].min()), child, who[go], near[go], float(lengths[j, 1])))


class Best:
    """The ``k`` best scores of each query in each of its windows, ties to the smaller id.

    ``floor`` are the windows' lower ends, or what earlier rows have raised
    them to; a window whose floor is above its ceiling is empty.
    """

    def __init__(self, k: int, same: bool, floor: np.ndarray, ceiling: np.ndarray):
        self.k, self.same, self.ceiling = k, same, ceiling
        self.floor = floor.copy()
        self.score = np.full((*floor.shape, k), LOW)
        self.id = np.full((*floor.shape, k), HIGH)

    def window(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each query still asks for, as doubles."""
        real = self.floor[who] <= self.ceiling[who]
        low = np.where(real, self.floor[who].astype(np.float64), np.inf).min(axis=1)
        return low, np.where(real, self.ceiling[who].astype(np.float64), -np.inf).max(axis=1)

    def take(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.floor.shape[1]):
            fits = (score >= self.floor[who, w][:, None]) & (score <= self.ceiling[who, w][:, None]) & (score > LOW)
            hit = fits.any(axis=1)
            if not hit.any():
                continue
            at = who[hit]
            s = np.concatenate([self.score[at, w], np.where(fits[hit], score[hit], LOW)], axis=1)
            i = np.concatenate([self.id[at, w], np.where(fits[hit], ids[None, :], HIGH)], axis=1)
            best = np.lexsort((i, -1 - s), axis=1)[:, : self.k]
            self.score[at, w] = np.take_along_axis(s, best, 1)
            self.id[at, w] = np.take_along_axis(i, best, 1)
            self.floor[at, w] = np.maximum(self.floor[at, w], self.score[at, w, -1])


def _search(sent, k: int, same: bool, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value

        def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            for d, (ids, label, x) in vectors_by_length(rows).items():
                if d in block:
                    own, own_label, q, floor, ceiling = block[d]
                    best = Best(k, same, floor, ceiling)
                    Gnat(x, ids, label).search(q, own, own_label, best)
                    i, w, n = np.nonzero(best.score > LOW)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(w.astype(np.int32)), pa.array(best.id[i, w, n]), pa.array(best.score[i, w, n])], names=["anchor_id", "slot", "vec_id", "score"])

        held, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_rows):
                held.append(batch.slice(lo, shard_rows))
                n += held[-1].num_rows
                if n >= shard_rows:
                    yield from shard(held)
                    held, n = [], 0
        if n:
            yield from shard(held)

    return run


def vectors_by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (ids, labels, matrix) of a table (id, label, v)."""
    if not len(rows):
        return {}
    ids, label, v = (rows.column(c).combine_chunks() for c in ("id", "label", "v"))
    v = v if isinstance(v, pa.Array) else v.chunk(0)
    size = v.value_lengths().to_numpy()
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[d] = (ids.to_numpy()[at], label.to_numpy()[at], v.take(pa.array(at)).flatten().to_numpy().astype(np.int64).reshape(len(at), d))
    return out


def _best(rows: DataFrame, block: dict, k: int, same: bool, shard_rows: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the best ``k`` of each window, in waves of ``rows``; each wave starts from the floors of those before."""
    spark = rows.sparkSession
    best = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    running = None
    for wave in range(len(WAVES) - 1):
        sent = spark.sparkContext.broadcast(block)
        found = rows.filter(F.col("wave") == wave).select("id", "label", "v").mapInArrow(_search(sent, k, same, shard_rows), "anchor_id long, slot int, vec_id long, score long")
        found = found if running is None else found.unionByName(running.drop("rank"))
        running = materialize(found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k), "negatives")
        if wave < len(WAVES) - 2:
            reached = {(r["anchor_id"], r["slot"]): r["score"] for r in running.filter(F.col("rank") == k).select("anchor_id", "slot", "score").collect()}  # of one block's queries
            block = {
                d: (own, label, q, np.array([[max(f, reached.get((i, w), LOW)) for w, f in enumerate(row)] for i, row in zip(own.tolist(), floor.tolist(), strict=True)], np.int64).reshape(floor.shape), ceiling)
                for d, (own, label, q, floor, ceiling) in block.items()
            }
        sent.unpersist()
    return running


def hard_negatives(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), shard_rows: int = 16384, block_bytes: int = 32 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is (id long, label long, v array<bigint>); ``anchors`` a
    condition on it. The score of a row is its integer inner product with the
    anchor, ties go to the smaller id. An anchor's positives are its best
    ``positives`` other rows of its label; of each positive the best
    ``negatives`` rows of other labels are returned whose score is between
    ``percent`` of the positive's.

    The vectors are written once, in four waves by a hash of their id, each
    three times as many as all before. Anchors go to the tasks in blocks of
    about ``block_bytes``, which bounds the broadcast. A task builds a tree
    (``Gnat``) over each ``shard_rows`` rows that it reads, without a shuffle,
    and searches it for the block, once for positives and once for all windows
    of negatives; what the waves before have found narrows the windows of the
    next, so that tasks return few rows each.

    Defined cases: rows with a null id, label or vector take no part; rows with
    an anchor's id are no candidates of it; a repeated anchor id is asked once,
    with its smallest vector and label; other repeated ids are candidates each;
    vectors of other lengths are not compared; a positive score below zero has
    no window; scores beyond 64 bits are an error; empty inputs give an empty
    result.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("id is not null and label is not null and v is not null").select("id", F.col("label").cast("long").alias("label"), "v")
    rows = by_wave(rows, "labelled")
    asked = rows.filter(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select("id", "a.label", "a.v")
    asked = materialize(asked, "anchors")
    size = asked.agg(F.sum(F.size("v") * F.lit(8).cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    done = None
    for b in range(blocks):
        got = vectors_by_length(asked.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b).toArrow())
        one = {d: (ids, label, q, np.full((len(ids), 1), LOW), np.full((len(ids), 1), HIGH)) for d, (ids, label, q) in got.items()}
        found = _best(rows, one, positives, True, shard_rows).select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        score = {(r["anchor_id"], r["place"]): r["positive_score"] for r in found.collect()}  # so many for each anchor of the block
        many = {}
        for d, (ids, label, q) in got.items():
            of = [[score.get((i, w + 1)) for w in range(positives)] for i in ids.tolist()]
            floor = np.array([[HIGH if s is None else -(-s * percent[0] // 100) for s in row] for row in of], np.int64).reshape(len(ids), positives)
            ceiling = np.array([[LOW if s is None else s * percent[1] // 100 for s in row] for row in of], np.int64).reshape(len(ids), positives)
            many[d] = (ids, label, q, floor, ceiling)
        mined = _best(rows, many, negatives, False, shard_rows).withColumn("place", F.col("slot") + 1)
        part = mined.join(found, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        done = part if done is None else done.unionByName(part)
    return done
