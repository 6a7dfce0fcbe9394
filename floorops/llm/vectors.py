"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.llm.common import materialize
from floorops.llm.components import components

#: Half-width of the confidence bound in units of 1 / sqrt(dimension - 1); a true pair lies outside it about once in 10^8.
EPSILON = 6.0
#: Vectors that a bucket of codes is meant to hold, and rows of a block when it holds more.
BUCKET = 1024


@functools.lru_cache(maxsize=64)
def rotation(d: int, k: int) -> np.ndarray:
    """The ``k``-th random rotation of ``d`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([d, k]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a bucket's key, tables) for ``n`` vectors.

    A random hyperplane parts two vectors at the threshold's angle with
    probability angle / pi, so a key of some bits is shared with a known
    probability, and so many tables give ``recall`` at the threshold itself;
    closer pairs are found more surely. A recall of 1 asks for no key: all
    vectors are one bucket, compared in blocks.
    """
    if recall >= 1:
        return 0, 1
    bits = max(1, round(math.log2(max(n, 1) / BUCKET))) if n > 2 * BUCKET else 1
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` scaled to length one, without overflow; no row may be zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def encode(u: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs after a rotation, correction factors, table keys) of unit vectors.

    The factor is the inner product of a rotated vector with its code, the
    nearest corner of a cube of unit length: dividing a code's inner product
    with another rotated vector by it gives an unbiased estimate of the
    vectors' own inner product.
    """
    d = u.shape[1]
    turned = u @ rotation(d, 0)
    signs = turned > 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    need = bits * tables
    planes = [u @ rotation(d, 1 + k) > 0 for k in range(-(-need // d))] if need else []
    flat = np.concatenate(planes, axis=1)[:, :need].reshape(len(u), tables, bits) if need else np.zeros((len(u), tables, 0), bool)
    keys = (flat * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
    return np.packbits(signs, axis=1), factor, keys


def near_pairs(a: dict, b: dict, table: int, threshold: float, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of ``a`` and ``b`` at the threshold or above, of pairs that share no key of an earlier table.

    A pair at cosine c has an estimate within sqrt(1 - f^2) / f * e * sqrt(1 - c^2)
    of c, f being the factor and e the part of the error's direction that meets
    the other vector: at most 1, and at most epsilon / sqrt(d - 1) with high
    confidence. Only pairs whose bound reaches the threshold are computed from
    the vectors, in double precision.
    """
    d = a["u"].shape[1]
    sure = min(1.0, epsilon / math.sqrt(max(1, d - 1)))
    f = np.minimum(a["factor"], 1.0)
    least = f * threshold - np.sqrt(1 - f * f) * sure * math.sqrt(1 - threshold * threshold)
    code = (np.unpackbits(a["code"], axis=1)[:, :d].astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    may = code @ (b["u"] @ rotation(d, 0)).astype(np.float32).T >= (least - 1e-4)[:, None]
    if a is b:
        may &= np.tri(len(may), k=-1, dtype=bool).T
    if table and may.any():
        seen = np.zeros(may.shape, bool)
        for t in range(table):
            seen |= a["keys"][:, t][:, None] == b["keys"][:, t][None, :]
        may &= ~seen
    i, j = np.nonzero(may)
    step = max(1, (1 << 22) // d)
    for lo in range(0, len(i), step):
        p, q = i[lo : lo + step], j[lo : lo + step]
        ok = np.einsum("ij,ij->i", a["u"][p], b["u"][q]) >= threshold
        yield p[ok], q[ok]


def block_links(t: pa.Table, threshold: float, epsilon: float) -> pa.Table:
    """Of one block of a bucket: (id, root, n) of each vector with links: its smallest reachable id here, and how many vectors it links with."""
    t = t.combine_chunks()
    d, table, lo, hi = (t.column(c)[0].as_py() for c in ("d", "tab", "lo", "hi"))
    side = t.column("side").to_numpy()
    ids, weight = t.column("id").to_numpy(), t.column("m").to_numpy()
    parts = []
    for s in dict.fromkeys((lo, hi)):
        at = np.flatnonzero(side == s)
        some = t.take(pa.array(at)).combine_chunks()
        column = lambda c: some.column(c).chunk(0) if len(some) else some.column(c).combine_chunks()
        keys = column("keys").flatten().to_numpy().reshape(len(at), -1) if len(at) else np.zeros((0, 1), np.int64)
        code = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(at), -(-d // 8))
        parts.append({"at": at, "u": unit(matrix(column("v"), d)) if len(at) else np.zeros((0, d)), "code": code, "factor": column("factor").to_numpy(), "keys": keys})
    n = np.zeros(len(ids), np.int64)
    found = []
    for i, j in near_pairs(parts[0], parts[-1], table, threshold, epsilon):
        i, j = parts[0]["at"][i], parts[-1]["at"][j]
        n += np.bincount(i, weight[j], len(n)).astype(np.int64) + np.bincount(j, weight[i], len(n)).astype(np.int64)
        found.append(np.stack([i, j]))
    root = np.unique(ids, return_inverse=True)[1]  # ranks, so that the smallest id leads
    rank = np.sort(np.unique(ids))
    if found:
        i, j = np.concatenate(found, axis=1)
        while True:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            if (root == before).all():
                break
    some = n > 0
    return pa.table({"id": ids[some], "root": rank[root[some]], "n": n[some]})


def vector_links(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, block_rows: int = BUCKET, epsilon: float = EPSILON, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of each row: near-duplicate groups of vectors by cosine.

    Every pair found has a cosine of ``threshold`` or more in double precision.
    Equal vectors are one row with a count from the start, so that a hot group
    of copies is compared once. The others are written with a rotated binary
    code, its correction factor and keys of further rotations' signs, and meet
    where a key agrees: with ``recall`` (at the threshold itself; above it more
    surely) that happens in some table, ``plan`` says how many it takes. In a
    bucket the codes' estimates and their confidence bounds leave the pairs
    that are computed exactly (``near_pairs``). A pair that shares several keys
    is counted in the first.

    A bucket of more than ``2 * block_rows`` vectors is cut into blocks, and
    each task compares two of them: no group's size bounds a task, none is cut
    short, and tasks return sums and one link a vector, not pairs. A dense
    group of k different near copies takes k^2 / 2 comparisons, as its links
    have to be counted.

    Defined cases: rows with a null id, a null, empty or zero vector, or with a
    null or non-finite component link with nothing and are their own component;
    vectors of different lengths do not link; repeated ids share links and
    component, and their vectors count each; other columns are not looked at;
    an empty table gives an empty result.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fine = F.col("id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # equal vectors have equal keys of 128 bits; x + 0 makes -0.0 and 0.0 one
    same = F.transform(x, lambda c: c + F.lit(0.0))
    rows = rows.withColumn("h", F.when(fine, F.struct(F.xxhash64(F.lit(1), same).alias("a"), F.xxhash64(F.lit(2), same).alias("b"))))
    classes = rows.filter("h is not null").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.min_by("v", "id").alias("v"))
    bits, tables = plan(vectors.count(), threshold, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            for d in np.unique(v.value_lengths().to_numpy()).tolist():
                at = pa.array(np.flatnonzero(v.value_lengths().to_numpy() == d))
                some = batch.take(at)
                code, factor, keys = encode(unit(matrix(some.column(3), d)), bits, tables)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                made = {"d": pa.array(np.full(len(keys), d)), "code": pa.array([c.tobytes() for c in code], pa.binary()), "factor": pa.array(factor), "keys": listed}
                yield pa.RecordBatch.from_arrays([*some.columns, *made.values()], names=[*some.schema.names, *made])

    ddl = "h struct<a:bigint,b:bigint>, id long, m long, v array<double>, d long, code binary, factor double, keys array<bigint>"
    codes = materialize(classes.select("h", "id", "m", "v").mapInArrow(run, ddl), "codes")

    met = codes.select("id", "m", "v", "d", "code", "factor", "keys", F.posexplode("keys").alias("tab", "key"))
    sizes = codes.select("d", F.posexplode("keys").alias("tab", "key")).groupBy("d", "tab", "key").count()
    large = sizes.filter(F.col("count") > 2 * block_rows).select("d", "tab", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("cuts"))
    met = met.join(large, ["d", "tab", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    met = met.withColumn("side", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("id", "m", "v", "d", "code", "factor", "keys", "tab", "key", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    links = met.groupBy("d", "tab", "key", "lo", "hi").applyInArrow(lambda t: block_links(t, threshold, epsilon), "id long, root long, n long")
    links = materialize(links, "links")

    named = components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    known = codes.select("h", "id", "m").join(counts, "id", "left").join(named, "id", "left")
    known = known.select("h", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("id", "h").join(known, "h", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
