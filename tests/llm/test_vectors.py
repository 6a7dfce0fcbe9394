import numpy as np
import pytest
from pyspark.sql import functions as F

from floorops.llm import queries, vectors

DDL = "vec_id long, embedding array<float>, label int, n_links string, h string"


def plain(rows, threshold=0.95):
    """n_links and component of every row, from all pairs."""
    ok = [r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    x = [np.asarray(r[1], np.float64) if o else None for r, o in zip(rows, ok, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    cos = {}
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                c = x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j]))
                if c > threshold - 0.05:
                    cos[i, j] = c
                if c >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0] if r[0] is not None else 1 << 60), r[0] if r[0] is not None else 1 << 60)
    return sorted((r[0] if r[0] is not None else -1, n[i], least[find(i)] if r[0] is not None else -1) for i, r in enumerate(rows)), cos


def clustered(n=500, d=24, seed=5):
    """Single vectors, close and less close groups, a chain and equal vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n, 2):
        x[i] = x[(i // 40) * 40 + 1] + rng.standard_normal(d) * rng.choice([0.02, 0.1, 0.22])
    for i in range(100, 112):
        x[i] = x[i - 1] + rng.standard_normal(d) * 0.2  # each near the next one
    x[200:260] = x[200]
    return x.astype(np.float32)


def rows_of(x):
    rows = [(int(i), v.tolist(), 1, "a", "b") for i, v in enumerate(x)]
    d = len(rows[0][1])
    return [*rows, (9000, None, 1, "", ""), (9001, [0.0] * d, 1, "", ""), (9002, [], 1, "", ""), (9003, [None, *rows[0][1][1:]], 1, "", ""), (9004, [float("nan")] * d, 1, "", ""), (9005, [float("inf")] * d, 1, "", ""), (9006, [1.0, 2.0], None, "", ""), (9007, [-2.0, -4.0], 1, "", ""), (9008, [2.0, 4.0], 1, "", ""), (None, rows[7][1], 1, "", ""), (9009, [-0.0, 1.0], 1, "", ""), (9010, [0.0, 1.0], 1, "", "")]


def collected(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in df.collect())


@pytest.mark.parametrize("recall, block_rows", [(1.0, 1024), (1.0, 40), (0.9999, 40)])
def test_links_equal_all_pairs(spark, recall, block_rows):
    rows = rows_of(clustered())
    got = vectors.vector_links(spark.createDataFrame(rows, DDL).repartition(3), recall=recall, block_rows=block_rows, epsilon=100.0)
    want, _ = plain(rows)
    assert collected(got) == want
    assert max(n for _, n, _ in want) >= 59


def test_recall_and_bounds():
    rng = np.random.default_rng(0)
    u = vectors.unit(rng.standard_normal((3000, 64)))
    v = vectors.unit(u + (1 - 0.95**2) ** 0.5 / 0.95 * vectors.unit(rng.standard_normal((3000, 64))))
    cos = (u * v).sum(1)
    bits, tables = vectors.plan(1 << 24, 0.95, 0.999)
    a, fa, ka = vectors.encode(u, bits, tables)
    b, fb, kb = vectors.encode(v, bits, tables)
    at = np.abs(cos - 0.95) < 0.01
    assert at.sum() > 200 and (ka == kb).any(axis=1)[at].mean() > 0.99
    code = (np.unpackbits(a, axis=1) * 2.0 - 1) / 8
    estimate = (code * (v @ vectors.rotation(64, 0))).sum(1) / fa
    assert abs((estimate - cos).mean()) < 0.005  # unbiased
    error = np.sqrt(1 - fa * fa) / fa * vectors.EPSILON / np.sqrt(63) * np.sqrt(1 - cos * cos)
    assert (np.abs(estimate - cos) <= error).all()
    part = {"u": u, "code": a, "factor": fa, "keys": ka}
    other = {"u": v, "code": b, "factor": fb, "keys": kb}
    found = {(int(i), int(j)) for p, q in vectors.near_pairs(part, other, 0, 0.95, vectors.EPSILON) for i, j in zip(p, q, strict=True)}
    assert {(i, i) for i in np.flatnonzero(cos >= 0.95).tolist()} <= found


def test_buckets_grow_with_the_rows_not_with_their_keys():
    for n in (10, 10**5, 10**7, 10**10):
        bits, tables = vectors.plan(n, 0.95, 0.999)
        assert n / 2**bits <= 3 * vectors.BUCKET and tables < 100


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, [1.0, 0.0], 0, "", ""), (1, [1.0, 0.0], 0, "", ""), (2, [1.0, 0.01], 0, "", ""), (3, [0.0, 1.0], 0, "", "")]
    assert collected(vectors.vector_links(spark.createDataFrame(rows, DDL), recall=1.0)) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert vectors.vector_links(spark.createDataFrame([], DDL)).count() == 0


def test_query_columns(spark, tmp_path):
    rows = rows_of(clustered(300))
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_links(spark, str(tmp_path))
    want, cos = plain(rows)
    sure = all(abs(c - 0.95) > 1e-9 for c in cos.values())
    assert sure and got.filter(F.col("kept") != F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).count() == 0
    mine = collected(got)
    assert sum(n for _, n, _ in mine) >= 0.99 * sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(mine, want, strict=True))
