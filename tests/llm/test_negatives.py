import numpy as np
import pytest
from pyspark.sql import functions as F

from floorops.llm import negatives, queries, topk


def plain(rows, positives=5, wanted=3):
    """(anchor, positive, rank, negative, scores) from all pairs; rows are (id, label, integers)."""
    rows = [r for r in rows if None not in r]
    out = []
    first = {}
    for i, label, v in sorted(rows, key=lambda r: (r[2], r[1])):
        first.setdefault(i, (label, v))
    for a, (label, v) in first.items():
        if a % 50:
            continue
        s = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in rows if i != a and len(w) == len(v)]
        for score, p, _ in sorted(x for x in s if x[2] == label)[:positives]:
            fit = sorted(x for x in s if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score)[:wanted]
            out += [(a, p, n + 1, x[1], -score, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def some_rows(n=600, d=6, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-40, 40, (12, d)) * 4
    v = centre[rng.integers(0, 12, n)] + rng.integers(-12, 12, (n, d))
    v[50:90] = v[50]  # equal scores
    rows = [(i * 5, int(rng.integers(0, 4)), x.tolist()) for i, x in enumerate(v)]
    return [*rows, (7, None, v[0].tolist()), (None, 1, v[0].tolist()), (8, 1, None), (9, 2, [1, 2]), (10_000, 2, [3, 4]), (11, 1, [5, 6]), (12, 2, [7, 7]), (150, 1, v[3].tolist()), (31, 2, v[5].tolist()), (31, 2, v[5].tolist())]


def test_equal_to_all_pairs(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>").repartition(3)
    for shard_rows, block_bytes in [(16384, 32 << 20), (70, 2000)]:
        got = negatives.hard_negatives(df, F.col("id") % 50 == 0, shard_rows=shard_rows, block_bytes=block_bytes)
        want = plain(rows)
        assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert len(want) > 200
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_siblings_are_cut_on_both_sides_of_the_ring():
    rng = np.random.default_rng(0)
    centre = rng.integers(-1000, 1000, (20, 4))
    x = centre[rng.integers(0, 20, 6000)] + rng.integers(-9, 9, (6000, 4))
    tree = negatives.Gnat(x, np.arange(6000), rng.integers(0, 3, 6000))
    q = x[:1]
    own = int(q[0] @ q[0])
    best = negatives.Best(3, False, np.array([[own * 30 // 100]]), np.array([[own * 60 // 100]]))
    tree.search(q, np.array([0]), np.array([1]), best)
    assert tree.beyond and tree.within and tree.leaves < 60
    s = x @ q[0]
    fit = (tree.label[np.argsort(tree.ids)] != 1) & (s >= own * 30 // 100) & (s <= own * 60 // 100) & (np.arange(6000) != 0)
    order = np.lexsort((np.arange(6000), -s))
    assert best.id[0, 0].tolist() == [int(i) for i in order if fit[i]][:3]


@pytest.mark.parametrize("seed", range(3))
def test_windows_with_ties_and_negative_scores(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (900, 3))
    label = rng.integers(0, 2, 900)
    tree = negatives.Gnat(x, np.arange(900), label)
    low = rng.integers(-9, 9, (40, 2))
    high = low + rng.integers(-2, 6, (40, 2))
    best = negatives.Best(4, True, low, high)
    tree.search(x[:40], np.arange(40), label[:40], best)
    for i in range(40):
        s = x @ x[i]
        for w in range(2):
            want = sorted((-int(s[j]), j) for j in range(900) if j != i and label[j] == label[i] and low[i, w] <= s[j] <= high[i, w])[:4]
            assert [(-a, b) for a, b in zip(best.score[i, w].tolist(), best.id[i, w].tolist(), strict=True) if a > topk.LOW] == want


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, 1, [2**40, 1]), (1, 1, [2**40, 1]), (2, 2, [1, 1])]
    df = spark.createDataFrame(rows, "id long, label int, v array<bigint>")
    with pytest.raises(Exception, match="64 bits"):
        negatives.hard_negatives(df, F.col("id") % 50 == 0).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.topk(df.select("id", "v"), df.select("id", "v"), 2).collect()
    wide = spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.quantized(wide).collect()


def test_query_columns_and_labels(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((8, 5))
    rows = [(i, (centre[i % 8] + rng.standard_normal(5) * 0.3).tolist(), int(rng.integers(0, 10)), "x") for i in range(300)]
    rows += [(301, None, 1, "x"), (302, [None, 1.0, 1.0, 1.0, 1.0], 1, ""), (350, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, ""), (400, rows[0][1], None, ""), (None, rows[0][1], 3, "")]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    whole = [(i, (m + 1) % 10 if i % 7 == 0 else m, [int(np.floor(256 * c)) for c in v]) for i, v, m, _ in rows[:300]]
    want = plain(whole)
    assert sorted(map(tuple, got.collect())) == want and want
