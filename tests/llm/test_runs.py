import hashlib
import zlib

import numpy as np
import pytest

from floorops.llm import queries, runs


def plain(w, least=12):
    """Every run by looking at every period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            s = w[a : i + q]
            if len(s) >= max(least, 2 * q) and not any(all(x == y for x, y in zip(s, s[p:], strict=False)) for p in range(1, q)):
                out.append((a, len(s), q))
    return sorted(out)


def collapsed(w, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(seed=3):
    rng = np.random.default_rng(seed)
    out = [["a"] * n for n in (1, 11, 12, 13, 200)] + [["a", "b"] * 40, (["a"] * 5 + ["b"]) * 9]
    for n, letters in [(30, 2), (90, 2), (150, 3), (400, 2), (700, 30)] * 6:
        w = rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"[:letters]), n).tolist()
        for _ in range(3):  # runs of many periods, some with an odd word inside or right behind another
            a, q, m = rng.integers(0, n), rng.integers(1, max(2, n // 5)), rng.integers(2, 9)
            w[a : a + 1] = (w[a : a + q] or ["z"]) * int(m)
            if rng.random() < 0.3:
                w[int(rng.integers(0, len(w)))] = "odd"
        out.append(w[:900])
    f = ["a", "b"]
    while len(f) < 14:
        f.append(f[-1] + f[-2])
    return [*out, list(f[11])]


@pytest.mark.parametrize("tile", [4096, 64])
def test_runs_equal_plain_ones(spark, tile):
    texts = some_texts()
    rows = [(i, " ".join(w), "x", "y") for i, w in enumerate(texts)]
    rows += [(5000, None, "", ""), (5001, "", "", ""), (5002, " \n\t ", "", ""), (None, "q " * 30, "", ""), (3, "u v w " * 9, "", ""), (3, "u v w " * 9, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, runs string").repartition(3)
    got = runs.find_runs(df, tile_words=tile).collect()
    assert len(got) == len(rows)
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    want = []
    for i, t, *_ in rows:
        w = (t or "").split()
        found = plain(w)
        want.append((-1 if i is None else i, len(w), found, collapsed(w, found)))
    assert mine == sorted(want)
    assert sum(len(x[2]) > 0 for x in want) > 20 and max(q for x in want for _, _, q in x[2]) > 60


def test_a_run_over_many_tiles_is_one(spark):
    w = [f"w{i}" for i in range(100)] * 30 + [f"v{i}" for i in range(50)]
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    got = runs.find_runs(df, tile_words=128).first()
    assert [tuple(x) for x in got["runs"]] == [(0, 3000, 100)]


def test_no_rows(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_columns(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)], int(rng.integers(0, 300))).tolist())) for i in range(120)] + [(None, "a b c d"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)
    want, looped = [], 0
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            looped += 1
        found = plain(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{m},{q}\n" for a, m, q in found), collapsed(w, found))]
        want.append((i, len(found), *best, *digest))
    assert looped > 5 and got == sorted(want, key=repr)


def test_candidates_that_reach_into_the_next_text():
    w, ends = runs.coded([b"a b c d e f g h i j k l".split()] * 2)
    for octave in runs.octaves(12):
        assert runs.solve(w, ends, octave, 12) == []
