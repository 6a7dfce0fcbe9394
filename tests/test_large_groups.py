"""Large groups, exact means and blocks of nearest neighbours on small cases."""

import numpy as np
from pyspark.sql import functions as F

from floorops.operators import logs, neighbours, reports


def test_checklists_of_a_large_folder_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(reports, "ITEMS", 10, raising=False)
    monkeypatch.setattr(reports, "PROJECTS", 20, raising=False)
    p = spark.range(400).selectExpr("id AS code", "CASE WHEN id % 4 = 0 THEN 'none' WHEN id % 4 = 1 THEN NULL ELSE 'press' END AS equipment")
    alias = spark.createDataFrame([("press", "1. press"), ("none", "2. none")], "equipment string, folder string")
    items = spark.range(55).selectExpr("'1. press' AS folder", "100 - id AS seq", "concat('item ', id) AS item")
    out = reports.checklist_join(p, alias, items)
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    got = sorted((r["code"], r["folder"] or "", r["n_items"], r["idx"] or 0, r["item"] or "") for r in rows)
    want = [(c, "2. none" if c % 4 == 0 else "", 0, 0, "") for c in range(400) if c % 4 < 2] + [(c, "1. press", 55, i + 1, f"item {54 - i}") for c in range(400) if c % 4 > 1 for i in range(55)]
    assert got == sorted(want)
    assert len({r["task"] for r in rows if r["folder"] == "1. press"}) == 4


def test_checklists_are_rows_that_files_keep_in_little_space(spark, tmp_path):
    p = spark.range(1500).selectExpr("id * 7919 AS code", "'press' AS equipment")
    alias = spark.createDataFrame([("press", "1. press")], "equipment string, folder string")
    items = spark.range(3001).selectExpr("'1. press' AS folder", "id AS seq", "concat('item ', id % 64) AS item")
    reports.checklist_join(p, alias, items).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.agg(F.count("*"), F.count_distinct("code", "idx"), F.sum("idx"), F.sum("code")).first()
    assert tuple(got) == (1500 * 3001, 1500 * 3001, 1500 * 3001 * 3002 // 2, 3001 * 7919 * 1499 * 1500 // 2)
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 0.3 * 1500 * 3001


def test_checklists_keep_projects_without_a_code_and_equal_ones(spark, monkeypatch):
    for name, size in (("ITEMS", 10), ("PROJECTS", 20), ("LIST", 4), ("RUN", 8)):
        monkeypatch.setattr(reports, name, size, raising=False)
    codes = [None] * 130 + [5] * 90 + list(range(100))
    p = spark.createDataFrame([(c, ("press", "lathe", "saw")[i % 3]) for i, c in enumerate(codes)], "code long, equipment string")
    alias = spark.createDataFrame([("press", "1. press"), ("lathe", "1. press")], "equipment string, folder string")
    items = spark.range(25).selectExpr("'1. press' AS folder", "id AS seq", "CASE WHEN id <> 3 THEN concat('item ', id) END AS item")
    out = reports.checklist_join(p, alias, items)
    assert out.dtypes == [("code", "bigint"), ("equipment", "string"), ("folder", "string"), ("n_items", "bigint"), ("idx", "int"), ("item", "string")]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    each = [(c, ("press", "lathe", "saw")[i % 3]) for i, c in enumerate(codes)]
    want = [(c, e, None, 0, None, None) for c, e in each if e == "saw"] + [(c, e, "1. press", 25, i + 1, None if i == 3 else f"item {i}") for c, e in each if e != "saw" for i in range(25)]
    assert got == sorted(want, key=repr)


def test_means_do_not_hang_on_the_order_of_the_sum(spark):
    # 54.35 exactly, whose sum as doubles is less; and -0.25
    rows = [("a", x) for x in [0.1, 0.7, 108.6, 108.0] * 500] + [("b", -0.25), ("c", float("nan")), ("c", 1.0), ("d", float("inf")), ("e", None), ("f", -0.01)]
    for order in (rows, rows[::-1]):
        got = {r["agent"]: (r["n"], str(r["avg_sec"])) for r in logs.response_stats(spark.createDataFrame(order, "agent string, elapsed_sec double")).collect()}
        assert got == {"a": (2000, "54.4"), "b": (1, "-0.3"), "c": (2, "nan"), "d": (1, "inf"), "f": (1, "0.0")}


def test_knn_keeps_a_bounded_number_of_rows_and_similarities(spark, monkeypatch):
    seen = []
    plain = neighbours.best_columns
    rng = np.random.default_rng(5)
    kept, ids = np.full((4, 3), -np.inf), np.zeros((4, 3), np.int64)
    sims, names = rng.integers(0, 6, (4, 40)) / 4, rng.permutation(40)
    for at in range(0, 40, 7):
        neighbours.keep_best(kept, ids, sims[:, at : at + 7], names[at : at + 7])
    for r in range(4):
        want = sorted(zip(-sims[r], names, strict=True))[:3]
        assert [(-s, i) for s, i in zip(kept[r], ids[r], strict=True)] == want
    monkeypatch.setattr(neighbours, "best_columns", lambda sim, *x: seen.append(sim.shape) or plain(sim, *x))
    neighbours.keep_best(kept, ids, np.full((4, 7), -1.0), names[:7])
    assert seen == [(0, 7)]
    v = spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(9)], "id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    got = neighbours.knn(v.withColumnRenamed("id", "query_id"), v, 1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(i, i) for i in range(9)}


def test_knn_leaves_out_infinite_vectors(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        v = spark.range(0, 1000, 1, 1).selectExpr("id", "CASE WHEN id % 10 = 3 THEN array(CAST('inf' AS DOUBLE), 1D) ELSE array(cos(id), sin(id)) END AS embedding")
        rows = neighbours.knn(v.filter("id < 7").withColumnRenamed("id", "query_id"), v, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    xs = {i: np.array([np.cos(i), np.sin(i)]) for i in range(1000) if i % 10 != 3}
    want = {(q, n + 1, i) for q in range(7) if q in xs for n, (_, i) in enumerate(sorted((-round(float(xs[q] @ x), 6), i) for i, x in xs.items())[:2])}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == want
