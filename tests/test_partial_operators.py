"""Operators that the first round had in part."""

from pyspark.sql import functions as F

from floorops.functions import text as T
from floorops.operators import answers, corpus, logs, reports
from floorops.plans.registry import QueryRegistry


def test_upsert_keeps_old_columns(spark):
    ddl = "source_file string, chunk_index int, content string, category string, created_at int"
    t = spark.createDataFrame([("a", 0, "x", "old", 1), ("a", 1, "x", None, 1), ("a", 2, "x", "old", 1)], ddl)
    n = spark.createDataFrame([("a", 0, "y", "new", 2), ("a", 1, "y", "new", 2), ("b", 0, "y", "new", 2)], ddl)
    want = [("a", 0, "y", "old", 1), ("a", 1, "y", None, 1), ("b", 0, "y", "new", 2)]
    assert sorted(map(tuple, corpus.upsert_chunks(t, n).collect())) == want
    assert {r["category"] for r in corpus.upsert_chunks(t, n, keep=()).collect()} == {"new"}


def test_messages_are_merged_by_both_ends(spark):
    ddl = "day string, id long, `from` string, `to` string, content string, time string"
    old = spark.createDataFrame([("d1", 7, "a", "b", "hello", "01"), ("d2", 1, "a", "b", "other", "02")], ddl)
    new = spark.createDataFrame(
        [("d1", None, "a", "b", "hello", "03"), ("d1", None, "a", "c", "hello", "05"), ("d1", None, "c", "b", "x" * 80 + "1", "04"), ("d1", None, "c", "b", "x" * 80 + "2", "06"), ("d3", None, None, "b", "hello", "01")], ddl
    )
    got = sorted((r["day"], r["id"], r["to"], r["content"][-1]) for r in logs.merge_messages(old, new).collect())
    assert got == [("d1", 7, "b", "o"), ("d1", 8, "b", "1"), ("d1", 9, "c", "o"), ("d2", 1, "b", "r"), ("d3", 1, "b", "o")]


def test_session_summary_fields(spark):
    rows = [("s", "2024-01-01", 1, "u1", "q" * 81, "eq", "open"), ("s", "2024-01-02", 2, "u2", "b", "other", "done"), ("", "2024-01-03", 1, "u", "c", None, None)]
    t = spark.createDataFrame(rows, "session_id string, time string, turn int, `from` string, content string, equipment_type string, status string")
    got = logs.session_summary(t).collect()
    assert [r["session_id"] for r in got] == ["legacy-2024-01-03", "s"]
    assert (got[1]["first_question"], got[1]["equipment_type"], got[1]["last_status"], got[1]["turns"]) == ("q" * 80 + "...", "eq", "done", 2)


def test_registry_defaults(spark):
    r = QueryRegistry(spark)
    r.register("n", "SELECT :a + :b AS x", defaults={"b": 10})
    assert r.run("n", a=1).first()[0] == 11 and r.run("n", a=1, b=2).first()[0] == 3
    assert r.list() == [{"name": "n", "description": "", "params": ["a", "b"]}]


def test_language_by_name(spark):
    names = {"guide (KR).pdf": "KO", "a_eng.pdf": "EN", "取扱説明.pdf": "JP", "使用手册.pdf": "CN", "설명서.pdf": "KO", "x.pdf": "UNKNOWN"}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.l for r in rows.withColumn("l", T.language_by_name(F.col("n"))).collect()} == names


def test_checklists(spark):
    p = spark.createDataFrame([(1, "press"), (2, "robot"), (3, None)], "code long, equipment string")
    alias = spark.createDataFrame([("press", "1. press"), ("robot", "2. none")], "equipment string, folder string")
    items = spark.createDataFrame([("1. press", 2, "b"), ("1. press", 1, "a")], "folder string, seq int, item string")
    got = sorted(((r["code"], r["n_items"], r["idx"], r["item"]) for r in reports.checklist_join(p, alias, items).collect()), key=repr)
    assert got == [(1, 2, 1, "a"), (1, 2, 2, "b"), (2, 0, None, None), (3, 0, None, None)]


def test_answer_flow(spark):
    q = spark.createDataFrame([(1, "alarm", [1.0, 0.0]), (2, "alarm", [0.0, 1.0]), (3, None, [1.0, 1.0])], "query_id long, question string, embedding array<double>")
    cache = spark.createDataFrame([(9, [1.0, 0.0], "see CS-1", 0.6), (8, [0.0, 1.0], "poor", 0.4)], "id long, embedding array<double>, answer string, score double")
    history = spark.createDataFrame([(5, [0.0, 1.0], "h" * 300)], "id long, embedding array<double>, text string")
    manuals = spark.createDataFrame([(6, [0.0, 1.0], ""), (7, None, "m")], "id long, embedding array<double>, text string")
    got = {r["query_id"]: r for r in answers.answer_flow(q, cache, history, manuals).collect()}
    assert (got[1]["source"], got[1]["qa_id"], got[1]["answer"], got[1]["reasons"][0], got[1]["saved"]) == ("cache", 9, "see CS-1", answers.FROM_CACHE, False)
    assert (got[2]["source"], got[2]["answer"], got[2]["saved"]) == ("rag", answers.HISTORY + "h" * 200, True)
    assert got[3]["answer"] == answers.HISTORY + "h" * 200
    none = {r["query_id"]: r for r in answers.answer_flow(q, cache.filter("false"), history.filter("false"), manuals.filter("false")).collect()}
    assert all(r["answer"] == answers.NOTHING and not r["saved"] for r in none.values())
