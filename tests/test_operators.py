import datetime as dt
import json

from pyspark.sql import functions as F

from floorops.functions import text as T
from floorops.operators import corpus, feedback, logs, reports, retrieval
from floorops.sources import files
from floorops.streaming import jobs


def one(spark, ddl, value, f):
    return spark.createDataFrame([(value,)], ddl).select(f(F.col("x"))).first()[0]


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_sessions_split_at_600_seconds(spark):
    rows = [("c", "u", at(0)), ("c", "u", at(599)), ("c", "u", at(1199)), ("c", "v", at(1200)), ("c", "u", at(1800))]
    df = spark.createDataFrame(rows, "channel string, user string, ts timestamp")
    got = sorted((r["user"], r["n"]) for r in logs.sessionize(df).collect())
    assert got == [("u", 1), ("u", 1), ("u", 2), ("v", 1)]


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows = [("c", "u", at(0)), ("c", "u", at(599)), ("c", "u", at(1199)), ("d", "u", at(3000))]
    df = spark.createDataFrame(rows, "channel string, user string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("sess").select("channel", "user", "start", "n").collect()))
    want = sorted(map(tuple, logs.sessionize(df).select("channel", "user", "start", "n").collect()))
    assert got == want


def test_overdue_rules(spark):
    day = dt.datetime(2024, 1, 15)
    nc = spark.createDataFrame(
        [(1, "critical", 1, 1, None, day - dt.timedelta(days=3), 2, "t"), (2, "critical", 1, 1, None, day - dt.timedelta(days=4), 2, "t"), (3, None, 1, 1, None, day - dt.timedelta(days=15), None, "t"),
         (4, "low", None, 1, None, day - dt.timedelta(days=99), 2, "t"), (5, "high", 2, 1, None, day - dt.timedelta(days=99), 2, "t")],
        "id long, importance string, project_id long, manager_id long, action_completion_date date, created_at timestamp, reporter_id long, title string",
    )
    p = spark.createDataFrame([(1, "a", "active"), (2, "b", "completed")], "id long, name string, status string")
    u = spark.createDataFrame([(1, "m", "Kim", "Min"), (2, "r", "Lee", "Jin")], "id long, username string, last_name string, first_name string")
    got = reports.nc_overdue(nc, p, u, "2024-01-15 00:00:00").collect()
    assert [(r["id"], r["overdue"]) for r in got] == [(2, 1), (3, 1)]
    assert [(r["reporter"], r["manager"], r["manager_username"], r["created_local"]) for r in got] == [("LeeJin", "KimMin", "m", "2024-01-11 09:00:00"), (None, "KimMin", "m", "2023-12-31 09:00:00")]


def test_page_types(spark):
    # (characters, drawings, rasters, tables)
    cases = {(29, 4, 0, 3): "empty", (100, 20, 1, 1): "diagram", (3000, 20, 5, 1): "diagram+text", (100, 20, 2, 1): "table+diagram", (100, 19, 0, 1): "table+diagram", (100, 9, 0, 1): "table", (101, 0, 1, 0): "image+text", (100, 0, 1, 0): "image", (101, 0, 0, 0): "text", (30, 0, 0, 0): "minimal", (2999, 25, 2, 0): "image+text"}
    rows = spark.createDataFrame(list(cases), "n int, g int, r int, t int")
    assert {(x.n, x.g, x.r, x.t): x.type for x in rows.withColumn("type", T.page_type(*map(F.col, "ngrt"))).collect()} == cases


def test_natural_order(spark):
    names = ["page_10", "page_2", "Page_2b", "a1234567890123456", "a123456789012999", "a99"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in rows.orderBy(T.natural_key(F.col("name"))).collect()] == ["a99", "a123456789012999", "a1234567890123456", "page_2", "Page_2b", "page_10"]


def test_upsert_drops_tail_keeps_gap_and_repeats(spark):
    t = spark.createDataFrame([("a", 0, "o"), ("a", 1, "o"), ("a", 2, "o"), ("b", 0, "o")], "source_file string, chunk_index int, v string")
    n = spark.createDataFrame([("a", 1, "n"), ("c", 0, "n")], "source_file string, chunk_index int, v string")
    once = corpus.upsert_chunks(t, n)
    want = [("a", 0, "o"), ("a", 1, "n"), ("b", 0, "o"), ("c", 0, "n")]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, corpus.upsert_chunks(once, n).collect())) == want


def test_fixed_chunks_rebuild_the_text(spark):
    s = "".join(chr(0xAC00 + i % 900) for i in range(2350))
    got = corpus.chunk_fixed(spark.createDataFrame([(1, s), (2, ""), (3, "x")], "doc_id int, text string"), 1000, 100).orderBy("doc_id", "chunk_index").collect()
    mine = [r["content"] for r in got if r["doc_id"] == 1]
    assert mine[0] + "".join(c[100:] for c in mine[1:]) == s
    assert [r["doc_id"] for r in got if r["doc_id"] != 1] == [3]


def test_scalars(spark):
    assert one(spark, "x string", "2024년 3월 5일", T.parse_date) == dt.date(2024, 3, 5)
    assert one(spark, "x string", "20260106", T.parse_date) == dt.date(2026, 1, 6)
    assert one(spark, "x string", "20261301", T.parse_date) is None
    assert one(spark, "x string", "0", T.safe_decimal) is None and one(spark, "x string", "abc", T.safe_decimal) is None
    broken = "한글".encode().decode("latin-1")
    assert one(spark, "x string", broken, T.fix_mojibake) == "한글"
    assert one(spark, "x string", "한글", T.fix_mojibake) == "한글" and one(spark, "x string", "é", T.fix_mojibake) == "é"
    keys = [one(spark, "x string", v, T.natural_key) for v in ("page_2", "page_10", "Page_1")]
    assert keys[2] < keys[0] < keys[1]
    assert one(spark, "x string", "한" * 50, T.language_by_script) == "KO" and one(spark, "x string", "a" * 101, T.language_by_script) == "EN"


def test_feedback_clips_at_each_step(spark):
    rows = [("k", i, "good") for i in range(12)] + [("k", 12, "bad")]
    got = feedback.feedback_fold(spark.createDataFrame(rows, "k string, i int, r string"), "k", F.col("r") == "good", ["i"]).first()
    assert got["score"] == 0.85 and got["good_count"] == 12 and got["bad_count"] == 1


def test_vector_search_leaves_out_null_and_zero(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0])], "vec_id int, embedding array<double>")
    assert [tuple(r) for r in retrieval.vector_search(df, [1.0, 0.0], 5).collect()] == [(1, 1.0), (4, 1.0)]


def test_chatlog_skips_bad_lines(spark, tmp_path):
    lines = [json.dumps({"_header": True, "channel_id": "C1", "channel_name": "ops"}), json.dumps({"ts": "1", "text": "hi"}), "", "{bad"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "y.jsonl").write_text(json.dumps({"ts": "2", "text": "yo"}))
    got = sorted((r["channel_name"], r["text"]) for r in files.read_chatlog(spark, str(tmp_path)).collect())
    assert got == [("ops", "hi"), ("y", "yo")]
