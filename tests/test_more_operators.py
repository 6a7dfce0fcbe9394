"""Chunks, verdicts, neighbours, readers and stateful streams on small cases."""

import datetime as dt
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floorops.functions import verdicts as V
from floorops.operators import chunks, neighbours, records
from floorops.plans.registry import QueryRegistry
from floorops.sources import files
from floorops.streaming import jobs, stateful


def test_paragraphs_join_while_they_fit():
    assert chunks.by_paragraph("aaaa\n\nbbb\n\n\n" + "c" * 12, 10, 2) == ["aaaa\n\nbbb", "c" * 10, "c" * 4]
    assert chunks.by_paragraph("a" * 10 + "\n\nb", 10, 2) == ["a" * 10, "b"]
    assert chunks.by_paragraph("aaaa\n\nbbbbb", 10, 2) == ["aaaa\n\nbbbbb"]
    assert chunks.by_paragraph(" \n\n ") == []


@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_paragraph_chunks_hold_all_and_are_bounded(text, size):
    got = chunks.by_paragraph(text, size, 0)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert all(len(c) <= size + 1 for c in got)


def test_lines_carry_the_end_forward():
    assert chunks.by_line("aaaaaa\nbbbbbb\ncc", 10, 3) == ["aaaaaa", "aaa\nbbbbbb", "bbb\ncc"]
    assert chunks.by_line("  ", 10, 3) == []


def test_sections_keep_headings_and_tables():
    text = "# One\n" + "x" * 60 + "\n## Two\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {'y' * 40} |" for i in range(60)) + "\nend"
    got = chunks.by_section(text, name="doc")
    assert got[0].startswith("문서: doc > 섹션: One\n\n")
    tables = [c for c in got if "| a | b |" in c]
    assert len(tables) == 2 and all(c.startswith("문서: doc > 섹션: Two\n\n| a | b |\n|---|---|\n") for c in tables)


def test_chunk_with_handles_null_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "abc", 9)], "id long, text string, chunk_index int")
    assert [tuple(r) for r in chunks.chunk_with(df, chunks.by_line).collect()] == [(3, 0, "abc")]


NAMES = {
    "~$manual.docx": (False, "temp_file"),
    "12.PDF": (False, "numeric_only"),
    "User Manual wiring.pdf": (True, "keyword:user manual"),
    "layout.pdf": (False, "exclude:layout"),
    "16-01-A01-0.pdf": (False, "drawing_number"),
    "HG1806-S02.pdf": (False, "project_drawing"),
    "press  handler.pdf": (True, r"equipment:press\s+handler"),
    "x.pdf": (False, "no_keyword"),
}


def test_file_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", V.classify_filename(F.col("n")).alias("v"))
    assert {r.n: tuple(r.v) for r in df.collect()} == NAMES


def test_answers_questions_and_reports(spark):
    df = spark.createDataFrame([("1. run-12 p.3 CS-7 매뉴얼 " + "x" * 200,), ("없습니다.",)], "a string")
    good, bad = [r[0] for r in df.select(V.answer_quality(F.col("a"))).collect()]
    assert good.score == 1.0 and not good.needs_improvement and len(good.reasons) == 5
    assert bad.score == 0.2 and bad.needs_improvement and bad.reasons == ["답변이 너무 짧음", "정보 부족 표현 1건"]
    q = spark.createDataFrame([("motor alarm error",), ("hello",), (None,)], "q string").select(V.question_topics(F.col("q")))
    assert [r[0] for r in q.collect()][:2] == [["alarm", "motor"], ["general"]]
    nc = spark.createDataFrame([("긴급 배선 불량\nP-12345",), ("fine",)], "t string").select(V.parse_nc(F.col("t")))
    assert [r[0] and tuple(r[0]) for r in nc.collect()] == [("긴급 배선 불량", "electrical_defect", "critical", "P-12345"), None]
    h = spark.createDataFrame([("# A\ntext\n### B c\n##### no",)], "t string").select(V.headings(F.col("t")))
    assert [tuple(x) for x in h.first()[0]] == [(1, "A"), (3, "B c")]
    f = spark.createDataFrame([('<figure><img src="a.png"><figcaption>x <b>y</b></figcaption></figure>',)], "t string").select(V.figures(F.col("t")))
    assert [tuple(x) for x in f.first()[0]] == [("a.png", "x y")]


def test_knn_leaves_out_null_zero_and_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.0, 1.0])], "id long, embedding array<double>")
    got = neighbours.knn(v.withColumnRenamed("id", "query_id"), v, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.similarity) for r in got] == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (5, 5, 1.0), (6, 6, 1.0), (6, 1, 0.0)]


def test_purge_takes_null_as_no(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "id long, n int")
    kept, counts = records.purge(df, {"low": F.col("n") < 1, "high": F.col("n") > 4})
    assert [r.id for r in kept.collect()] == [2]
    assert {r.rule: r.n for r in counts.collect()} == {"low": 1, "high": 1}


def test_registry_binds_values(spark):
    r = QueryRegistry(spark)
    r.register("q", "SELECT :a AS a")
    assert r.run("q", a="x'; --").first().a == "x'; --"
    assert r.list() == [{"name": "q", "description": "", "params": ["a"]}]
    with pytest.raises(KeyError):
        r.run("none")


def ran(spark, tmp_path, schema, batches, job, name, mode):
    """All rows that a stream gives for files that come one after the other."""
    src = tmp_path / "in"
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{i}"))
        for p in (tmp_path / f"b{i}").glob("part-*.json"):
            p.rename(src / f"{i}.json")
            os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_transitions_stream(spark, tmp_path):
    batches = [[(1, "a", at(0), True), (2, "a", at(1), True)], [(3, "a", at(2), False), (4, "b", at(2), False)], [(5, "a", at(3), False), (6, "b", at(3), True)]]
    got = ran(spark, tmp_path, "event_id long, agent_id string, ts timestamp, online boolean", batches, stateful.stream_transitions, "flips", "append")
    assert sorted((r.event_id, r.agent_id, r.online) for r in got) == [(1, "a", True), (3, "a", False), (6, "b", True)]


def test_tasks_stream_ends_as_the_fold(spark, tmp_path):
    schema = "task_id long, time timestamp, id long, kind string"
    batches = [[(1, at(0), 1, "request"), (2, at(0), 2, "chat")], [(1, at(5), 3, "complete")], [(1, at(2), 4, "progress"), (3, at(6), 5, "blocked")]]
    got = ran(spark, tmp_path, schema, batches, stateful.stream_tasks, "tasks", "update")
    assert got[0].status == "pending" and {(r.task_id, r.status) for r in got} == {(1, "pending"), (1, "done"), (3, "blocked")}
    known = spark.createDataFrame([], "task_id long, status string, completed_at timestamp")
    batch = records.fold_tasks(known, spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert {(r.task_id, r.status) for r in batch} == {(1, "done")}  # reports about tasks that nobody requested make none


def test_message_and_window_streams(spark, tmp_path):
    ddl = "`from` string, `to` string, content string, time timestamp"
    at = [dt.datetime(2024, 1, 1, 0, m) for m in range(4)]
    batches = [[("a", "b", "x" * 81, at[0]), ("a", "c", "x" * 81, at[1])], [("a", "b", "x" * 80, at[2]), (None, "b", "y", at[3])]]
    got = ran(spark, tmp_path, ddl, batches, lambda s: jobs.stream_messages(s, receiver="to"), "messages", "append")
    assert len(got) == 3
    (tmp_path / "w").mkdir()
    counts = ran(spark, tmp_path / "w", "ts timestamp, tool_name string", [[(at[0], "t"), (at[3], "t")], [(at[1], "t")]], lambda s: jobs.stream_counts(s, "2 minutes"), "counts", "complete")
    assert sorted((r.start, r.n) for r in counts) == [(at[0], 2), (at[2], 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text('{"type":"assistant","requestId":"r","message":{"role":"assistant","content":[{"t":1}],"usage":{"input_tokens":3,"output_tokens":4}}}\n{bad\n{"type":"summary"}\n')
    row = files.read_transcripts(spark, str(tmp_path / "p"), {"p": "agent"}).collect()
    assert [(r.agent, r.request_id, r.content.toJson(), r.output_tokens) for r in row] == [("agent", "r", '[{"t":1}]', 4)]
    (tmp_path / "c.json").write_text('{"X":[{"name":"n","standard":"s"},{"name":" "}],"Y":[{"name":"m"}]}')
    assert sorted(tuple(r) for r in files.read_checklists(spark, str(tmp_path / "c.json"), {"X": "press"}).collect()) == [("Y", 0, "m", None), ("press", 0, "n", "s")]
    (tmp_path / "a.csv").write_text("﻿id,title,file\n1,t, a.pdf \n2,u,  \n")
    assert [tuple(r) for r in files.read_attachment_csv(spark, str(tmp_path / "a.csv"), "id", "title", "file").collect()] == [("1", "t", "a.pdf")]
    (tmp_path / "d.json").write_text('[{"id":"1","from":"a","content":"x","time":"2024-01-01T16:00:00Z"}]')
    msgs = files.read_messages(spark, str(tmp_path / "d.json"))
    files.write_messages(msgs, str(tmp_path / "out"))
    assert [str(r.day) for r in spark.read.json(str(tmp_path / "out")).select("day").collect()] == ["2024-01-02"]


def test_markers(spark):
    df = spark.createDataFrame([("see [매뉴얼 이미지: http://h/a.png] this [참조: http://h/b page 3]", '<channel source="agent-channel" from="me" ts="1">hi\nyou</channel><channel source="agent-channel"> </channel>')], "t string, c string")
    r = df.select(V.media_markers(F.col("t")).alias("m"), V.channel_tags(F.col("c")).alias("c")).first()
    assert (r.m.text, r.m.images, [tuple(x) for x in r.m.refs], r.m.excerpts) == ("see  this", ["http://h/a.png"], [("http://h/b", "page 3")], [])
    assert [tuple(x) for x in r.c] == [("me", "1", "hi\nyou")]


def test_sheets_and_names(spark):
    rows = spark.createDataFrame([("s", 2, "c", None), ("s", 1, "a", " b "), ("s", 3, " ", None), ("t", 1, None, None)], "sheet string, no int, x string, y string")
    got = chunks.chunk_rows(rows, ["sheet"], "no", ["x", "y"]).collect()
    assert [(r.sheet, r.chunk_index, r.content) for r in got] == [("s", 0, "## s\n\na | b\nc")]
    names = spark.createDataFrame([("Press_Unit (EN)_v1.2 20240101.pdf",), ("A--B.docx",)], "n string")
    assert [r[0] for r in names.select(V.normalize_name(F.col("n"))).collect()] == ["press unit", "a b"]
