import json

from floorops.operators import chunks
from floorops.sources import files


def test_windows_under_headings():
    text = "# One\n" + "x" * 150 + "\n\ny\n## Two\nshort\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {'y' * 20} |" for i in range(10)) + "\n" + "z" * 60
    got = chunks.by_heading(text, size=100, overlap=10, least=30, table=120, name="doc")
    assert got[0] == "문서: doc > 섹션: One\n\n" + ("# One\n" + "x" * 150)[:100]
    assert got[1] == "문서: doc > 섹션: One\n\n" + ("# One\n" + "x" * 150 + "\n\ny")[90:].strip()
    tables = [c for c in got if "| a | b |" in c]
    assert len(tables) == 4 and all(c.startswith("문서: doc > 섹션: Two\n\n| a | b |\n|---|---|\n") and len(c.split("\n\n", 1)[1]) <= 120 for c in tables)
    # the short text of the second section joins the one after the table and takes its place before it
    joined = "문서: doc > 섹션: Two\n\n## Two\nshort\n\n" + "z" * 60
    assert got[2] == joined and len(got) == 7


def test_short_texts_that_do_not_fit_stand_alone():
    assert chunks._joined_short(["a", "b" * 9, "c", "d", "e" * 9, "f"], 5, 10) == ["a", "b" * 9, "c\n\nd", "e" * 9, "f"]
    assert chunks._joined_short(["a", "b"], 5, 10) == ["a\n\nb"]
    assert chunks._joined_short(["a" * 6, "b"], 5, 10) == ["a" * 6 + "\n\nb"]
    assert chunks._joined_short([], 5, 10) == [] and chunks.by_heading("") == []


def test_session_fields(spark, tmp_path):
    rows = [
        {"session_id": "s", "timestamp": "t", "query": "q", "full_response": "", "answer_preview": "p", "language": "ko", "equipment_type": "press", "question_source": "slack"},
        {"timestamp": "u", "question": "old", "answer": "a"},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, rows), "{bad"]))
    got = sorted(tuple(r) for r in files.read_sessions(spark, str(tmp_path)).select("session_id", "question", "answer", "language", "equipment_type", "question_source").collect())
    assert got == [("legacy-u", "old", "a", None, None, None), ("s", "q", "p", "ko", "press", "slack")]


def test_message_fields_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "from": "a", "content": "x", "time": "2024-01-01T16:00:00Z", "type": "chat", "msg_type": "report_complete", "task_id": "t1"}, {"id": "2", "time": "2024-01-01T16:00:00Z"}]')
    (tmp_path / "b.json").write_text("[{broken")
    got = sorted((r.id, r.type, r.msg_type, r.task_id) for r in files.read_messages(spark, str(tmp_path)).collect())
    assert got == [("1", "chat", "report_complete", "t1"), ("2", None, None, None)]
