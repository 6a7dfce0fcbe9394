"""Tagged messages and tool calls of transcripts, from a folder of files."""

import json

from floorops.sources import files

TOOL, REPLY = "mcp__agent-channel__send_message", "mcp__plugin_telegram_telegram__reply"


def row(kind, content, ts="2026-01-02T03:04:05Z", **more):
    return json.dumps({"type": kind, "timestamp": ts, "message": {"role": kind, "content": content, **more}}, ensure_ascii=False)


def call(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


def test_messages_of_a_folder(spark, tmp_path):
    for d in ("proj-a", "main"):
        (tmp_path / d).mkdir()
    (tmp_path / "proj-a" / "1.jsonl").write_text(
        "\n".join(
            [
                row("user", 'x <channel source="agent-channel" from="MAX" ts="7">\n hi "you" \n</channel> y <channel source="agent-channel"> no name </channel>'),
                row("user", '<channel source="plugin:telegram:telegram" ts="8">not for this agent</channel>'),
                row("user", [{"type": "tool_result", "content": '<channel source="agent-channel">in a list</channel>'}]),
                row("user", ""),
                row("assistant", [{"type": "text", "text": "t"}, call(TOOL, to="MAX", message="done"), call(TOOL, to="", message="m"), call(TOOL, to="MAX"), call("Bash", command="ls"), call(REPLY, text="no"), "word", None, 5]),
                row("assistant", "plain text"),
                row("assistant", {"type": "tool_use", "name": TOOL, "input": {"to": "x", "message": "not in a list"}}),
                row("assistant", [call(TOOL, to="qa", message=["a", "list"]), {"type": "tool_use", "name": TOOL}]),
                row("system", "no"),
                "{bad",
                "",
            ]
        )
    )
    (tmp_path / "main" / "2.jsonl").write_text(
        "\n".join([row("user", '<channel source="plugin:telegram:telegram" chat="1">ask\nme</channel><channel source="agent-channel" from="qa">ok</channel>'), row("assistant", [call(REPLY, text="answer"), call(REPLY, text=""), call(TOOL, to="qa", message="go")], usage={"input_tokens": 1, "cache_read_input_tokens": 9})])
    )
    rows = files.read_transcripts(spark, f"{tmp_path}/*", {"main": "MAX", "proj-a": "crafter"})
    got = sorted(tuple(r) for r in files.transcript_messages(rows).select("from", "to", "content", "type", "ts").collect())
    ts = "2026-01-02T03:04:05Z"
    assert got == sorted(
        [
            ("MAX", "crafter", 'hi "you"', "chat", "7"),
            ("unknown", "crafter", "no name", "chat", ts),
            ("crafter", "MAX", "done", "chat", ts),
            ("crafter", "qa", '["a","list"]', "chat", ts),
            ("boss", "MAX", "ask\nme", "telegram", ts),
            ("qa", "MAX", "ok", "chat", ts),
            ("MAX", "boss", "answer", "telegram", ts),
            ("MAX", "qa", "go", "chat", ts),
        ]
    )
    assert {(r.agent, r.cache_read_input_tokens) for r in rows.filter("input_tokens is not null").collect()} == {("MAX", 9)}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text("\n")
    assert files.transcript_messages(files.read_transcripts(spark, str(tmp_path / "p"), {})).count() == 0
