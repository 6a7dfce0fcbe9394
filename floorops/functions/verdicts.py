"""Verdicts over names, questions and answers by fixed rules, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorops.functions.text import ustrip

# Words of manuals in file names, in the order in which they are tried.
MANUAL_WORDS = [
    "매뉴얼", "메뉴얼", "취급설명서", "사용자", "조작", "유지보수", "유지 보수", "사용설명", "작동설명", "운전매뉴얼", "운전 매뉴얼", "user manual", "manual", "manu_", "_manu", "instruction",
    "operation guide", "maintenance", "operator", "マニュアル", "取扱", "操作", "使用手册", "操作手册", "用户手册", "使用手冊",
]
# Words of other documents in file names, in the order in which they are tried.
OTHER_WORDS = [
    "도면", "layout", "lay out", "lay-out", "외형도", "조립도", "assembly", "drawing", "배치도", "배선도", "회로도", "wiring", "schematic", "electrical diagram",
    "pneumatic diagram", "pneumatic circuit", "공압도", "(외형)", "(전체)", "외형)", "전체)", "assy", "total_assy", "사양서", "검사성적", "성적서", "시험성적", "검사 성적",
    "spec sheet", "datasheet", "data_sheet", "data sheet", "ctlg", "catalog", "카탈로그", "견적", "quotation", "invoice", "패킹", "packing list", "납품",
    "거래명세", "발주", "주문", "계약", "명판", "nameplate", "소모품", "consumables", "spare", "bom", "부품표", "사진", "photo", "img", "이미지", "interlock", "pneumatic",
    "preumatic", "~$",
]
# Patterns of equipment in file names.
EQUIPMENT = [r"handler\s+hp\d", r"press\s+handler", "핸들러", r"(?:loading|unloading)\s+mc", "프레스핸들러", r"프레스\s*매뉴얼", "使用说明书"]
# Words of drafts in file names.
DRAFT_WORDS = ["수정중", "복사본", "작업중", "편집중", "편집후", "임시", "temp", "draft", "copy", "(com)", "참고용", "출력용", "_old", "_bak"]
# Topics of questions and their words.
TOPICS = {
    "encoder": ["엔코더", "encoder", "리셋", "reset", "절대치", "abs", "다회전"],
    "alarm": ["알람", "alarm", "에러", "error", "E.", "경고", "fault"],
    "parameter": ["파라메터", "파라미터", "parameter", "정수", "설정값", "ft-", "Ft-"],
    "wiring": ["배선", "wiring", "결선", "커넥터", "connector", "케이블"],
    "motor": ["모터", "motor", "과열", "진동", "소음", "토크"],
    "communication": ["통신", "serial", "RS232", "RS485", "ethernet", "프로토콜", "baud"],
    "maintenance": ["보수", "점검", "교체", "수리", "maintenance", "유지보수"],
    "operation": ["조작", "운전", "시운전", "원점", "JOG", "homing", "작동"],
    "plc": ["PLC", "래더", "IO", "입출력", "시퀀스"],
    "pneumatic": ["공압", "실린더", "밸브", "진공", "vacuum"],
    "vision": ["비전", "카메라", "검사", "inspection", "vision"],
    "printer": ["프린터", "라벨", "마킹", "printer", "label", "zebra"],
}
# Words of a report of non-conformance.
NC_WORDS = ["불량", "결함", "오류", "파손", "분실", "문제", "부적합", "이슈", "버그", "고장"]
# Its types and their words, in the order in which they are tried.
NC_TYPES = {
    "design_defect": ["설계", "도면", "spec", "스펙"],
    "order_error": ["발주", "주문", "오더"],
    "receiving_error": ["수입검사", "입고검사", "받았", "입고"],
    "machining_defect": ["가공", "절삭", "선반", "밀링"],
    "assembly_defect": ["조립", "어셈블리", "취부"],
    "electrical_defect": ["전장", "전기", "배선", "회로"],
    "software_defect": ["소프트웨어", "펌웨어", "sw ", "fw "],
    "improvement_request": ["개선", "요청", "제안"],
    "loss_damage": ["파손", "분실", "손상"],
    "cost_reduction": ["원가", "비용 절감", "저렴"],
}
# Its levels and their words.
NC_LEVELS = {"critical": ["긴급", "심각", "critical", "urgent", "즉시"], "high": ["높음", "high", "중요", "빨리"], "low": ["낮음", "low", "minor", "경미"]}
# Words of messages that ask for no work.
SKIP_WORDS = ["재검증", "재확인", "상태 보고", "보고해주세요", "확인해주세요", "진행 상황", "중간 보고", "여전히 미동작", "미동작", "미반영"]

# The beginnings of such messages, and receivers who are given no tasks.
TASK_PREFIXES = ["[MAX 확인]", "[MAX 전달]", "[MAX 승인]", "[MAX 확인 요청]", "[MAX 긴급]"]
NO_TASK_FOR = ("MAX", "slack-bot", "all")


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def first_word(c: Column, words: list[str]) -> Column:
    """The first of ``words`` that occurs in ``c``, else null."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w.lower())), F.lit(w)) for w in words])


def classify_filename(c: Column, codes: tuple[str, ...] = ("WT", "HG", "HP", "HS", "HA")) -> Column:
    """Struct (is_manual, reason): the first rule that speaks decides, words for manuals before words against."""
    low, stem = F.lower(c), F.regexp_replace(c, r"(?<=.)\.[^.]*$", "")
    manual, other = first_word(low, MANUAL_WORDS), first_word(low, OTHER_WORDS)

    def verdict(yes: bool, why) -> Column:
        return F.struct(F.lit(yes).alias("is_manual"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))

    out = (
        F.when(c.startswith("~$"), verdict(False, "temp_file"))
        .when(low.rlike(r"^\d+\.(pdf|docx)$"), verdict(False, "numeric_only"))
        .when(manual.isNotNull(), verdict(True, F.concat(F.lit("keyword:"), manual)))
        .when(other.isNotNull(), verdict(False, F.concat(F.lit("exclude:"), other)))
        .when(stem.rlike(r"^\d{2,3}-\d{2}-[A-Z]\d{2}-\d"), verdict(False, "drawing_number"))
        .when(stem.rlike(rf"(?i)^({'|'.join(codes)})\w+-"), verdict(False, "project_drawing"))
    )
    for pattern in EQUIPMENT:
        out = out.when(low.rlike(pattern), verdict(True, f"equipment:{pattern}"))
    return out.otherwise(verdict(False, "no_keyword"))


def is_draft(c: Column) -> Column:
    return has_any(F.lower(c), DRAFT_WORDS)


def normalize_name(c: Column) -> Column:
    """Lower-case stem without language, version and date tags, separators as single spaces."""
    s = F.lower(F.regexp_replace(c, r"(?<=.)\.[^.]*$", ""))
    s = F.regexp_replace(s, r"\s*\((kr|ko|en|eng|jp|jpn|cn|chn|kor|중문|中文|중국어|한국어|일본어)\)\s*", "")
    for tag in (r"_v\d+\.\d+", r"\s*v\d+\.\d+", r"\[?\d{6,8}\]?\s*"):
        s = F.regexp_replace(s, tag, "")
    return F.trim(F.regexp_replace(s, r"[\s_\-]+", " "))


def question_topics(c: Column) -> Column:
    """The three topics with most words in the question, ties in the table's order; ``general`` if none."""
    low = F.lower(c)
    scored = [F.struct((-reduce(Column.__add__, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("topic")) for i, (t, words) in enumerate(TOPICS.items())]
    best = F.transform(F.slice(F.sort_array(F.filter(F.array(*scored), lambda x: x["n"] < 0)), 1, 3), lambda x: x["topic"])
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("general")))


def answer_quality(c: Column) -> Column:
    """Struct (score, reasons, needs_improvement) of an answer; scores are summed in hundredths."""
    n = F.char_length(c)
    lacking = F.regexp_count(c, F.lit(r"없습니다\s*[.。]|찾을 수 없|등록되어 있지 않|모르겠습니다"))
    rules = [
        (n < 50, -20, F.lit("답변이 너무 짧음")),
        (n.between(200, 1500), 10, F.lit("충분한 길이")),
        (n > 1500, -5, F.lit("답변이 과도하게 길음")),
        (c.rlike(r"(?i)run-\d+|ft-[\d.]+|p\.\d+|페이지"), 15, F.lit("구체적 파라메터/페이지 참조 포함")),
        (c.rlike(r"[①②③④⑤⑥⑦⑧⑨⑩]|\d+\.\s|\d+\)"), 10, F.lit("단계별 절차 포함")),
        (c.rlike(r"CS-\d+"), 10, F.lit("CS 이력 참조 포함")),
        (has_any(c, ["매뉴얼", "페이지", "참조:"]), 10, F.lit("매뉴얼 참조 포함")),
        (lacking > 0, -10, F.concat(F.lit("정보 부족 표현 "), lacking.cast("string"), F.lit("건"))),
    ]
    points = reduce(Column.__add__, [F.when(hit, p).otherwise(0) for hit, p, _ in rules], F.lit(50))
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    return F.struct((score / 100).alias("score"), F.array_compact(F.array(*[F.when(hit, why) for hit, _, why in rules])).alias("reasons"), (score < 50).alias("needs_improvement"))


def parse_nc(c: Column) -> Column:
    """Struct (title, type, importance, part_no) of a message that reports a non-conformance, else null."""
    kind = F.coalesce(*[F.when(has_any(c, words), F.lit(t)) for t, words in NC_TYPES.items()], F.lit("assembly_defect"))
    level = F.coalesce(*[F.when(has_any(c, words), F.lit(t)) for t, words in NC_LEVELS.items()], F.lit("medium"))
    title = F.substring(ustrip(F.substring_index(ustrip(c), "\n", 1)), 1, 100)
    part = F.nullif(F.regexp_extract(c, r"\b([A-Z]{1,3}-?\d{4,8}[A-Z]?)\b", 1), F.lit(""))
    return F.when(has_any(c, NC_WORDS), F.struct(title.alias("title"), kind.alias("type"), level.alias("importance"), part.alias("part_no")))


def is_task_message(c: Column, prefixes: list[str] = ()) -> Column:
    """Whether a message gives a task: 30 characters, no short question, no follow-up word or prefix in its first line."""
    s = ustrip(c)
    first = ustrip(F.substring_index(s, "\n", 1))
    short = s.endswith("?") & (F.char_length(s) < 60)
    out = (F.char_length(s) >= 30) & ~short & ~has_any(first, SKIP_WORDS)
    return reduce(lambda x, p: x & ~first.startswith(p), prefixes, out)


def task_name(c: Column) -> Column:
    """The first line with text, without leading ``#``, at most 100 characters."""
    return F.substring(ustrip(F.regexp_replace(ustrip(F.substring_index(ustrip(c), "\n", 1)), "^#+", "")), 1, 100)


def document_metadata(name: Column, text: Column, makers: dict[str, str], types: dict[str, str], stop: list[str]) -> Column:
    """Struct (maker, type, model): dictionary entries in order; the model is the first upper-case token not in ``stop``."""
    low = F.lower(F.concat_ws(" ", name, text))

    def named(words: dict[str, str], default: str) -> Column:
        return F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(v)) for k, v in words.items()], F.lit(default))

    tokens = F.filter(F.regexp_extract_all(name, F.lit(r"[A-Z0-9][A-Z0-9-]{2,}"), F.lit(0)), lambda w: w.rlike("[A-Z]") & ~w.isin(stop))
    return F.struct(named(makers, "unknown").alias("maker"), named(types, "document").alias("type"), F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("model"))


def project_meta(path: Column) -> Column:
    """Struct (year, inside): the first 20xx year of a path and the text inside parentheses, also full-width ones."""
    return F.struct(F.nullif(F.regexp_extract(path, r"(20\d{2})", 1), F.lit("")).alias("year"), F.nullif(F.regexp_extract(path, r"[(（]([^)）]*)[)）]", 1), F.lit("")).alias("inside"))


def translate_name(c: Column, words: dict[str, str]) -> Column:
    """Dictionary words replaced, longest first."""
    return reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(words[k])), sorted(words, key=lambda k: (-len(k), k)), c)


def week_bounds(ts: Column, tz: str) -> Column:
    """Struct (monday, friday, sunday, week) of the local week."""
    monday = F.date_trunc("week", F.from_utc_timestamp(ts, tz)).cast("date")
    return F.struct(monday.alias("monday"), F.date_add(monday, 4).alias("friday"), F.date_add(monday, 6).alias("sunday"), F.weekofyear(monday).alias("week"))


def to_local(c: Column, tz: str) -> Column:
    """Local timestamp of ISO text (UTC) or of text ending in `` KST``; null for anything else."""
    utc = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]['Z']")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))
    kst = F.try_to_timestamp(F.regexp_replace(c, " KST$", ""), F.lit("yyyy-MM-dd HH:mm[:ss]"))
    return F.when(c.endswith(" KST"), F.from_utc_timestamp(F.to_utc_timestamp(kst, "Asia/Seoul"), tz)).otherwise(F.from_utc_timestamp(utc, tz))


def markdown_table(rows: Column) -> Column:
    """Markdown of rows of cells; rows are cut or filled to the header's width, line breaks become spaces."""
    width = F.size(F.get(rows, F.lit(0)))

    def line(r: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(1), width), lambda i: F.regexp_replace(F.coalesce(F.try_element_at(r, i), F.lit("")), r"\r?\n", " "))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def labelled_text(fields: dict[str, Column]) -> Column:
    """``label: value`` lines of the fields that hold text."""
    return F.concat_ws("\n", *[F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()])


def labelled(c: Column, label: str) -> Column:
    """The text after a line's label; null if no line has it."""
    return F.nullif(F.regexp_extract(c, rf"(?m)^{label}: (.*)$", 1), F.lit(""))


def figures(html: Column) -> Column:
    """Array of (src, caption) of the ``figure`` blocks, tags removed from captions."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<figure\b[^>]*>(.*?)</figure>"), F.lit(1))

    def one(b: Column) -> Column:
        caption = F.regexp_extract(b, r"(?is)<figcaption[^>]*>(.*?)</figcaption>", 1)
        return F.struct(F.regexp_extract(b, r"(?i)<img[^>]*\bsrc=[\"']([^\"']*)", 1).alias("src"), F.trim(F.regexp_replace(F.regexp_replace(caption, "<[^>]+>", ""), r"\s+", " ")).alias("caption"))

    return F.transform(blocks, one)


def headings(c: Column) -> Column:
    """Array of (level, heading) of Markdown headings H1 to H4 under 80 characters, in order."""
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,4}\s+\S.*)$"), F.lit(1))
    parts = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("heading")))
    return F.filter(parts, lambda x: F.char_length(x["heading"]) < 80)


# The forms of the markers.
IMAGE, REFERENCE, EXCERPT = r"\[매뉴얼 이미지:\s*(https?://[^\]]+)\]", r"\[참조:\s*(https?://\S+)\s*([^\]]*)\]", r"📎\s*매뉴얼 발췌본:\s*(https?://\S+)"


def media_markers(c: Column) -> Column:
    """Struct (text, images, refs (url, label), excerpts): media markers taken out of the text."""

    def found(form: str, group: int = 1) -> Column:
        return F.regexp_extract_all(c, F.lit(form), F.lit(group))

    refs = F.zip_with(found(REFERENCE), found(REFERENCE, 2), lambda u, n: F.struct(u.alias("url"), n.alias("label")))
    text = reduce(lambda x, form: F.regexp_replace(x, form, ""), (IMAGE, REFERENCE, EXCERPT), c)
    return F.struct(ustrip(text).alias("text"), found(IMAGE).alias("images"), refs.alias("refs"), found(EXCERPT).alias("excerpts"))


def channel_tags(c: Column, source: str = "agent-channel") -> Column:
    """Array of (from, ts, content) of the ``<channel>`` blocks of a source that hold text; an unnamed sender is ``unknown``."""
    blocks = F.regexp_extract_all(c, F.lit(rf'(?s)(<channel[^>]*source="{source}"[^>]*>.*?</channel>)'), F.lit(1))

    def one(b: Column) -> Column:
        sender = F.nullif(F.regexp_extract(b, r'\bfrom="([^"]+)"', 1), F.lit(""))
        return F.struct(F.coalesce(sender, F.lit("unknown")).alias("from"), F.regexp_extract(b, r'\bts="([^"]+)"', 1).alias("ts"), ustrip(F.regexp_replace(b, r"(?s)^<[^>]*>|</channel>$", "")).alias("content"))

    return F.filter(F.transform(blocks, one), lambda x: x["content"] != "")


def part_swap(c: Column, parts: list[str], changes: list[str]) -> Column:
    """Whether a text names a part and a change of it."""
    return has_any(F.lower(c), parts) & has_any(F.lower(c), changes)


def metadata_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def read_metadata(c: Column, fields: str) -> Column:
    """Struct of the named and typed ``fields`` of JSON metadata; null for what is missing, of another type, or no JSON object."""
    return F.from_json(c, fields, {"mode": "PERMISSIVE"})
