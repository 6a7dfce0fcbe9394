"""Queries over texts, names and chunks, with SQL where it gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorops.functions import text as T
from floorops.functions import verdicts as V
from floorops.operators import chunks, texts
from floorops.plans import fixtures as fx
from floorops.plans.queries import query

NAME = "split_part(url, '/', -1)"
STEM = f"regexp_replace({NAME}, '(.)\\.[^.]*$', '\\1')"


def _name():
    return F.element_at(F.split("url", "/"), -1)


def _docs(s, d):
    return fx.table(s, d, "documents").select("doc_id", "text")


def quote(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def has(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(w)})" for w in words) + ")"


def first_of(c: str, words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {quote(w.lower())}) THEN {quote(w)}" for w in words) + " END"


EQUIPMENT_SQL = " ".join(f"WHEN regexp_matches(lower(n), {quote(p)}) THEN {quote('equipment:' + p)}" for p in V.EQUIPMENT)


@query(f"""WITH t AS (SELECT page_id, {NAME} AS n, {STEM} AS stem FROM pages), k AS (SELECT *, {first_of('lower(n)', V.MANUAL_WORDS)} AS m, {first_of('lower(n)', V.OTHER_WORDS)} AS x FROM t),
r AS (SELECT page_id, CASE WHEN starts_with(n, '~$') THEN 'temp_file' WHEN regexp_matches(lower(n), '^\\d+\\.(pdf|docx)$') THEN 'numeric_only' WHEN m IS NOT NULL THEN 'keyword:' || m WHEN x IS NOT NULL THEN 'exclude:' || x
WHEN regexp_matches(stem, '^\\d{{2,3}}-\\d{{2}}-[A-Z]\\d{{2}}-\\d') THEN 'drawing_number' WHEN regexp_matches(stem, '(?i)^(WT|HG|HP|HS|HA)\\w+-') THEN 'project_drawing' {EQUIPMENT_SQL} ELSE 'no_keyword' END AS reason FROM k)
SELECT page_id, starts_with(reason, 'keyword:') OR starts_with(reason, 'equipment:') AS is_manual, reason FROM r""")
def is_manual(s, d):
    return fx.table(s, d, "pages").select("page_id", V.classify_filename(_name()).alias("v")).select("page_id", "v.*")


@query(f"SELECT page_id FROM pages WHERE NOT {has(f'lower({NAME})', V.DRAFT_WORDS)}")
def is_draft(s, d):
    return fx.table(s, d, "pages").filter(~V.is_draft(_name())).select("page_id")


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {first_of(f'lower({NAME})', V.MANUAL_WORDS)} IS NOT NULL THEN 'keyword' WHEN {first_of(f'lower({NAME})', V.OTHER_WORDS)} IS NOT NULL THEN 'exclude' ELSE 'other' END AS reason FROM pages) GROUP BY 1""")
def classify_report(s, d):
    return texts.reason_counts(is_manual(s, d), "reason", ["keyword", "exclude"])


TAGS = r"\s*\((kr|ko|en|eng|jp|jpn|cn|chn|kor|중문|中文|중국어|한국어|일본어)\)\s*", r"_v\d+\.\d+", r"\s*v\d+\.\d+", r"\[?\d{6,8}\]?\s*"


def _untagged(name: str) -> str:
    for tag in TAGS:
        name = f"regexp_replace({name}, '{tag}', '', 'g')"
    return f"trim(regexp_replace({name}, '[\\s_\\-]+', ' ', 'g'))"


@query("SELECT page_id, " + _untagged(f"lower(regexp_replace({NAME}, '(.)\\.[^.]*$', '\\1'))") + " AS name FROM pages")
def normalize_name(s, d):
    return fx.table(s, d, "pages").select("page_id", V.normalize_name(_name()).alias("name"))


@query("""SELECT doc_id, CAST(sum(length(p)) AS BIGINT) AS chars, CASE WHEN sum(length(p)) < 500 THEN 'too_short' WHEN avg(CASE WHEN length(p) > 50 THEN 1 ELSE 0 END) < 0.3 THEN 'few_text_pages' ELSE 'ready' END AS verdict
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1""")
def assess_document(s, d):
    return chunks.assess(_docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("p")), "doc_id", "p")


@query("""SELECT verdict, count(*) AS n FROM (SELECT doc_id, CASE WHEN sum(length(p)) < 500 THEN 'too_short' WHEN avg(CASE WHEN length(p) > 50 THEN 1 ELSE 0 END) < 0.3 THEN 'few_text_pages' ELSE 'ready' END AS verdict
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY 1) GROUP BY 1""")
def curation_totals(s, d):
    return assess_document(s, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS maker, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, maker LIMIT 20")
def manufacturer_breakdown(s, d):
    return texts.most_frequent(fx.table(s, d, "part"), "p_brand", "maker", 20)


MAKERS, KINDS, STOP = {"ring": "Ring Works", "steel": "Steel Co"}, {"small": "catalog", "large": "manual"}, ["THE"]


@query(f"""SELECT p_partkey, coalesce({first_of("lower(p_name || ' ' || p_type)", list(MAKERS)).replace("THEN 'ring'", "THEN 'Ring Works'").replace("THEN 'steel'", "THEN 'Steel Co'")}, 'unknown') AS maker,
coalesce({first_of("lower(p_name || ' ' || p_type)", list(KINDS)).replace("THEN 'small'", "THEN 'catalog'").replace("THEN 'large'", "THEN 'manual'")}, 'document') AS type FROM part""")
def document_metadata(s, d):
    return fx.table(s, d, "part").select("p_partkey", V.document_metadata(F.col("p_name"), F.col("p_type"), MAKERS, KINDS, STOP).alias("m")).select("p_partkey", "m.maker", "m.type")


@query("SELECT page_id, nullif(regexp_extract(url, '(20\\d{2})', 1), '') AS year, nullif(regexp_extract(url, '[(（]([^)）]*)[)）]', 1), '') AS inside FROM pages")
def project_meta(s, d):
    return fx.table(s, d, "pages").select("page_id", V.project_meta(F.col("url")).alias("m")).select("page_id", "m.*")


def _topic_hits() -> str:
    hits = ", ".join("{'n': -(" + " + ".join(f"CAST(contains(q, {quote(w.lower())}) AS INT)" for w in ws) + f"), 'i': {i}, 't': {quote(t)}}}" for i, (t, ws) in enumerate(V.TOPICS.items()))
    return f"list_transform(list_sort(list_filter([{hits}], lambda x: x.n < 0))[1:3], lambda x: x.t)"


@query(f"SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'general' END AS topics FROM (SELECT conv_id, turn, {_topic_hits()} AS t FROM (SELECT *, lower(text) AS q FROM conversations))")
def question_topics(s, d):
    return fx.table(s, d, "conversations").select("conv_id", "turn", F.array_join(V.question_topics(F.col("text")), ",").alias("topics"))


LACKING = "len(regexp_extract_all(text, '없습니다\\s*[.。]|찾을 수 없|등록되어 있지 않|모르겠습니다'))"


POINTS = f"""greatest(0, least(100, 50 + CASE WHEN length(text) < 50 THEN -20 WHEN length(text) BETWEEN 200 AND 1500 THEN 10 WHEN length(text) > 1500 THEN -5 ELSE 0 END
+ CASE WHEN regexp_matches(text, '(?i)run-\\d+|ft-[\\d.]+|p\\.\\d+|페이지') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(text, '[①②③④⑤⑥⑦⑧⑨⑩]|\\d+\\.\\s|\\d+\\)') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(text, 'CS-\\d+') THEN 10 ELSE 0 END
+ CASE WHEN {has('text', ['매뉴얼', '페이지', '참조:'])} THEN 10 ELSE 0 END - CASE WHEN {LACKING} > 0 THEN 10 ELSE 0 END))"""


@query(f"SELECT doc_id, points / 100.0 AS score, points < 50 AS needs_improvement FROM (SELECT doc_id, {POINTS} AS points FROM documents)")
def answer_quality(s, d):
    return _docs(s, d).select("doc_id", V.answer_quality(F.col("text")).alias("q")).select("doc_id", "q.score", "q.needs_improvement")


def _cases(kinds: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {has('t', ws)} THEN '{k}'" for k, ws in kinds.items()) + f" ELSE '{other}' END"


@query(f"""SELECT doc_id, {_cases(V.NC_TYPES, 'assembly_defect')} AS type, {_cases(V.NC_LEVELS, 'medium')} AS importance, nullif(regexp_extract(t, '\\b([A-Z]{{1,3}}-?\\d{{4,8}}[A-Z]?)\\b', 1), '') AS part_no
FROM (SELECT doc_id, '고장 ' || text AS t FROM documents)""")
def nc_from_text(s, d):
    return _docs(s, d).select("doc_id", V.parse_nc(F.concat(F.lit("고장 "), "text")).alias("n")).select("doc_id", "n.type", "n.importance", "n.part_no")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'ring|bolt') AND regexp_matches(lower(p_name), 'small|large')")
def part_swap_flag(s, d):
    return fx.table(s, d, "part").filter(V.part_swap(F.col("p_name"), ["ring", "bolt"], ["small", "large"])).select("p_partkey")


@query("""SELECT page_id, CASE WHEN n < 30 AND g < 5 AND r = 0 THEN 'empty' WHEN g >= 20 AND r <= 1 AND n < 3000 THEN 'diagram' WHEN g >= 20 AND n >= 3000 THEN 'diagram+text' WHEN t > 0 AND g >= 10 THEN 'table+diagram' WHEN t > 0 THEN 'table'
WHEN r > 0 AND n > 100 THEN 'image+text' WHEN r > 0 THEN 'image' WHEN n > 100 THEN 'text' ELSE 'minimal' END AS type
FROM (SELECT page_id, (length(html) - 1500) // 2 AS n, len(regexp_extract_all(html, '<p')) AS g, len(regexp_extract_all(html, '<img|<aside')) AS r, len(regexp_extract_all(html, '<table|<ul')) AS t FROM pages)""")
def page_type(s, d):
    def times(tag):
        return F.regexp_count("html", F.lit(tag))

    return fx.table(s, d, "pages").select("page_id", T.page_type(F.expr("(char_length(html) - 1500) div 2"), times("<p"), times("<img|<aside"), times("<table|<ul")).alias("type"))


@query("SELECT o_orderkey, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' | ' || o_orderpriority || ' |' || chr(10) || '| ' || o_orderkey || ' |  |' AS table_md FROM orders")
def to_markdown_table(s, d):
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array("o_orderstatus", "o_orderpriority", F.lit("cut")), F.array(F.col("o_orderkey").cast("string")))
    return fx.table(s, d, "orders").select("o_orderkey", V.markdown_table(rows).alias("table_md"))


@query("""SELECT event_id, CAST(m AS VARCHAR) AS monday, CAST(m + 4 AS VARCHAR) AS friday, CAST(m + 6 AS VARCHAR) AS sunday, CAST(week(m) AS INTEGER) AS week FROM (SELECT event_id, CAST(date_trunc('week', ts + INTERVAL 9 HOUR) AS DATE) AS m FROM events)""")
def week_bounds(s, d):
    return fx.table(s, d, "events").select("event_id", V.week_bounds(F.col("ts"), "Asia/Seoul").alias("w")).select("event_id", *[F.col(f"w.{c}").cast("string").alias(c) for c in ("monday", "friday", "sunday")], "w.week")


@query("SELECT event_id, ts + INTERVAL 9 HOUR AS local FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def to_local_ts(s, d):
    return fx.table(s, d, "events").select("event_id", V.to_local(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "Asia/Seoul").alias("local"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date_multi(s, d):
    forms = ["yyyy-MM-dd", "yyyy.MM.dd", "yyyy/M/d", "yyyyMMdd", "yyyy'년 'M'월 'd'일'"]
    day = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])
    return fx.table(s, d, "orders").select("o_orderkey", T.parse_date(day).alias("day"))


@query("SELECT c_custkey, CAST(nullif(CAST(c_acctbal AS DECIMAL(18,4)), 0) AS DOUBLE) AS amount FROM customer")
def safe_decimal(s, d):
    return fx.table(s, d, "customer").select("c_custkey", T.safe_decimal(F.format_number("c_acctbal", 4)).cast("double").alias("amount"))


@query("SELECT doc_id, text FROM documents")
def fix_mojibake(s, d):
    broken = F.when(F.col("text").rlike(r"^[\x00-\x{10FFFF}]*[^\x00-\x7F][\x00-\x{10FFFF}]*$"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).otherwise(F.col("text"))
    return _docs(s, d).select("doc_id", T.fix_mojibake(broken).alias("text"))


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[])), 4) AS cosine FROM embeddings")
def truncate_vector(s, d):
    return fx.table(s, d, "embeddings").select("vec_id", F.round(T.cosine(T.truncate_vector(F.col("embedding"), 16), F.slice("embedding", 17, 16)), 4).alias("cosine"))


@query("SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS n FROM documents")
def metadata_json(s, d):
    made = fx.table(s, d, "documents").select("doc_id", V.metadata_json("lang", "n_chars").alias("metadata"))
    return made.select("doc_id", F.get_json_object("metadata", "$.lang").alias("lang"), F.from_json("metadata", "lang STRING, n_chars BIGINT")["n_chars"].alias("n"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'steel ring', 'sr'), 'steel', 's'), 'ring', 'r') AS name FROM part")
def translate_name(s, d):
    return fx.table(s, d, "part").select("p_partkey", V.translate_name(F.col("p_name"), {"ring": "r", "steel": "s", "steel ring": "sr"}).alias("name"))


@query("SELECT o_orderkey, 'status: ' || o_orderstatus || chr(10) || 'charge: ' || CASE WHEN o_orderstatus = 'F' THEN 'free' ELSE 'paid' END AS content, o_orderstatus AS status FROM orders")
def build_text(s, d):
    text = V.labelled_text({"status": F.col("o_orderstatus"), "note": F.lit(" "), "charge": F.when(F.col("o_orderstatus") == "F", "free").otherwise("paid")})
    return fx.table(s, d, "orders").select("o_orderkey", text.alias("content"), V.labelled(text, "status").alias("status"))


@query()
def extract_figures(s, d):
    return fx.table(s, d, "pages").select("page_id", F.posexplode(V.figures(F.col("html"))).alias("pos", "f")).select("page_id", "pos", "f.*")


@query()
def headings(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(V.headings(F.col("text"))).alias("pos", "h")).select("doc_id", "pos", "h.*")


@query()
def chunk_paragraph(s, d):
    return chunks.chunk_with(_docs(s, d), chunks.by_paragraph, size=800, overlap=100)


@query()
def chunk_line(s, d):
    return chunks.chunk_with(_docs(s, d), chunks.by_line)


@query()
def chunk_markdown(s, d):
    docs = _docs(s, d).withColumn("name", F.col("doc_id").cast("string"))
    return chunks.chunk_with(docs, chunks.by_section, name_col="name")


def _lines(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


LINES = "(SELECT doc_id, unnest(range(len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"SELECT doc_id, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS chunk_index FROM {LINES}")
def chunk_index(s, d):
    return chunks.with_index(_lines(s, d), ["doc_id"], ["no"], 1).drop("line")


@query(f"SELECT doc_id, count(*) AS chunks, count(*) FILTER (length(line) < 50) AS short, count(*) FILTER (length(line) >= 50) AS long FROM {LINES} GROUP BY 1")
def chunk_stats(s, d):
    return chunks.chunk_stats(_lines(s, d), "doc_id", F.when(F.char_length("line") < 50, "short").otherwise("long"), ["short", "long"])


@query(f"SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY no) AS markdown FROM {LINES} GROUP BY 1")
def document_markdown(s, d):
    return chunks.document_markdown(_lines(s, d), "doc_id", "no", "line")


@query("""WITH e AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'heading' WHEN 3 THEN 'image' ELSE 'paragraph' END AS kind FROM conversations),
p AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM e)
SELECT i.conv_id, i.turn, coalesce((SELECT string_agg(x.text, chr(10) ORDER BY x.turn) FROM p x WHERE x.conv_id = i.conv_id AND x.kind = 'paragraph' AND x.p BETWEEN i.p - 2 AND i.p), '') AS context,
(SELECT arg_max(x.text, x.turn) FROM p x WHERE x.conv_id = i.conv_id AND x.kind = 'heading' AND x.turn <= i.turn) AS heading FROM p i WHERE kind = 'image'""")
def context_window(s, d):
    kind = F.when(F.col("turn") % 4 == 0, "heading").when(F.col("turn") % 4 == 3, "image").otherwise("paragraph")
    return chunks.with_context(fx.table(s, d, "conversations").withColumn("kind", kind), "conv_id", "turn", "text", "kind")


@query("""SELECT doc_id, CASE WHEN rn = 1 THEN name ELSE name || '_' || rn END AS new_name FROM (SELECT doc_id, 'f' || doc_id % 100 AS name, row_number() OVER (PARTITION BY source, doc_id % 100 ORDER BY doc_id) AS rn FROM documents)""")
def resolve_collisions(s, d):
    named = fx.table(s, d, "documents").select("doc_id", "source", F.concat(F.lit("f"), (F.col("doc_id") % 100).cast("string")).alias("name"))
    return chunks.resolve_names(named, "source", "name", ["doc_id"]).select("doc_id", "new_name")


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(lang, '')) <> ''")
def embeddable_rows(s, d):
    return texts.embeddable(fx.table(s, d, "documents"), "text", "lang").select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE (contains(text, 'the') OR contains(role, 'the')) AND role = 'user'")
def session_search(s, d):
    return texts.session_search(fx.table(s, d, "conversations"), "the", ["text", "role"], {"role": "user"}).select("conv_id", "turn")


@query(f"""SELECT conv_id, turn FROM (SELECT *, trim(text) AS t FROM conversations) WHERE length(t) >= 30 AND NOT (t LIKE '%?' AND length(t) < 60) AND NOT {has("split_part(t, chr(10), 1)", V.SKIP_WORDS)}""")
def is_task_message(s, d):
    return fx.table(s, d, "conversations").filter(V.is_task_message(F.col("text"))).select("conv_id", "turn")


@query("SELECT conv_id, turn, text AS content FROM conversations WHERE role = 'assistant' AND NOT contains(text, 'ready')")
def drop_noise_messages(s, d):
    return texts.without_noise(fx.table(s, d, "conversations").filter("role = 'assistant'"), "text", ["ready"]).select("conv_id", "turn", F.col("text").alias("content"))


@query("""WITH f AS (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '(?:figure|table|item) (\\d+)', 1)) AS BIGINT) AS no FROM documents)
SELECT f.doc_id, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS figures FROM f JOIN part ON p_size = no GROUP BY 1""")
def figure_refs(s, d):
    figs = fx.table(s, d, "part").select(F.col("p_size").cast("long").alias("no"), F.col("p_partkey").cast("string").alias("figure"))
    return texts.figure_refs(_docs(s, d), "doc_id", "text", figs, r"(?:figure|table|item) (\d{1,18})")
