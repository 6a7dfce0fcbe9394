"""Registered queries of progress, classification, task, message and graph reports, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorops.functions import text as T
from floorops.functions import verdicts as V
from floorops.operators import corpus, curation, records, reports, retrieval, texts
from floorops.plans import fixtures as fx
from floorops.plans.queries import FILES, NC, PROJECTS, RELS, _rels, query

PROGRESS = """(SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'bare' || o_orderkey ELSE o_orderpriority || '/' || o_orderkey END AS path,
 CASE o_orderkey % 7 WHEN 0 THEN 'embedded' WHEN 1 THEN 'parsed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' WHEN 4 THEN 'odd' WHEN 5 THEN 'in_progress' END AS status FROM orders)"""
STATUSES = ["parsed", "embedded", "skipped", "in_progress", "error", "pending"]


@query(f"""SELECT category, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)}, count(*) AS total, count(*) FILTER (status IN ('embedded', 'skipped', 'parsed')) AS done,
 round(count(*) FILTER (status IN ('embedded', 'skipped', 'parsed')) * 100.0 / count(*), 1) AS done_pct
FROM (SELECT unnest([CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'unknown' END, 'all']) AS category, coalesce(status, 'pending') AS status FROM {PROGRESS}) GROUP BY 1""")
def progress_report(s, d):
    i = F.col("o_orderkey")
    path = F.when(i % 10 == 0, F.concat(F.lit("bare"), i)).otherwise(F.concat_ws("/", "o_orderpriority", i.cast("string")))
    status = F.get(F.array(*[F.lit(x) for x in ("embedded", "parsed", "skipped", "error", "odd", "in_progress", None)]), (i % 7).cast("int"))
    return corpus.progress_report(fx.table(s, d, "orders").select(path.alias("path"), status.alias("status")), STATUSES)


@query(f"""SELECT coalesce(nullif(trim(category), ''), 'unknown') AS category, count(DISTINCT path) AS files, count(*) AS chunks, round(count(DISTINCT path) * 100.0 / 1939, 1) AS share FROM {FILES} GROUP BY 1
UNION ALL SELECT 'total', count(DISTINCT path), count(*), round(count(DISTINCT path) * 100.0 / 1939, 1) FROM {FILES}""")
def embed_share(s, d):
    return corpus.embed_progress(fx.files(s, d), 1939)


#: Names that meet each rule for names of manuals, with the rule's verdict, written down by hand.
CASES = [
    ("~$manual.docx", False, "temp_file"), ("12.PDF", False, "numeric_only"), ("User Manual wiring.pdf", True, "keyword:user manual"), ("layout.pdf", False, "exclude:layout"),
    ("16-01-A01-0.pdf", False, "drawing_number"), ("HG1806-S02.pdf", False, "project_drawing"), ("press  handler.pdf", True, r"equipment:press\s+handler"), ("x.pdf", False, "no_keyword"),
]
CASE_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', {str(m).lower()}, '{r}')" for i, (n, m, r) in enumerate(CASES)) + ") AS c(k, name, is_manual, reason)"


def _cases(s, d):
    return fx.files(s, d).withColumn("name", F.get(F.array(*[F.lit(n) for n, _, _ in CASES]), (F.col("doc_id") % len(CASES)).cast("int")))


@query(f"SELECT doc_id, name, is_manual, reason FROM documents JOIN {CASE_SQL} ON doc_id % {len(CASES)} = k")
def is_manual_rules(s, d):
    return _cases(s, d).select("doc_id", "name", V.classify_filename(F.col("name")).alias("v")).select("doc_id", "name", "v.is_manual", "v.reason")


@query(f"""WITH f AS (SELECT category, reason, CASE WHEN NOT is_manual THEN 'excluded' WHEN row_number() OVER (PARTITION BY hash, is_manual ORDER BY category, path) = 1 THEN 'manual' ELSE 'duplicate' END AS verdict
  FROM {FILES} JOIN {CASE_SQL} ON doc_id % {len(CASES)} = k),
l AS (SELECT 'all' AS dim, 'all' AS key, verdict FROM f UNION ALL SELECT 'category', category, verdict FROM f UNION ALL SELECT 'reason', reason, verdict FROM f WHERE verdict = 'excluded')
SELECT dim, key, count(*) AS total, count(*) FILTER (verdict = 'manual') AS manual, count(*) FILTER (verdict = 'excluded') AS excluded, count(*) FILTER (verdict = 'duplicate') AS duplicate FROM l GROUP BY 1, 2""")
def classification_report(s, d):
    return curation.classification_report(curation.classified(_cases(s, d)))


TASKS = """(SELECT CAST(o_custkey % 50 AS VARCHAR) AS agent, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'done' ELSE 'blocked' END AS status,
 CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS updated_at FROM orders)"""


@query(f"""SELECT agent, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('pending', 'in_progress')) AS active,
 count(*) FILTER (status = 'in_progress' AND TIMESTAMP '1998-01-01' - updated_at > INTERVAL 15 MINUTE) AS stalled, count(*) AS total
FROM (SELECT unnest([agent, 'all']) AS agent, status, updated_at FROM {TASKS}) GROUP BY 1""")
def task_summary(s, d):
    i = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(x) for x in ("pending", "in_progress", "done", "blocked")]), (i % 4).cast("int"))
    tasks = fx.table(s, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("agent"), status.alias("status"), F.when(i % 9 != 0, F.col("o_orderdate").cast("timestamp")).alias("updated_at"))
    return records.task_summary(tasks, "1998-01-01 00:00:00", ["pending", "in_progress", "done"])


@query("SELECT p_partkey AS item_cd, p_name AS item_nm, CAST(p_partkey % 17 AS INTEGER) AS good_qty FROM part WHERE p_partkey % 17 = 0")
def zero_stock(s, d):
    return records.zero_stock(_stock(s, d))


def _stock(s, d):
    return fx.table(s, d, "part").select(F.col("p_partkey").alias("item_cd"), F.col("p_name").alias("item_nm"), (F.col("p_partkey") % 17).cast("int").alias("good_qty"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS region, CAST(o_custkey % 10 AS VARCHAR) AS handler, count(*) AS open, count(*) FILTER (DATE '1998-08-10' - CAST(o_orderdate AS DATE) > 30) AS over_30, CAST(max(DATE '1998-08-10' - CAST(o_orderdate AS DATE)) AS INTEGER) AS oldest
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2
UNION ALL SELECT 'stock', NULL, count(*) FILTER (p_partkey % 17 = 0), NULL, NULL FROM part""")
def backlog_report(s, d):
    o = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    closed = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    history = o.select(F.col("c_nationkey").alias("region"), (F.col("o_custkey") % 10).alias("handler"), F.to_date("o_orderdate").alias("received_at"), closed.alias("closed_at"))
    return records.backlog_report(history, _stock(s, d), "1998-08-10")


@query("""WITH u AS (SELECT CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'r' || user_id END AS request_id, event_id % 11 AS output_tokens, event_id AS no FROM events)
SELECT request_id, output_tokens, no FROM u QUALIFY coalesce(request_id, '') = '' OR row_number() OVER (PARTITION BY request_id ORDER BY output_tokens DESC, no) = 1""")
def usage_dedup_missing(s, d):
    rid = F.when(F.col("user_id") % 5 == 0, None).when(F.col("user_id") % 5 == 1, "").otherwise(F.concat(F.lit("r"), "user_id"))
    usage = fx.table(s, d, "events").select(rid.alias("request_id"), (F.col("event_id") % 11).alias("output_tokens"), F.col("event_id").alias("no"))
    return records.dedup_usage(usage, "no", keep_missing=True)


@query(f"""SELECT importance, count(*) FILTER (WHERE done IS NULL) AS total_open, count(*) FILTER (WHERE done IS NULL AND p.delivery_date BETWEEN DATE '2001-08-06' AND DATE '2001-08-06' + INTERVAL 30 DAY AND p.status NOT IN ('완료', '취소', 'completed', 'cancelled')) AS delivery_risk,
count(*) FILTER (WHERE done IS NOT NULL AND updated_at + INTERVAL 9 HOUR >= TIMESTAMP '2001-08-06') AS closed_this_week
FROM {NC} n LEFT JOIN {PROJECTS} p ON p.id = n.project_id GROUP BY 1""")
def nc_weekly_summary_local(s, d):
    """On Sunday evening by UTC, which is Monday morning in Seoul."""
    return reports.nc_weekly_summary(fx.nc_reports(s, d), fx.projects(s, d), "2001-08-05 20:00:00", tz="Asia/Seoul")


EITHER = "(SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"


@query(f"SELECT src, dst, type FROM {RELS} WHERE src IN (SELECT id FROM {EITHER}) OR dst IN (SELECT id FROM {EITHER})")
def induced_rels_either(s, d):
    a = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    b = fx.table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return retrieval.induced(_rels(s, d), a.unionByName(b), "either")


NEAR = f"(SELECT * FROM (SELECT *, dst || '-' || src AS id FROM {RELS}) WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY id LIMIT 50)"


@query(f"SELECT 'rel' AS kind, id FROM {NEAR} UNION ALL SELECT DISTINCT 'node', unnest([src, dst]) FROM {NEAR}")
def graph_neighbours(s, d):
    rels = _rels(s, d).withColumn("id", F.concat_ws("-", "dst", "src"))
    nodes = fx.table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(fx.table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    seeds = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    near, found = retrieval.neighbours(nodes, rels, seeds)
    return found.select(F.lit("rel").alias("kind"), "id").unionByName(near.select(F.lit("node").alias("kind"), "id"))


HEADS = "['', '[MAX 승인] ', '## ', '재검증 ']"


@query(f"""WITH m AS (SELECT conv_id, turn, ['MAX', 'crafter', '', NULL, 'qa'][CAST(turn % 5 + 1 AS INTEGER)] AS to_, {HEADS}[CAST(conv_id % 4 + 1 AS INTEGER)] || text AS content FROM conversations)
SELECT conv_id, turn, "to_" AS "to", substr(trim(regexp_replace(trim(split_part(trim(content), chr(10), 1)), '^#+', '')), 1, 100) AS task FROM m
WHERE to_ IN ('crafter', 'qa') AND conv_id % 4 NOT IN (1, 3) AND length(trim(content)) >= 30 AND NOT (trim(content) LIKE '%?' AND length(trim(content)) < 60)""")
def task_messages(s, d):
    to = F.get(F.array(*[F.lit(x) for x in ("MAX", "crafter", "", None, "qa")]), (F.col("turn") % 5).cast("int"))
    head = F.get(F.array(*[F.lit(x) for x in ("", "[MAX 승인] ", "## ", "재검증 ")]), (F.col("conv_id") % 4).cast("int"))
    rows = fx.table(s, d, "conversations").select("conv_id", "turn", to.alias("to"), F.concat(head, "text").alias("content"))
    return texts.task_messages(rows).select("conv_id", "turn", "to", "task")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0 AND conv_id % 4 <> 0")
def agent_replies(s, d):
    boot = F.when(F.col("turn") % 3 == 0, " 준비 완료").when(F.col("conv_id") % 4 == 0, "기동 완료").otherwise("")
    rows = fx.table(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("from"), F.concat("text", boot).alias("content"))
    return texts.agent_replies(rows, "assistant").select("conv_id", "turn")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unknown') AS session_name,
 regexp_replace(regexp_extract(url || ' a:b', '([^/]*)$', 1), '[ /\\:*?"<>|]', '_', 'g') AS file_name FROM pages""")
def safe_name_modes(s, d):
    url = F.col("url")
    return fx.table(s, d, "pages").select("page_id", T.safe_name(url, "session").alias("session_name"), T.safe_name(F.concat(url, F.lit(" a:b")), "file").alias("file_name"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN source END AS source, CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars AS BIGINT) END AS pages FROM documents""")
def read_metadata(s, d):
    good = V.metadata_json("source", F.col("n_chars").alias("pages"), F.lit("x").alias("other"))
    made = F.when(F.col("doc_id") % 4 == 0, good).when(F.col("doc_id") % 4 == 1, V.metadata_json("source", F.lit("many").alias("pages"))).when(F.col("doc_id") % 4 == 2, F.lit("{broken"))
    return fx.table(s, d, "documents").select("doc_id", V.read_metadata(made, "source STRING, pages BIGINT").alias("m")).select("doc_id", "m.source", "m.pages")


@query("""SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest([1, 3, 2]) AS level, unnest(['Title ' || doc_id, 'B c', 'last']) AS heading FROM documents WHERE doc_id % 2 = 0""")
def headings_of_sections(s, d):
    md = F.concat(F.lit("# Title "), "doc_id", F.lit("\ntext # no\n###   B c  \n##### too deep\n#none\n## "), F.repeat(F.lit("x"), F.lit(80)), F.lit("\n## last"))
    rows = fx.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, md).otherwise(F.col("text")).alias("md")).filter("doc_id % 2 = 0 or not md rlike '(?m)^#{1,4} '")
    return rows.select("doc_id", F.posexplode(V.headings(F.col("md"))).alias("pos", "h")).select("doc_id", "pos", "h.*")


MESSAGES = [
    ("긴급 배선 불량\nP-12345 확인", "긴급 배선 불량", "electrical_defect", "critical", "P-12345"),
    ("오늘 회의는 없습니다", None, None, None, None),
]
NC_SQL = "(VALUES " + ", ".join("(" + ", ".join([str(i), *["NULL" if x is None else f"'{x}'" for x in m[1:]]]) + ")" for i, m in enumerate(MESSAGES)) + ") AS c(k, title, type, importance, part_no)"


@query(f"SELECT o_orderkey, title, type, importance, part_no FROM orders JOIN {NC_SQL} ON o_orderkey % {len(MESSAGES)} = k")
def nc_from_messages(s, d):
    text = F.get(F.array(*[F.lit(m[0]) for m in MESSAGES]), (F.col("o_orderkey") % len(MESSAGES)).cast("int"))
    return fx.table(s, d, "orders").select("o_orderkey", V.parse_nc(text).alias("nc")).select("o_orderkey", "nc.*")


#: Names with their normal form, written down by hand.
NAMES = [("Press_Unit (EN)_v1.2 20240101.pdf", "press unit"), ("A--B.docx", "a b"), ("Manual (KR).pdf", "manual"), ("[20240101] y V2.0.pdf", "y"), ("HGDCH02305001 Press.pdf", "hgdchpress"), ("noext", "noext")]
NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(NAMES)) + ") AS c(k, file, name)"


@query(f"SELECT doc_id, file, name FROM documents JOIN {NAMES_SQL} ON doc_id % {len(NAMES)} = k")
def normalized_names(s, d):
    rows = fx.table(s, d, "documents").select("doc_id", F.get(F.array(*[F.lit(a) for a, _ in NAMES]), (F.col("doc_id") % len(NAMES)).cast("int")).alias("file"))
    return rows.withColumn("name", V.normalize_name(F.col("file")))


@query("""SELECT conv_id, turn, trim(text || ' see ') || CASE WHEN turn % 2 = 0 THEN '' ELSE '  and' END AS text, 'http://h/' || conv_id || '.png' AS images,
 CASE WHEN turn % 2 = 0 THEN '' ELSE 'http://h/' || turn || ' page ' || turn END AS refs, CASE WHEN turn % 3 = 0 THEN 'http://x/' || conv_id ELSE '' END AS excerpts FROM conversations""")
def media_markers(s, d):
    odd = F.col("turn") % 2 != 0
    said = F.concat(
        F.trim(F.concat("text", F.lit(" see "))), F.lit("[매뉴얼 이미지: http://h/"), "conv_id", F.lit(".png]"),
        F.when(odd, F.concat(F.lit(" [참조: http://h/"), "turn", F.lit(" page "), "turn", F.lit("] and"))).otherwise(""),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" 📎 매뉴얼 발췌본: http://x/"), "conv_id")).otherwise(""),
    )
    m = fx.table(s, d, "conversations").select("conv_id", "turn", V.media_markers(said).alias("m"))
    refs = F.array_join(F.transform("m.refs", lambda r: F.concat_ws(" ", r["url"], r["label"])), ",")
    return m.select("conv_id", "turn", "m.text", F.array_join("m.images", ",").alias("images"), refs.alias("refs"), F.array_join("m.excerpts", ",").alias("excerpts"))


@query("""SELECT conv_id, turn, 0 AS pos, role AS sender, CAST(turn AS VARCHAR) AS ts, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS content FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'unknown', '', 'second' FROM conversations WHERE turn % 2 = 0""")
def channel_tags(s, d):
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    said = F.concat(
        F.lit('x <channel source="agent-channel" from="'), "role", F.lit('" ts="'), "turn", F.lit('">\n'), text, F.lit('\n</channel><channel source="other">no</channel><channel source="agent-channel"> </channel>'),
        F.when(F.col("turn") % 2 == 0, '<channel id="7" source="agent-channel">second</channel>').otherwise(""),
    )
    rows = fx.table(s, d, "conversations").select("conv_id", "turn", F.posexplode(V.channel_tags(said)).alias("pos", "m"))
    return rows.select("conv_id", "turn", "pos", F.col("m.from").alias("sender"), "m.ts", "m.content")
