"""Registered queries of the library's own operators, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorops.functions import text as T
from floorops.operators import corpus, erp, feedback, logs, reports, retrieval
from floorops.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-09-01 00:00:00"
NC = """(SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '5' THEN 'low' END AS importance,
 o_custkey AS project_id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 100 END AS manager_id, o_orderkey % 97 AS reporter_id, 'NC ' || o_orderpriority AS title, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 6 DAY AS updated_at, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 5 END AS done, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""
PROJECTS = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'completed' ELSE 'active' END AS status, DATE '2001-07-01' + CAST(c_custkey % 90 AS INTEGER) AS delivery_date, CAST(c_custkey % 101 AS INTEGER) AS progress FROM customer)"
USERS = "(SELECT s_suppkey AS id, s_name AS username, substr(s_name, 1, 8) || split_part(s_name, '#', -1) AS full_name FROM supplier)"
MESSAGES = "(SELECT conv_id AS session_id, turn, role AS sender, text AS content, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS time FROM conversations)"
FILES = """(SELECT source || '/' || doc_id AS path, source AS category, CAST(doc_id % 100 AS VARCHAR) AS stem, CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.docx' END AS ext,
 n_chars AS size, substr(sha256(text), 1, 16) AS hash, doc_id, text, lang FROM documents)"""
PURCHASES = "(SELECT l_partkey AS item, p_name AS project_name, CAST(l_shipdate AS DATE) AS order_date FROM lineitem JOIN part ON l_partkey = p_partkey)"
LIMIT = "CASE importance WHEN 'critical' THEN 3 WHEN 'high' THEN 7 WHEN 'medium' THEN 14 WHEN 'low' THEN 30 ELSE 14 END"
RULES = {"ring": "ring press", "bolt": "bolt line", "gear": "gear cutter", "small": "compact cell", "large": "heavy cell", "steel": "steel line"}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT 'agent' AS dim, CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'tool', event_type, count(*) FROM events GROUP BY 2")
def tool_stats(s, d):
    return logs.tool_stats(fx.tool_log(s, d))


@query("SELECT 'agent' AS dim, CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, key LIMIT 8")
def top_n_keys(s, d):
    return logs.top_n_keys(logs.tool_stats(fx.tool_log(s, d)), "agent", 8)


@query("SELECT coalesce(role, 'unknown') AS sender, count(*) AS n FROM conversations GROUP BY 1")
def message_counts(s, d):
    return logs.sender_counts(fx.messages(s, d))


@query("""SELECT CAST(CAST(c.day AS DATE) AS VARCHAR) AS day, count(e.event_id) AS n FROM (SELECT unnest(range(DATE '2024-01-25', DATE '2024-02-01', INTERVAL 1 DAY)) AS day) c
LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(c.day AS DATE) GROUP BY 1""")
def daily_volume(s, d):
    return logs.daily_volume(fx.chat(s, d), EVENTS_AS_OF).withColumn("day", F.col("day").cast("string"))


# the exact mean: whole microseconds, tenths with halves away from zero; the mean of doubles only where a time is too large or not finite
@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS agent, value, CASE WHEN abs(value) < 9e12 THEN CAST(floor(value * 1000000 + 0.5) AS BIGINT) END AS micros FROM events WHERE value IS NOT NULL),
g AS (SELECT agent, count(*) AS n, count(micros) AS whole, sum(micros) AS s, avg(value) AS mean FROM e GROUP BY 1)
SELECT agent, n, CASE WHEN whole = n THEN CAST(sign(s) * ((2 * abs(s) + n * 100000) // (n * 200000)) AS DOUBLE) / CAST(10 AS DOUBLE) ELSE round(mean, 1) END AS avg_sec FROM g""")
def response_stats(s, d):
    return logs.response_stats(fx.response_times(s, d))


@query("""SELECT a, b, count(*) AS n FROM (SELECT least(event_type, u) AS a, greatest(event_type, u) AS b FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS u FROM events)) WHERE a <> b GROUP BY 1, 2""")
def pair_traffic(s, d):
    return logs.pair_traffic(fx.chat(s, d), "channel", "user", "hub")


SESSIONS = """WITH m AS (SELECT event_id, event_type AS channel, CAST(user_id AS VARCHAR) AS "user", ts FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY channel, "user" ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY channel, "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS no FROM g)
SELECT channel, "user", no, min(ts) AS start, max(ts) AS last, count(*) AS n{} FROM r GROUP BY channel, "user", no"""


@query(SESSIONS.format(", 'slack-' || channel || '-' || \"user\" || '-' || CAST(floor(epoch(min(ts))) AS BIGINT) AS session_id"))
def sessionize(s, d):
    return logs.session_ids(logs.sessionize(fx.chat(s, d), 600, "event_id"))


@query("""WITH m AS (
  SELECT *, event_id % 5 = 0 AS rating, lag(event_id % 5 = 0) OVER w AS after_rating,
   epoch_us(ts) - max(epoch_us(ts)) FILTER (event_id % 5 <> 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pause
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (SELECT *, sum(CASE WHEN NOT rating AND (pause IS NULL OR pause >= 86400000000 OR after_rating) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM m)
SELECT CAST(user_id AS VARCHAR) AS "user", min(ts) FILTER (NOT rating) AS start, max(ts) FILTER (NOT rating) AS last, count(*) FILTER (NOT rating) AS n, max(rating AND coalesce(pause < 86400000000, false)) AS closed
FROM s GROUP BY user_id, no HAVING count(*) FILTER (NOT rating) > 0""")
def sessionize_rated(s, d):
    """One channel, a day's pause, and every fifth event a good rating."""
    rows = fx.chat(s, d).withColumn("channel", F.lit("all"))
    return logs.sessionize(rows, 86_400, "event_id", F.col("event_id") % 5 == 0).select("user", "start", "last", "n", "closed")


@query(f"""SELECT session_id, min(time) AS first_ts, max(time) AS last_ts, CASE WHEN length(arg_min(content, turn)) > 80 THEN substr(arg_min(content, turn), 1, 80) || '...' ELSE arg_min(content, turn) END AS first_question,
count(*) AS turns, arg_max(sender, turn) AS last_from FROM {MESSAGES} GROUP BY 1""")
def session_summary(s, d):
    return logs.session_summary(fx.messages(s, d))


@query(f"SELECT session_id, string_agg(sender || ': ' || content, chr(10) ORDER BY turn) AS transcript FROM {MESSAGES} WHERE session_id = 3 GROUP BY 1")
def session_detail(s, d):
    return logs.session_detail(fx.messages(s, d), 3)


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS agent_id, ts, online FROM (SELECT *, event_type <> 'error' AS online, lag(event_type <> 'error', 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE online <> before""")
def status_transitions(s, d):
    return logs.transitions(fx.pings(s, d))


@query("""SELECT CAST(user_id AS VARCHAR) AS agent_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS tool_name, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) < 30000000 AS working FROM events GROUP BY 1""")
def last_activity(s, d):
    return logs.last_activity(fx.tool_log(s, d), EVENTS_AS_OF)


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS agent_id, event_type AS tool_name, ts AS timestamp, CAST(rn AS INTEGER) AS rn FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def recent_runs(s, d):
    return logs.recent_per_key(fx.tool_log(s, d), "agent_id", [F.desc("timestamp"), F.desc("event_id")], 3)


@query(f"""SELECT session_id, turn, sender AS "from", content, time FROM {MESSAGES} WHERE contains(lower(content || sender), 'the') ORDER BY time DESC, session_id DESC, turn DESC LIMIT 20 OFFSET 5""")
def chat_search(s, d):
    return logs.chat_search(fx.messages(s, d), "The", 5, 20)


@query(f"""SELECT session_id, turn, sender AS "from", content, time, key FROM (SELECT *, md5(sender || '|' || substr(content, 1, 80)) AS key, row_number() OVER (PARTITION BY md5(sender || '|' || substr(content, 1, 80)) ORDER BY session_id, turn) AS rn FROM {MESSAGES}) WHERE rn = 1""")
def message_dedup(s, d):
    return logs.message_dedup(fx.messages(s, d), ["session_id", "turn"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, count(event_id) AS n FROM supplier LEFT JOIN events ON user_id = s_suppkey GROUP BY 1")
def roster_left(s, d):
    roster = fx.users(s, d).select(F.col("id").cast("string").alias("key"))
    return logs.with_roster(logs.tool_stats(fx.tool_log(s, d)).filter("dim = 'agent'").select("key", "n"), roster, "key")


@query(f"""SELECT n.id, importance, title, created_at, p.name AS project, u.full_name AS reporter FROM (SELECT * FROM {NC} ORDER BY created_at DESC, id DESC LIMIT 50) n
LEFT JOIN {PROJECTS} p ON p.id = n.project_id LEFT JOIN {USERS} u ON u.id = n.reporter_id""")
def nc_recent(s, d):
    return reports.nc_recent(fx.nc_reports(s, d), fx.projects(s, d), fx.users(s, d))


AGED = f"(SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(created_at)) / 86400000000) AS INTEGER) AS age FROM {NC} WHERE done IS NULL)"


@query(f"""SELECT n.id, importance, title, p.name AS project, u.full_name AS reporter, am.username AS manager_username, am.full_name AS manager, strftime(n.created_at + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS created_local, age - {LIMIT} AS overdue
FROM {AGED} n LEFT JOIN {PROJECTS} p ON p.id = n.project_id LEFT JOIN {USERS} u ON u.id = n.reporter_id LEFT JOIN {USERS} am ON am.id = n.manager_id
WHERE age > {LIMIT} AND p.status NOT IN ('completed')""")
def nc_overdue(s, d):
    return reports.nc_overdue(fx.nc_reports(s, d), fx.projects(s, d), fx.users(s, d), ORDERS_AS_OF)


@query(f"""SELECT importance, count(*) FILTER (WHERE done IS NULL) AS total_open, count(*) FILTER (WHERE done IS NULL AND p.delivery_date BETWEEN DATE '2001-08-01' AND DATE '2001-08-01' + INTERVAL 30 DAY AND p.status NOT IN ('완료', '취소', 'completed', 'cancelled')) AS delivery_risk, count(*) FILTER (WHERE done IS NOT NULL AND updated_at >= date_trunc('week', TIMESTAMP '2001-08-01')) AS closed_this_week
FROM {NC} n LEFT JOIN {PROJECTS} p ON p.id = n.project_id GROUP BY 1""")
def nc_weekly_summary(s, d):
    return reports.nc_weekly_summary(fx.nc_reports(s, d), fx.projects(s, d), "2001-08-01 00:00:00")


@query(f"SELECT n.project_id, p.name AS project, manager_id, importance, count(*) AS n, count(*) FILTER (age >= 7) AS over_7, count(*) FILTER (age >= 100) AS over_100, max(age) AS oldest, count(*) FILTER (manager_id IS NULL) AS without_manager FROM {AGED} n LEFT JOIN {PROJECTS} p ON p.id = n.project_id GROUP BY ALL")
def nc_ageing(s, d):
    return reports.nc_ageing(fx.nc_reports(s, d), fx.projects(s, d), ORDERS_AS_OF)


@query(f"SELECT id, importance, created_at FROM {NC} WHERE created_at >= TIMESTAMP '2001-07-29 15:00:00'")
def new_this_week(s, d):
    return reports.nc_new(fx.nc_reports(s, d), "2001-08-01 00:00:00", "Asia/Seoul").select("id", "importance", "created_at")


@query(f"SELECT p.id, p.name, delivery_date, progress, count(n.id) AS nc_count FROM {PROJECTS} p LEFT JOIN {NC} n ON n.project_id = p.id WHERE p.status = 'active' GROUP BY ALL")
def project_overview(s, d):
    return reports.project_overview(fx.projects(s, d), fx.nc_reports(s, d))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') ORDER BY p_partkey DESC LIMIT 50")
def keyword_filter(s, d):
    rows = fx.table(s, d, "part")
    return reports.keyword_search(rows, T.keyword_match(["p_name", "p_brand"], "RING"), [F.desc("p_partkey")], 50).select("p_partkey", "p_name")


@query(f"SELECT id, name FROM {PROJECTS} WHERE status = 'active'")
def status_filter(s, d):
    return reports.with_status(fx.projects(s, d), "active").select("id", "name")


@query(f"SELECT id, importance FROM {NC} ORDER BY created_at DESC NULLS LAST, id LIMIT 50")
def topk_recent(s, d):
    return reports.newest(fx.nc_reports(s, d), "created_at", "id", 50).select("id", "importance")


@query(f"SELECT id, importance FROM {NC} ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def page(s, d):
    return reports.page(fx.nc_reports(s, d), [F.desc("created_at"), F.asc("id")], 40, 20)[0].select("id", "importance")


@query("SELECT DISTINCT o_orderstatus FROM orders")
def distinct_status(s, d):
    return reports.distinct_values(fx.table(s, d, "orders"), "o_orderstatus")


@query(f"SELECT path, first_value(path) OVER w AS kept_path, row_number() OVER w > 1 AS duplicate FROM {FILES} WINDOW w AS (PARTITION BY hash ORDER BY category, path)")
def exact_dedup(s, d):
    return corpus.dedup_exact(fx.files(s, d))


@query(f"SELECT path, hash FROM (SELECT path, hash, row_number() OVER (PARTITION BY hash ORDER BY CASE WHEN ext = '.pdf' THEN 0 ELSE 1 END, category, path) AS rn FROM {FILES}) WHERE rn = 1")
def ranked_dedup(s, d):
    return corpus.dedup_ranked(fx.files(s, d))


@query(f"""SELECT path, category, stem, ext FROM (SELECT *, bool_or(ext = '.pdf') OVER g AND bool_or(ext = '.docx') OVER g AS both_kinds, row_number() OVER (PARTITION BY category, stem ORDER BY size DESC, path) AS rn FROM {FILES} WINDOW g AS (PARTITION BY category, stem))
WHERE (both_kinds AND ext = '.pdf') OR (NOT both_kinds AND rn = 1)""")
def pair_dedup(s, d):
    files = fx.files(s, d).withColumn("stem", (F.col("doc_id") % 10).cast("string"))
    return corpus.dedup_pairs(files)


ORACLE["pair_dedup"] = ORACLE["pair_dedup"].replace("FROM " + FILES, "FROM " + FILES.replace("doc_id % 100", "doc_id % 10"))


@query("SELECT count(DISTINCT label) AS sources, count(DISTINCT CASE WHEN embedding IS NOT NULL THEN label END) AS embedded, count(*) AS n_rows FROM embeddings")
def corpus_stats(s, d):
    return corpus.corpus_stats(fx.table(s, d, "embeddings"), "label", F.col("embedding").isNotNull())


@query(f"SELECT coalesce(nullif(trim(category), ''), 'unknown') AS category, count(DISTINCT path) AS files, count(*) AS chunks FROM {FILES} GROUP BY 1 UNION ALL SELECT 'total', count(DISTINCT path), count(*) FROM {FILES}")
def embed_progress(s, d):
    return corpus.embed_progress(fx.files(s, d))


@query("SELECT 'lang' AS dim, lang AS key, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'category', source, count(*) FROM documents GROUP BY 2")
def filter_report(s, d):
    return corpus.filter_report(fx.files(s, d))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 900 + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 900) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(s, d):
    return corpus.chunk_fixed(fx.table(s, d, "documents").select("doc_id", "text"), 1000, 100)


@query(f"SELECT path, hash FROM {FILES} WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0")
def changed_files(s, d):
    files = fx.files(s, d).select("path", "hash", "doc_id")
    known = files.filter("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return corpus.changed(files, known, "path").select("path", "hash")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def incremental_anti(s, d):
    return corpus.pending(fx.table(s, d, "documents").select("doc_id"), fx.table(s, d, "labels"), ["doc_id"])


@query("""WITH t AS (SELECT l_orderkey AS source_file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS chunk_index FROM lineitem),
n AS (SELECT * FROM t WHERE source_file % 5 = 0 AND chunk_index <= 2)
SELECT source_file, chunk_index, 'old' AS version FROM t ANTI JOIN n USING (source_file, chunk_index) WHERE NOT (source_file % 5 = 0 AND chunk_index > (SELECT max(chunk_index) FROM n WHERE n.source_file = t.source_file)) UNION ALL SELECT source_file, chunk_index, 'new' FROM n""")
def upsert_chunks(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    t = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_file"), F.row_number().over(w).cast("long").alias("chunk_index"), F.lit("old").alias("version"))
    return corpus.upsert_chunks(t, t.filter("source_file % 5 = 0 and chunk_index <= 2").withColumn("version", F.lit("new")))


@query("SELECT o_orderkey AS source_file, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE 'old' END AS version FROM orders")
def replace_source(s, d):
    t = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("source_file"), F.lit("old").alias("version"))
    return corpus.replace_sources(t, t.filter("source_file % 7 = 0").withColumn("version", F.lit("new")))


@query("""SELECT o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def progress_counts(s, d):
    return corpus.progress_counts(fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status")), ["O", "F", "P"])


def _types_sql() -> str:
    return " UNION ALL ".join(f"SELECT item, '{v}' AS t FROM {PURCHASES} WHERE contains(lower(project_name), '{k}')" for k, v in RULES.items())


@query(f"SELECT item, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT DISTINCT item, t FROM ({_types_sql()})) GROUP BY 1")
def keyword_labels(s, d):
    return erp.equipment_types(fx.purchases(s, d), RULES).select("item", F.array_join("types", ",").alias("types"))


@query(f"""SELECT i.item, n_purchases, coalesce(types, '') AS types, types IS NULL AS excluded FROM (SELECT item, count(*) AS n_purchases FROM {PURCHASES} GROUP BY 1) i
LEFT JOIN (SELECT item, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT DISTINCT item, t FROM ({_types_sql()}) WHERE t <> 'steel line') GROUP BY 1) t USING (item)""")
def item_exclusions(s, d):
    return erp.classify_items(fx.purchases(s, d), RULES, {"steel line"})


SUPPLIED = "(SELECT l_suppkey AS item, p_name AS project_name, CAST(l_shipdate AS DATE) AS order_date FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _supplied(s, d):
    part = fx.table(s, d, "part").select("p_partkey", "p_name")
    return fx.table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("item"), F.col("p_name").alias("project_name"), F.col("l_shipdate").cast("date").alias("order_date"))


@query(f"""SELECT item, last_project, CASE WHEN contains(last_project, 'ring') THEN coalesce(other, last_project) ELSE last_project END AS project FROM (
SELECT item, arg_max(project_name, (order_date, project_name)) AS last_project, arg_max(project_name, (order_date, project_name)) FILTER (NOT contains(project_name, 'ring') AND order_date >= DATE '1998-09-01') AS other FROM {SUPPLIED} GROUP BY 1)""")
def substitute_project(s, d):
    return erp.substitute(_supplied(s, d), "2001-09-01", "ring")


@query(f"""SELECT item FROM (SELECT item, contains(arg_max(project_name, (order_date, project_name)), 'ring') AS last_cs, count(*) FILTER (NOT contains(project_name, 'ring') AND order_date >= DATE '1998-09-01') AS others FROM {PURCHASES} GROUP BY 1) WHERE last_cs AND others = 0""")
def cs_only_items(s, d):
    return erp.cs_only(fx.purchases(s, d), "2001-09-01", "ring")


@query(f"SELECT item FROM {PURCHASES} WHERE order_date >= DATE '1998-09-01' GROUP BY 1 HAVING bool_and(contains(project_name, 'ring'))")
def dedicated_items(s, d):
    return erp.dedicated(fx.purchases(s, d), "ring", "2001-09-01")


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"


@query(f"SELECT vec_id, round(sim, 4) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}) AS sim FROM embeddings WHERE embedding IS NOT NULL) ORDER BY sim DESC, vec_id LIMIT 20")
def vector_topk(s, d):
    return retrieval.vector_search(fx.table(s, d, "embeddings"), QUERY_VECTOR, 20)


@query(f"""WITH h AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 4) AS s, row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 4) DESC, vec_id) AS rn FROM embeddings)
SELECT CAST(label AS VARCHAR) AS source, string_agg(printf('[%d] %d %.4f', rn, vec_id, s), chr(10) ORDER BY rn) AS context FROM h WHERE rn <= 5 AND s >= 0.05 GROUP BY 1""")
def rag_context(s, d):
    sim = F.round(T.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in QUERY_VECTOR])), 4)
    hits = fx.table(s, d, "embeddings").select(F.col("label").cast("string").alias("source"), "vec_id", sim.alias("similarity"))
    return retrieval.build_context(hits, 0.05, 5)


@query("""WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS agent, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), f(agent, n, twentieths) AS (
  SELECT DISTINCT agent, CAST(0 AS BIGINT), 10 FROM e
  UNION ALL SELECT f.agent, e.n, CASE WHEN good THEN least(20, twentieths + 1) ELSE greatest(0, twentieths - 3) END FROM f JOIN e ON e.agent = f.agent AND e.n = f.n + 1
)
SELECT f.agent, round(arg_max(twentieths, f.n) / 20.0, 4) AS score, max(g) AS good_count, max(b) AS bad_count
FROM f JOIN (SELECT agent, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b FROM e GROUP BY agent) t ON t.agent = f.agent GROUP BY 1""")
def feedback_fold(s, d):
    e = fx.response_times(s, d).select("agent", "ts", "event_id", "channel")
    return feedback.feedback_fold(e, "agent", F.col("channel") != "error", ["ts", "event_id"])


@query("""WITH RECURSIVE e AS (
  SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN NULL ELSE 'good' END AS rating, ts, event_id FROM events
), r AS (SELECT id, rating, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM e WHERE rating IS NOT NULL),
c AS (SELECT s_suppkey AS id, s_suppkey % 21 AS twentieths, CAST(s_suppkey % 3 AS BIGINT) AS good_count, CAST(0 AS BIGINT) AS bad_count FROM supplier),
f(id, n, twentieths) AS (
  SELECT id, CAST(0 AS BIGINT), twentieths FROM c
  UNION ALL SELECT f.id, r.n, CASE rating WHEN 'good' THEN least(20, twentieths + 1) ELSE greatest(0, twentieths - 3) END FROM f JOIN r ON r.id = f.id AND r.n = f.n + 1
)
SELECT c.id, round(arg_max(f.twentieths, f.n) / 20.0, 4) AS score,
 any_value(c.good_count) + (SELECT count(*) FROM r WHERE r.id = c.id AND rating = 'good') AS good_count, any_value(c.bad_count) + (SELECT count(*) FROM r WHERE r.id = c.id AND rating = 'bad') AS bad_count
FROM c JOIN f ON f.id = c.id GROUP BY c.id""")
def apply_feedback(s, d):
    rating = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") != "view", "good")
    events = fx.table(s, d, "events").select(F.col("user_id").cast("long").alias("id"), rating.alias("rating"), "ts", "event_id")
    n = F.col("s_suppkey").cast("long")
    cache = fx.table(s, d, "supplier").select(n.alias("id"), (n % 21 / 20).alias("score"), (n % 3).alias("good_count"), F.lit(0).cast("long").alias("bad_count"))
    return feedback.apply_feedback(cache, events, "rating", ["ts", "event_id"]).withColumn("score", F.round("score", 4))


RELS = "(SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'placed' AS type FROM orders)"


def _rels(s, d):
    return fx.table(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("placed").alias("type"))


@query(f"SELECT src, dst, type, count(*) AS n FROM (SELECT src, dst, type FROM {RELS} UNION ALL SELECT dst, src, type FROM {RELS}) WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1, 2, 3")
def graph_expand(s, d):
    seeds = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return retrieval.expand(_rels(s, d), seeds)


@query(f"""WITH n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT src, dst, type FROM {RELS} WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def induced_rels(s, d):
    a = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    b = fx.table(s, d, "orders").filter("o_orderstatus = 'O'").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return retrieval.induced(_rels(s, d), a.unionByName(b))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS len, CAST(len(list_filter(w, lambda x: x = 'the')) AS DOUBLE) AS tf0, CAST(len(list_filter(w, lambda x: x = 'that')) AS DOUBLE) AS tf1 FROM t),
s AS (SELECT count(*) AS n, avg(len) AS avg_len, count(*) FILTER (tf0 > 0) AS df0, count(*) FILTER (tf1 > 0) AS df1 FROM f),
r AS (SELECT doc_id, ln((n - df0 + 0.5) / (df0 + 0.5) + 1) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / avg_len)) + ln((n - df1 + 0.5) / (df1 + 0.5) + 1) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s FROM f, s)
SELECT doc_id, round(s, 4) AS score FROM r WHERE s > 0 ORDER BY round(s, 6) DESC, doc_id LIMIT 50""")
def bm25(s, d):
    return retrieval.bm25(fx.table(s, d, "documents"), ["the", "that"], 50)


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders)
SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1""")
def rrf(s, d):
    from pyspark.sql import Window as W

    def ranked(col):
        top = fx.table(s, d, "orders").orderBy(F.desc(col), "o_orderkey").limit(100)  # the fused lists are top-100 reports
        return top.select(F.col("o_orderkey").alias("id"), F.row_number().over(W.orderBy(F.desc(col), "o_orderkey")).alias("rank"))

    return retrieval.rrf([ranked("o_totalprice"), ranked("o_orderdate")], "id")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM pages""")
def strip_html(s, d):
    return fx.table(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""SELECT doc_id, CASE WHEN jp > 50 AND jp > ko THEN 'JP' WHEN ko > 50 THEN 'KO' WHEN en > 100 AND ko < 10 THEN 'EN' ELSE 'KO' END AS language FROM
(SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS en, len(regexp_extract_all(text, '[가-힣]')) AS ko, len(regexp_extract_all(text, '[぀-ヿ]')) AS jp FROM documents)""")
def detect_language(s, d):
    return fx.table(s, d, "documents").select("doc_id", T.language_by_script(F.col("text")).alias("language"))


@query("""SELECT l_orderkey, CASE WHEN l_extendedprice > 0 THEN round((l_extendedprice - l_quantity * 900) / l_extendedprice * 100, 2) + 0.0 END AS margin FROM lineitem""")
def margin_pct(s, d):
    return fx.table(s, d, "lineitem").select("l_orderkey", T.margin_pct(F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double") * 900).alias("margin"))


@query("""SELECT page_id, CASE WHEN s = '' THEN substr(md5(url), 1, 12) ELSE s END AS name FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS s FROM pages)""")
def safe_name(s, d):
    return fx.table(s, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""SELECT url, array_to_string(list_transform(regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(CAST(length(coalesce(nullif(ltrim(x, '0'), ''), '0')) AS VARCHAR), 4, '0') || coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE x END), '') AS key FROM pages""")
def natural_sort(s, d):
    return fx.table(s, d, "pages").select("url", T.natural_key(F.col("url")).alias("key"))
