"""Queries over tasks, usage, CS records, look-ups, corpora and graphs, with SQL where it gives the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorops.operators import answers, neighbours, records, reports, retrieval
from floorops.plans import fixtures as fx
from floorops.plans.document_queries import POINTS
from floorops.plans.queries import EVENTS_AS_OF, QUERY_VECTOR, VEC, query
from floorops.plans.registry import QueryRegistry

# orders as tasks
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'in_progress' END"
TASKS = f"""(SELECT o_orderkey AS task_id, 'a' || o_custkey % 20 AS agent, o_orderpriority AS name, {STATUS} AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at,
CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS completed_at, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END AS updated_at FROM orders)"""


def _tasks(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    at = F.col("o_orderdate").cast("timestamp")
    return fx.table(s, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.concat(F.lit("a"), (F.col("o_custkey") % 20).cast("string")).alias("agent"), F.col("o_orderpriority").alias("name"), status.alias("status"), at.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", at).alias("completed_at"), F.when(F.col("o_orderkey") % 3 == 0, F.timestamp_add("DAY", F.lit(1), at)).alias("updated_at"),
    )


def _messages(s, d):
    kind = F.when(F.col("l_returnflag") == "A", "complete").when(F.col("l_returnflag") == "R", "blocked").when(F.col("l_linenumber") % 2 == 0, "progress").otherwise("request")
    no = (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("id")
    return fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("time"), no, kind.alias("kind"))


@query(f"""WITH m AS (SELECT l_orderkey AS task_id, l_shipdate AS time, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'R' THEN 'blocked' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'progress' ELSE 'request' END END AS kind FROM lineitem),
r AS (SELECT task_id, CASE arg_max(kind, (time, id)) WHEN 'complete' THEN 'done' WHEN 'progress' THEN 'in_progress' ELSE 'blocked' END AS status, max(time) AS time FROM m WHERE kind <> 'request' GROUP BY 1)
SELECT task_id, coalesce(r.status, t.status) AS status, CASE WHEN r.status = 'done' THEN r.time ELSE completed_at END AS completed_at FROM {TASKS} t LEFT JOIN r USING (task_id)
UNION ALL SELECT task_id, coalesce(r.status, 'pending'), CASE WHEN r.status = 'done' THEN r.time END FROM (SELECT DISTINCT task_id FROM m WHERE kind = 'request') q LEFT JOIN r USING (task_id) WHERE task_id NOT IN (SELECT o_orderkey FROM orders)""")
def task_fold(s, d):
    return records.fold_tasks(_tasks(s, d).select("task_id", "status", "completed_at"), _messages(s, d))


# the same fold under an older name
@query(f"""WITH m AS (SELECT l_orderkey AS task_id, l_shipdate AS time, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'complete' WHEN 'R' THEN 'blocked' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'progress' ELSE 'request' END END AS kind FROM lineitem),
r AS (SELECT task_id, CASE arg_max(kind, (time, id)) WHEN 'complete' THEN 'done' WHEN 'progress' THEN 'in_progress' ELSE 'blocked' END AS status, max(time) AS time FROM m WHERE kind <> 'request' GROUP BY 1)
SELECT task_id, coalesce(r.status, t.status) AS status, CASE WHEN r.status = 'done' THEN r.time ELSE completed_at END AS completed_at FROM {TASKS} t LEFT JOIN r USING (task_id)
UNION ALL SELECT task_id, coalesce(r.status, 'pending'), CASE WHEN r.status = 'done' THEN r.time END FROM (SELECT DISTINCT task_id FROM m WHERE kind = 'request') q LEFT JOIN r USING (task_id) WHERE task_id NOT IN (SELECT o_orderkey FROM orders)""")
def task_fold_all(s, d):
    return records.fold_tasks(_tasks(s, d).select("task_id", "status", "completed_at"), _messages(s, d))


@query(f"""SELECT task_id, CAST(floor((epoch_us(TIMESTAMP '1998-01-01') - epoch_us(coalesce(updated_at, created_at))) / 3600000000) AS BIGINT) AS idle_hours FROM {TASKS}
WHERE status = 'in_progress' AND epoch_us(TIMESTAMP '1998-01-01') - epoch_us(coalesce(updated_at, created_at)) > 900000000""")
def stalled_tasks(s, d):
    return records.stalled(_tasks(s, d), "1998-01-01 00:00:00").select("task_id", "idle_hours")


@query(f"""SELECT agent, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status <> 'done') AS active, count(*) AS total FROM {TASKS} GROUP BY 1""")
def task_status(s, d):
    return records.task_status(_tasks(s, d))


@query(f"SELECT task_id, agent, name FROM (SELECT *, row_number() OVER (PARTITION BY agent, substr(name, 1, 40) ORDER BY task_id) AS rn FROM {TASKS} WHERE status = 'pending') WHERE rn > 1")
def task_duplicates(s, d):
    return records.duplicate_tasks(_tasks(s, d))


DONE = f"(SELECT *, row_number() OVER (PARTITION BY agent ORDER BY name, task_id) AS rn FROM (SELECT agent, o.task_id, name FROM {TASKS} o WHERE status = 'done'))"


@query(f"SELECT agent, count(*) AS n, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 5) AS names, greatest(count(*) - 5, 0) AS more FROM {DONE} GROUP BY 1")
def done_by_agent(s, d):
    return records.done_by_agent(_tasks(s, d).withColumn("completed_at", F.when(F.col("status") == "done", F.lit("1998-01-01").cast("timestamp"))), "1998-01-01")


# lineitem as usage records, several for each request
USAGE = "(SELECT l_orderkey AS request_id, CAST(l_quantity AS BIGINT) AS output_tokens, CAST(l_partkey AS BIGINT) AS input_tokens, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + CAST(round(l_extendedprice) AS BIGINT) % 1000 AS no FROM lineitem)"
ONCE = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY output_tokens DESC, no) AS rn FROM {USAGE}) WHERE rn = 1)"


def _usage(s, d):
    no = F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 1000 + F.round("l_extendedprice").cast("long") % 1000
    return fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_quantity").cast("long").alias("output_tokens"), F.col("l_partkey").alias("input_tokens"), F.col("l_shipdate").cast("timestamp").alias("ts"), no.alias("no"))


@query(f"SELECT request_id, output_tokens, input_tokens FROM {ONCE}")
def usage_dedup(s, d):
    return records.dedup_usage(_usage(s, d), "no").select("request_id", "output_tokens", "input_tokens")


@query(f"""SELECT CAST(coalesce(sum(input_tokens + output_tokens) FILTER (day = DATE '1998-03-04'), 0) AS BIGINT) AS day_tokens, round(coalesce(sum(input_tokens * 0.25 + output_tokens * 0.5) FILTER (day = DATE '1998-03-04'), 0), 4) AS day_cost,
CAST(coalesce(sum(input_tokens + output_tokens) FILTER (wk), 0) AS BIGINT) AS week_tokens, count(*) FILTER (wk) AS requests, round(coalesce(sum(input_tokens + output_tokens) FILTER (wk), 0) / 1000000.0, 4) AS share
FROM (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, CAST(ts + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '1998-03-02' AND DATE '1998-03-08' AS wk FROM {ONCE})""")
def token_usage(s, d):
    return records.token_usage(_usage(s, d), "1998-03-04 03:00:00", {"input": 0.25, "output": 0.5}, 1_000_000, "Asia/Seoul", "no")


@query("SELECT event_type AS channel_id, upper(event_type) AS channel_name, count(*) AS messages, CAST(sum(event_id % 3) AS BIGINT) AS attachments FROM events GROUP BY 1, 2")
def channel_summary(s, d):
    chat = fx.chat(s, d).select(F.col("channel").alias("channel_id"), F.upper("channel").alias("channel_name"), F.array_repeat(F.lit("f"), (F.col("event_id") % 3).cast("int")).alias("files"))
    return records.channel_summary(chat)


@query("""SELECT c_nationkey AS region, o_custkey % 10 AS handler, count(*) AS open, count(*) FILTER (DATE '1998-08-10' - CAST(o_orderdate AS DATE) > 30) AS over_30, CAST(max(DATE '1998-08-10' - CAST(o_orderdate AS DATE)) AS INTEGER) AS oldest
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""")
def cs_backlog(s, d):
    o = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    closed = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return records.cs_backlog(o.select(F.col("c_nationkey").alias("region"), (F.col("o_custkey") % 10).alias("handler"), F.to_date("o_orderdate").alias("received_at"), closed.alias("closed_at")), "1998-08-10")


@query("""SELECT o_orderkey AS quote_id, l_partkey AS item, CAST(o_orderdate AS DATE) AS quoted_on, l_extendedprice AS price, round((l_extendedprice - l_quantity * 900) / l_extendedprice * 100, 2) + 0.0 AS margin
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_extendedprice > 0""")
def price_history(s, d):
    quotes = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("quote_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("quoted_at"))
    items = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_partkey").alias("item"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 900).alias("cost"))
    return records.price_history(quotes, items)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def new_minus_seen(s, d):
    seen = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return records.new_only(fx.table(s, d, "orders").select("o_custkey"), seen, ["o_custkey"])


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 <> 0) AS ok, (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 <> 0) AS skipped, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 4 <> 0) * 2 AS items")
def quote_load_stats(s, d):
    new = fx.table(s, d, "orders").select("o_custkey", F.lit(2).alias("items"))
    return records.load_stats(new, new.filter("o_custkey % 4 = 0").select("o_custkey"), ["o_custkey"], "items")


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_nationkey = 3 THEN 'p' || c_custkey END, CASE WHEN starts_with(o_orderpriority, '1') THEN 'first' WHEN starts_with(o_orderpriority, '2') THEN 'second' WHEN o_orderpriority = '5-LOW' THEN 'low' END, 'desk') AS agent
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def route_channels(s, d):
    chat = fx.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("channel"))
    own = fx.table(s, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("project"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("agent"))
    return records.route_channels(chat, own, "project", [("1", "first"), ("2", "second")], {"5-LOW": "low"}, "desk").select("o_orderkey", "agent")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND length(text) > 40 THEN text ELSE substr(text, 1, 40) END AS answer FROM conversations WHERE text IS NOT NULL")
def answer_fallback(s, d):
    c = fx.table(s, d, "conversations").filter("text IS NOT NULL")
    return records.longer_answer(c.select("conv_id", "turn", F.substring("text", 1, 40).alias("answer")), c.filter("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def history_shipments(s, d):
    c = fx.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return records.lookup(fx.table(s, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "c_name")


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey")
def project_code_lookup(s, d):
    c = fx.table(s, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return records.lookup(fx.table(s, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "c_name", "")


@query("SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def project_schedule(s, d):
    c = fx.table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return reports.project_schedule(fx.table(s, d, "orders"), c, "o_custkey", F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN (SELECT * FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM lineitem) WHERE rn = 1) ON l_orderkey = o_orderkey")
def page_images(s, d):
    images = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_partkey").alias("id"))
    return records.lookup(fx.table(s, d, "orders").select("o_orderkey"), images, ["o_orderkey"], "l_partkey", order=["id"])


@query("""WITH item AS (SELECT 'f' || (p_size % 20) AS folder, p_partkey AS seq, p_name AS item FROM part),
listed AS (SELECT folder, item, count(*) OVER (PARTITION BY folder) AS n_items, row_number() OVER (PARTITION BY folder ORDER BY seq, item) AS idx FROM item),
named AS (SELECT c_custkey AS code, c_mktsegment AS equipment, a.folder FROM customer LEFT JOIN (VALUES ('BUILDING', 'f1'), ('MACHINERY', 'f2'), ('FURNITURE', 'f99')) a(segment, folder) ON segment = c_mktsegment)
SELECT code, equipment, n.folder, coalesce(n_items, 0) AS n_items, CAST(idx AS INTEGER) AS idx, item FROM named n LEFT JOIN listed l ON l.folder = n.folder""")
def checklist_join(s, d):
    alias = s.createDataFrame([("BUILDING", "f1"), ("MACHINERY", "f2"), ("FURNITURE", "f99")], "equipment string, folder string")
    items = fx.table(s, d, "part").select(F.concat(F.lit("f"), (F.col("p_size") % 20).cast("string")).alias("folder"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("item"))
    return reports.checklist_join(fx.table(s, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("equipment")), alias, items)


@query("SELECT p_type AS subject, min(p_partkey) AS first FROM part WHERE NOT contains(p_type, 'ring') GROUP BY 1")
def ordered_distinct(s, d):
    return records.ordered_distinct(fx.table(s, d, "part").withColumnRenamed("p_type", "subject"), "subject", "p_partkey", F.contains("subject", F.lit("ring")))


@query("SELECT 'done' AS rule, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01' UNION ALL SELECT 'poor', count(*) FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 'code', count(*) FROM orders WHERE starts_with(o_orderpriority, '5') UNION ALL SELECT 'kept', count(*) FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') AND NOT o_totalprice < 2000 AND NOT starts_with(o_orderpriority, '5')")
def purge(s, d):
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    kept, counts = records.purge(fx.table(s, d, "orders"), {"done": old, "poor": F.col("o_totalprice") < 2000, "code": F.col("o_orderpriority").startswith("5")})
    return counts.unionByName(kept.agg(F.lit("kept").alias("rule"), F.count("*").alias("n")).select("rule", "n"))


@query("SELECT corpus, count(*) AS n, count(lang) AS langs FROM (SELECT 'docs' AS corpus, lang FROM documents UNION ALL SELECT 'pages', NULL FROM pages) GROUP BY 1")
def union_corpora(s, d):
    both = records.union_tagged({"docs": fx.table(s, d, "documents").select("doc_id", "lang"), "pages": fx.table(s, d, "pages").select("page_id")})
    return both.groupBy("corpus").agg(F.count("*").alias("n"), F.count("lang").alias("langs"))


@query("SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def merge_graph(s, d):
    return records.merge_graph(fx.table(s, d, "orders").select(F.col("o_custkey").alias("id")), fx.table(s, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT label, count(*) AS n FROM (SELECT unnest(['Order', o_orderstatus]) AS label FROM orders) GROUP BY 1")
def label_counts(s, d):
    return records.label_counts(fx.table(s, d, "orders").select(F.array(F.lit("Order"), "o_orderstatus").alias("labels")))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_brand, 'ring') OR contains(p_type, 'ring') ORDER BY p_partkey LIMIT 50")
def graph_search(s, d):
    nodes = fx.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(*[x for c in ("p_name", "p_brand", "p_type") for x in (F.lit(c), F.col(c))]).alias("props"))
    return retrieval.node_search(nodes, "ring", 50).select(F.col("id").alias("p_partkey"))


@query("""WITH k AS (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '0001') OR contains(lower(c_name), '007') ORDER BY c_custkey LIMIT 20)
SELECT DISTINCT 'o' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM k)""")
def graph_keywords(s, d):
    nodes = fx.table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name")).withColumn("id", F.col("c_custkey"))
    seeds = retrieval.keyword_nodes(nodes, "0001, 007 x", 20).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
    rels = fx.table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("placed").alias("type"))
    return retrieval.expand(rels, seeds).select(F.col("dst").alias("id")).distinct()


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS agent FROM events WHERE event_type = 'click'")
def good_answers(s, d):
    return records.rated(fx.response_times(s, d), "channel", "click").select("event_id", "agent")


def _vectors(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


V = "(SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
KNN = f"""SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
(SELECT q.id AS query_id, c.id AS vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM {V} q, {V} c WHERE q.id % 20 = 0 {{}})"""


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM ({KNN.format('')}) WHERE rank <= 5")
def vector_knn_batch(s, d):
    v = _vectors(s, d)
    return neighbours.knn(v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), v, 5).select("query_id", "vec_id", "rank")


BEST = "SELECT CASE label % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS corpus, id, round(list_cosine_similarity(v, " + VEC + f"), 6) AS similarity FROM {V}"
MULTI = f"SELECT corpus, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY similarity DESC, id) AS rn FROM ({BEST})) WHERE rn <= 10"


def _corpora(s, d):
    v = _vectors(s, d)
    return {"even": v.filter("label % 2 = 0"), "odd": v.filter("label % 2 <> 0")}


@query(MULTI)
def multi_search(s, d):
    return neighbours.search_many(QUERY_VECTOR, _corpora(s, d), 10)


@query(f"SELECT * FROM ({MULTI}) ORDER BY similarity DESC, corpus, id LIMIT 10")
def hybrid_merge(s, d):
    return neighbours.hybrid_vector(QUERY_VECTOR, _corpora(s, d), 10)


@query(f"""SELECT query_id, vec_id, round(similarity, 4) AS similarity, similarity >= 0.3 AS hit, similarity >= 0.3 AND vec_id % 10 >= 5 AS usable FROM ({KNN.format('AND c.id % 20 <> 0')}) WHERE rank = 1""")
def answer_cache_lookup(s, d):
    v = _vectors(s, d)
    cache = v.filter("id % 20 <> 0").withColumn("score", F.when(F.col("id") % 10 >= 5, 0.8).otherwise(0.2))
    return neighbours.cache_lookup(v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), cache, 0.3)


@query(f"""WITH c AS (SELECT query_id, vec_id FROM ({KNN.format('AND c.id % 20 <> 0')}) WHERE rank = 1 AND similarity >= 0.35 AND vec_id % 10 >= 5),
part AS (SELECT query_id, 0 AS k, rank, '[CS이력] ' || substr(text, 1, 200) AS part FROM ({KNN.format('AND c.id % 3 = 1')}) JOIN documents ON doc_id = vec_id WHERE rank <= 3 AND text <> ''
UNION ALL SELECT query_id, 1, rank, '[매뉴얼] ' || substr(text, 1, 200) FROM ({KNN.format('AND c.id % 3 = 2')}) JOIN documents ON doc_id = vec_id WHERE rank <= 3 AND text <> ''),
p AS (SELECT query_id, string_agg(part, chr(10) ORDER BY k, rank) AS found FROM part GROUP BY 1),
a AS (SELECT q.id AS query_id, c.vec_id AS qa_id, found, CASE WHEN c.vec_id IS NOT NULL THEN 'cached 1. CS-' || c.vec_id ELSE coalesce(found, '관련 정보를 찾지 못했습니다.') END AS text
FROM {V} q LEFT JOIN c ON c.query_id = q.id LEFT JOIN p ON p.query_id = q.id WHERE q.id % 20 = 0)
SELECT query_id, qa_id, text AS answer, CASE WHEN qa_id IS NULL THEN 'rag' ELSE 'cache' END AS source, points / 100.0 AS score, qa_id IS NULL AND found IS NOT NULL AND points >= 40 AS saved FROM (SELECT *, {POINTS} AS points FROM a)""")
def answer_flow(s, d):
    v = _vectors(s, d).select("id", "embedding")
    text = fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    cache = v.filter("id % 20 <> 0").withColumns({"score": F.when(F.col("id") % 10 >= 5, 0.8).otherwise(0.2), "answer": F.concat(F.lit("cached 1. CS-"), F.col("id").cast("string"))})
    corpus = v.join(text, "id", "left")
    asked = corpus.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("question"), "embedding")
    return answers.answer_flow(asked, cache, corpus.filter("id % 3 = 1"), corpus.filter("id % 3 = 2"), 0.35).select("query_id", "qa_id", "answer", "source", "score", "saved")


@query(f"""WITH b AS (SELECT query_id, vec_id FROM ({KNN.format('AND c.id % 20 <> 0')}) WHERE rank = 1 AND similarity >= 0.3), l AS (SELECT vec_id, max(query_id) AS q FROM b GROUP BY 1)
SELECT id, CASE WHEN q IS NULL THEN 'old' ELSE 'new' || q END AS answer, CASE WHEN q IS NULL THEN 3 ELSE 0 END AS use_count FROM embeddings e JOIN (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 <> 0) c ON e.vec_id = c.id LEFT JOIN l ON l.vec_id = c.id
UNION ALL SELECT vec_id, 'new' || vec_id, 0 FROM embeddings WHERE vec_id % 20 = 0 AND vec_id NOT IN (SELECT query_id FROM b)""")
def answer_cache_save(s, d):
    v = _vectors(s, d).select("id", "embedding")
    cache = v.filter("id % 20 <> 0").withColumns({"answer": F.lit("old"), "score": F.lit(0.5), "use_count": F.lit(3)})
    new = v.filter("id % 20 = 0").withColumns({"answer": F.concat(F.lit("new"), F.col("id").cast("string")), "score": F.lit(0.7)})
    return neighbours.cache_save(cache, new, 0.3).select("id", "answer", "use_count")


@query("SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-31' AND value > 10 GROUP BY 1")
def query_registry(s, d):
    fx.table(s, d, "events").createOrReplaceTempView("floorops_events")
    registry = QueryRegistry(s)
    registry.register("by_type", "SELECT event_type, count(*) AS n FROM floorops_events WHERE ts < CAST(:as_of AS TIMESTAMP) AND value > :least GROUP BY event_type", "events above a value")
    return registry.run("by_type", as_of=EVENTS_AS_OF, least=10)
