"""Registered queries of curation: the funnel, figures, metadata and sheets, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from floorops.functions import figures as G
from floorops.operators import curation, metadata, sheets
from floorops.plans import fixtures as fx
from floorops.plans.queries import FILES, query

NAMED = f"(SELECT *, stem || CASE WHEN doc_id % 13 = 0 THEN '_COPY' ELSE '' END || ext AS name FROM {FILES})"


def _named(s, d):
    copy = F.when(F.col("doc_id") % 13 == 0, "_COPY").otherwise("")
    return fx.files(s, d).withColumn("name", F.concat("stem", copy, "ext"))


@query(f"""WITH a AS (SELECT * FROM {NAMED}),
drafts AS (SELECT * FROM a WHERE contains(lower(name), 'copy')),
b AS (SELECT * FROM a WHERE NOT contains(lower(name), 'copy')),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ext <> '.pdf', category, path) = 1),
g AS (SELECT category, stem, bool_or(ext = '.pdf') AND bool_or(ext = '.docx') AS pair FROM c GROUP BY ALL),
d AS (SELECT c.*, pair, row_number() OVER (PARTITION BY c.category, c.stem ORDER BY size DESC, path) AS n FROM c JOIN g ON c.category = g.category AND c.stem = g.stem),
e AS (SELECT * FROM d WHERE CASE WHEN pair THEN ext = '.pdf' ELSE n = 1 END)
SELECT 'input' AS dim, 'all' AS key, count(*) AS n FROM a
UNION ALL SELECT 'removed', 'draft', count(*) FROM drafts HAVING count(*) > 0
UNION ALL SELECT 'removed', 'hash_duplicate', (SELECT count(*) FROM b) - count(*) FROM c HAVING (SELECT count(*) FROM b) > count(*)
UNION ALL SELECT 'removed', 'docx_pdf_pair', count(*) FROM d WHERE pair AND ext <> '.pdf' HAVING count(*) > 0
UNION ALL SELECT 'removed', 'same_stem_duplicate', count(*) FROM d WHERE NOT pair AND n > 1 HAVING count(*) > 0
UNION ALL SELECT 'output', 'all', count(*) FROM e
UNION ALL SELECT 'lang', lang, count(*) FROM e GROUP BY lang
UNION ALL SELECT 'category', category, count(*) FROM e GROUP BY category""")
def filter_funnel(s, d):
    return curation.funnel_report(curation.funnel(_named(s, d)))


@query()
def corpus_sketch(s, d):
    """Distinct orders of line items, from sketches of days."""
    rows = fx.table(s, d, "lineitem")
    return curation.sketched_stats(curation.corpus_sketches(rows, "l_orderkey", F.col("l_returnflag") == "R", F.to_date("l_shipdate")))


@query(r"""WITH p AS (
  SELECT page_id, 0 AS pos, CASE WHEN page_id % 5 = 0 THEN 'data:image/gif;base64,AA' ELSE 'img/' || page_id || '.JPG' END AS src,
    '그림 ' || (page_id % 9 + 1) || '.' || (page_id % 4) || ' ring & bolt ' || chr(CAST(65 + page_id % 26 AS INTEGER)) AS caption FROM pages
  UNION ALL SELECT page_id, 1, url, 'placeholder ' || chr(44032) FROM pages WHERE page_id % 3 = 0
)
SELECT page_id, pos, src, caption,
  CASE WHEN src LIKE 'data:%' AND length(src) < 200 THEN '이미지 데이터 너무 작음' WHEN pos = 1 THEN '플레이스홀더' END AS issue,
  CASE WHEN src LIKE 'data:image/gif%' THEN '.gif' ELSE coalesce(nullif(lower(regexp_extract(regexp_extract(src, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)), ''), '.png') END AS extension,
  CASE pos WHEN 0 THEN '001_그림_' || (page_id % 9 + 1) || '-' || (page_id % 4) || '_ring_&_bolt_' || chr(CAST(65 + page_id % 26 AS INTEGER)) || CASE WHEN page_id % 5 = 0 THEN '.gif' ELSE '.jpg' END
    ELSE '002_placeholder_' || chr(44032) || coalesce(nullif(lower(regexp_extract(regexp_extract(src, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1)), ''), '.png') END AS file_name
FROM p""")
def figure_catalog(s, d):
    """One numbered figure for each page, and for every third a placeholder, with references in their captions."""
    i = F.col("page_id")
    first = F.concat(F.lit("그림 "), i % 9 + 1, F.lit("."), i % 4, F.lit(" ring &amp; bolt &#"), 65 + i % 26, F.lit("; "))
    src = F.when(i % 5 == 0, "data:image/gif;base64,AA").otherwise(F.concat(F.lit("img/"), i, F.lit(".JPG")))

    def figure(source, caption):
        return F.concat(F.lit('<div class="figure" id="f"><p>'), F.substring("html", 1, 0), F.lit('</p><img alt="" src="'), source, F.lit('"/><div class="figure-caption">'), caption, F.lit("</div></div>\n"))

    html = F.concat(figure(src, first), F.when(i % 3 == 0, figure(F.col("url"), F.lit("&lt;i&gt;placeholder&lt;/i&gt; &#xAC00;"))).otherwise(""))
    return fx.table(s, d, "pages").select("page_id", F.posexplode(G.figure_blocks(html)).alias("pos", "f")).select("page_id", "pos", "f.*")


# Words of the parts' names and types, in an order in which both dictionaries have words that hide others.
MAKERS, KINDS = {"small ring": "SmallRing", "ring": "RingWorks", "steel": "SteelCo", "small": "Smallco"}, {"brushed": "UserManual", "large": "Catalog", "red": "Datasheet", "blue": "WiringGuide"}


def _first(words: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in words.items()) + f" ELSE '{default}' END"


@query(f"""WITH x AS (
  SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'IRB-' || p_partkey WHEN 1 THEN 'PDF' ELSE 'ab1' END || ' ' || p_name || '.pdf' AS name,
    repeat('가', CAST(p_partkey % 12 AS INTEGER)) || ' ' || repeat(p_type || ' ', CAST(p_partkey % 20 AS INTEGER)) AS one FROM part
), y AS (SELECT *, lower(regexp_replace(name, '\\.pdf$', '') || ' ' || one || chr(10)) AS t FROM x),
z AS (SELECT p_partkey, {_first(MAKERS, 'Unknown')} AS manufacturer, CASE WHEN p_partkey % 3 = 0 THEN 'IRB-' || p_partkey ELSE 'Unknown' END AS model, {_first(KINDS, 'Manual')} AS doc_type,
  CASE WHEN p_partkey % 12 < 10 AND len(regexp_extract_all(one, '[a-zA-Z]')) > 100 THEN 'EN' ELSE 'KO' END AS language FROM y)
SELECT *, manufacturer || '_' || model || '_' || doc_type || '_' || language || '.pdf' AS standardized_name FROM z""")
def manual_metadata(s, d):
    """Parts as manuals: a name and a first page; the page after the third is not looked at."""
    part, i = fx.table(s, d, "part"), F.col("p_partkey")
    start = F.when(i % 3 == 0, F.concat(F.lit("IRB-"), i)).when(i % 3 == 1, "PDF").otherwise("ab1")
    files = part.select(i.alias("doc"), F.concat(start, F.lit(" "), "p_name", F.lit(".pdf")).alias("name"))
    one = F.concat(F.repeat(F.lit("가"), (i % 12).cast("int")), F.lit(" "), F.repeat(F.concat("p_type", F.lit(" ")), (i % 20).cast("int")))
    pages = part.select(i.alias("doc"), F.explode(F.array(F.struct(F.lit(1).alias("page"), one.alias("text")), F.struct(F.lit(4).alias("page"), F.lit("small ring brushed").alias("text")))).alias("p")).select("doc", "p.*")
    got = metadata.manual_metadata(files, pages, metadata.dictionary(s, MAKERS), metadata.dictionary(s, KINDS))
    return got.select(F.col("doc").alias("p_partkey"), "manufacturer", "model", "doc_type", "language", "standardized_name")


def _sheets_sql(size: int, step: int) -> str:
    return f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority AS line FROM orders),
t AS (SELECT o_custkey, '## ' || o_custkey AS head, string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM r GROUP BY 1),
w AS (SELECT o_custkey, head, text, length(head) + length(text) + 1 > {size} AS apart, unnest(CASE WHEN length(text) <= {size} THEN [0] ELSE range(0, length(text), {step}) END) AS a FROM t)
SELECT o_custkey, CAST(CASE WHEN apart THEN 1 + CAST(a / {step} AS INTEGER) ELSE 0 END AS INTEGER) AS chunk_index, CASE WHEN apart THEN substr(text, CAST(a + 1 AS BIGINT), {size}) ELSE head || chr(10) || chr(10) || text END AS content FROM w
UNION ALL SELECT o_custkey, 0, head FROM t WHERE length(head) + length(text) + 1 > {size}"""


def _orders(s, d):
    return fx.table(s, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"]


@query(_sheets_sql(1000, 900))
def chunk_sheet(s, d):
    return sheets.chunk_sheets(*_orders(s, d))


@query(_sheets_sql(200, 170))
def chunk_sheet_small(s, d):
    """Chunks so small that most sheets are cut."""
    return sheets.chunk_sheets(*_orders(s, d), 200, 30)
