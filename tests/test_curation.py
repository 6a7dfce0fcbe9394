import html

import pytest
from pyspark.sql import functions as F

from floorops.functions import figures as G
from floorops.operators import corpus, curation

FILES = "path string, category string, stem string, ext string, size long, hash string, name string, lang string"
ROWS = [
    ("a/1.pdf", "a", "1", ".pdf", 5, "h1", "1.pdf", "KO"),
    ("b/1.docx", "b", "1", ".docx", 5, "h1", "1.docx", "KO"),  # the PDF of the same content stays
    ("a/x_copy.pdf", "a", "x_copy", ".pdf", 9, "h2", "x_copy.pdf", "EN"),
    ("a/x.pdf", "a", "x", ".pdf", 9, "h2", "x.pdf", "EN"),  # its equal is a draft and gone before
    ("a/x.docx", "a", "x", ".docx", 99, "h3", "x.docx", "EN"),
    ("c/y.hwp", "c", "y", ".hwp", 3, "h4", "y.hwp", "EN"),
    ("c/y.txt", "c", "y", ".txt", 7, "h5", "y.txt", "EN"),
    ("c/z.txt", "c", "z", ".txt", 7, None, "z.txt", None),
    ("c/q.txt", "c", "q", ".txt", 7, None, None, None),
]


def test_funnel(spark, tmp_path):
    tagged = curation.funnel(spark.createDataFrame(ROWS, FILES))
    got = {r["path"]: r["removed_by"] for r in tagged.collect()}
    assert got == {"a/1.pdf": None, "b/1.docx": "hash_duplicate", "a/x_copy.pdf": "draft", "a/x.pdf": None, "a/x.docx": "docx_pdf_pair", "c/y.hwp": "same_stem_duplicate", "c/y.txt": None, "c/z.txt": None, "c/q.txt": None}
    lines = {(r["dim"], r["key"]): r["n"] for r in curation.funnel_report(tagged).collect()}
    assert lines == {("input", "all"): 9, ("output", "all"): 5, ("removed", "draft"): 1, ("removed", "hash_duplicate"): 1, ("removed", "docx_pdf_pair"): 1, ("removed", "same_stem_duplicate"): 1,
                     ("lang", "KO"): 1, ("lang", "EN"): 2, ("lang", None): 2, ("category", "a"): 2, ("category", "c"): 3}
    assert curation.write_survivors(tagged, str(tmp_path / "kept")) == {"input": 9, "draft": 1, "hash_duplicate": 1, "docx_pdf_pair": 1, "same_stem_duplicate": 1, "output": 5}
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    assert curation.funnel_report(curation.funnel(spark.createDataFrame([], FILES))).count() == 0


def test_the_funnel_scans_once(spark, tmp_path):
    spark.createDataFrame(ROWS, FILES).write.parquet(str(tmp_path / "f"))
    plan = curation.funnel_report(curation.funnel(spark.read.parquet(str(tmp_path / "f"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_sketches_are_near_the_exact_counts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    vector = F.col("l_returnflag") == "R"
    exact = corpus.corpus_stats(rows, "l_orderkey", vector).first()
    days = curation.corpus_sketches(rows, "l_orderkey", vector, F.to_date("l_shipdate"))
    near = curation.sketched_stats(days).first()
    assert near["n_rows"] == exact["n_rows"]
    for c in ("sources", "embedded"):
        assert abs(near[c] - exact[c]) < 0.03 * exact[c]
    assert tuple(curation.sketched_stats(days.limit(0)).first()) == (0, 0, 0)
    assert "lineitem" not in curation.sketched_stats(spark.createDataFrame(days.limit(3).collect(), days.schema))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "text", ["", "a & b", "&amp;&lt;&gt;&quot;&#39;&nbsp;", "&#xAC00;&#44032; &eacute;&Eacute;", "&amp;lt;", "&unknown; &#; &#x; &amp", "&#128;&#0;&#55296;&#1114112;&#x1F600;", "&#65 x", "plain\ntext"]
)
def test_references_decode_as_the_standard_library_does(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(G.decode_references(F.col("t"))).first()[0]
    assert got == (html.unescape(text) if not text.endswith("&amp") else html.unescape(text[:-4]) + "&amp")  # names need their semicolon here


def test_figures(spark):
    page = (
        '<div class="figure" id="a"><img alt="x" src="img/One.JPG"/><p>t</p><div class="figure-caption">그림 3.2 Press &amp; <b>ring</b>: a/b </div></div>'
        '<div class="figure"><img src="data:image/jpeg;base64,AAA"><div class="figure-caption"> 그림 1-4 </div></div>'
        '<div class="figure"><img src="' + "data:image/x;" + "A" * 300 + '"><div class="figure-caption">Placeholder here</div></div>'
        '<div class="figure"><img src="a.b/noext"><div class="figure-caption">&lt;b&gt;x&lt;/b&gt;</div></div>'
        '<div class="other"><img src="no.png"></div>'
    )
    rows = spark.createDataFrame([(page,), (None,), ("",)], "h string").select(G.figure_blocks(F.col("h")).alias("f")).collect()
    assert [tuple(x)[1:] for x in rows[0]["f"]] == [
        ("그림 3.2 Press & ring: a/b", None, ".jpg", "001_그림_3-2_Press_&_ring_ab.jpg"),
        ("그림 1-4", "이미지 데이터 너무 작음", ".jpg", "002_그림_1-4.jpg"),
        ("Placeholder here", "플레이스홀더", ".png", "003_Placeholder_here.png"),
        ("x", None, ".png", "004_x.png"),
    ]
    assert [r["f"] for r in rows[1:]] == [None, []]
