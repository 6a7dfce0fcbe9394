import numpy as np
from pyspark.sql import functions as F

from floorops.operators import chunks, metadata, sheets
from floorops.sources import files


def test_sheets_equal_one_text_cut_whole(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(30):
        for i in range(int(rng.integers(0, 60))):
            rows.append((f"s{s}", s % 2, i, "x" * int(rng.integers(0, 30)), " y z " if rng.random() < 0.5 else None))
    rows += [("long", 0, 0, "q" * 1000, "r"), ("long", 0, 1, "s", None), ("one", 0, 0, "a", None), ("blank", 1, 0, " ", None), ("h" * 130, 0, 0, "a" * 90, "b"), (None, 0, 0, "a", None), ("edge", 1, 0, "e" * 100, None), ("edge2", 1, 0, "e" * 91, None)]
    df = spark.createDataFrame(rows, "sheet string, no int, pos int, a string, b string").repartition(3)
    for size, overlap in ((100, 10), (64, 0), (50, 30)):
        want = chunks.chunk_rows(df, ["sheet", "no"], "pos", ["a", "b"], size, overlap)
        got = sheets.chunk_sheets(df, ["sheet", "no"], "pos", ["a", "b"], size, overlap, buckets=7)
        key = lambda x: sorted((str(r["sheet"]), r["no"], r["chunk_index"], r["content"]) for r in x.collect())
        assert key(got) == key(want)
    assert sheets.chunk_sheets(df.limit(0), ["sheet"], "pos", ["a"]).count() == 0


def test_a_large_sheet_spreads_over_tasks(spark):
    df = spark.range(1_000_000).select(F.lit("big").alias("sheet"), "id", F.concat(F.lit("cell "), "id").alias("a"))
    bucket = sheets._bucket(df, "id", 64)
    sizes = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 1_000_000 / 64
    got = sheets.chunk_sheets(df, ["sheet"], "id", ["a"], 1000, 100, buckets=64)
    n = got.select(F.max("chunk_index").alias("last"), F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars")).first()
    chars = sum(len(f"cell {i}") + 1 for i in range(1_000_000)) - 1
    assert n["n"] == n["last"] + 1 == 1 + -(-chars // 900)
    rest = got.filter("chunk_index = 5000").first()["content"]
    text = "\n".join(f"cell {i}" for i in range(400_000))
    assert rest == text[4999 * 900 :][:1000]


def test_metadata_of_manuals(spark):
    names = [("d1", "CSD5_Drive user manual.pdf"), ("d2", "irb-360 ABB.pdf"), ("d3", "x.pdf"), ("d4", "MAY list.pdf"), ("d5", "AB-1.pdf"), ("d6", None)]
    pages = [("d1", 1, "모터"), ("d2", 1, "a" * 120), ("d2", 4, "삼성 parameter"), ("d3", 2, "Wiring \0DIAGRAM"), ("d3", 1, "melsec install"), ("d5", 1, None), ("d5", 3, "release note 통신")]
    docs, text = spark.createDataFrame(names, "doc string, name string"), spark.createDataFrame(pages, "doc string, page int, text string")
    got = metadata.manual_metadata(docs, text, metadata.dictionary(spark, metadata.MAKERS), metadata.dictionary(spark, metadata.KINDS))
    assert sorted((r["doc"], r["standardized_name"]) for r in got.collect()) == [
        ("d1", "Samsung_CSD5_UserManual_KO.pdf"),
        ("d2", "ABB_ABB_Manual_EN.pdf"),
        ("d3", "Mitsubishi_Unknown_InstallGuide_KO.pdf"),
        ("d4", "Unknown_Unknown_Manual_KO.pdf"),
        ("d5", "Unknown_AB-1_CommManual_KO.pdf"),
        ("d6", "Unknown_Unknown_Manual_KO.pdf"),
    ]


def test_a_database_table_in_ranges(spark):
    url, driver = "jdbc:derby:memory:items;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i if i % 10 else None, f"n{i}", i % 3) for i in range(200)]
    spark.createDataFrame(rows, "ID int, NAME string, KIND int").write.mode("overwrite").jdbc(url, "ITEMS", properties={"driver": driver})
    got = files.read_table(spark, url, "ITEMS", key="ID", bounds=(0, 200), parts=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)  # rows without a key are read once, too
    sizes = [n for n in got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert sum(sizes) == 200 and min(sizes) > 30
    some = got.filter("KIND = 1").select("NAME")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KIND), *EqualTo(KIND,1)]" in plan and "ReadSchema: struct<NAME:string>" in plan
    assert some.count() == sum(k == 1 for _, _, k in rows)
    whole = files.read_table(spark, url, "(SELECT KIND, COUNT(*) AS N FROM ITEMS GROUP BY KIND) t", driver=driver)
    assert sorted(map(tuple, whole.collect())) == [(k, sum(x == k for _, _, x in rows)) for k in range(3)]
