"""The stages of the pipeline on rows with nulls, repeated ids and clashing columns, against plain versions."""

import re

import numpy as np
import pytest

import corpus_pipeline
from floorops.llm import simhash

WORDS = [f"w{i}" for i in range(40)]
#: Names that the operators use for their own columns.
CLASHES = ["items", "spans", "n_hit", "n_words", "n_lines", "removed", "_doc", "_gone", "_text_key", "row", "gone", "key", "id", "fp", "root", "score", "in_0_"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(rows)], DDL)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(rng.choice(WORDS, 12)))], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_near_copies_keep_one_of_each_group_whatever_the_ids(spark, sf):
    rng = np.random.default_rng(2)
    a, b, c, d = (" ".join(rng.choice(WORDS, 30)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (5, a), (5, c), (7, d), (7, d), (None, d), (9, None), (8, "")]
    got = corpus_pipeline.near_copies(spark, frame(spark, rows), sf)
    assert got.dtypes == frame(spark, rows).dtypes
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == sorted([(1, a), (None, b), (5, c), (7, d), (8, "")], key=repr)
    for r in got.collect():
        k = re.sub(r"\D", "", r["items"])
        assert all(r[x] == f"{x}{k}" for x in CLASHES) and rows[int(k)] == (r["doc_id"], r["text"])


def test_lines_stage(spark, sf):
    a = " ".join(WORDS[:10])
    near = " ".join([*WORDS[:9], "x"])  # 9 of 11 words: 0.82
    far = " ".join([*WORDS[:8], "x", "y"])
    rows = [(2, f"{near}\nRead more here\n\n"), (1, a), (None, "Read more here"), (3, f"{far}\nhere more Read"), (3, a), (4, None), (5, ""), (4, f"{a}\nnew words"), (1, a)]
    got = corpus_pipeline.lines(spark, frame(spark, rows), sf)
    assert got.dtypes == frame(spark, rows).dtypes
    out = sorted(((r["doc_id"], r["text"], r["n_chars"], r["removed"][:7]) for r in got.collect()), key=repr)
    # (1, a) stands twice at one place, and no row of it is earlier; far shares 8 of 12 words with a, but 9 of 11 with near
    want = [(2, "\n", 1), (1, a, 0), (1, a, 0), (None, "Read more here", 14), (4, None, None), (5, "", 0), (4, "new words", 9)]
    n = len(a)
    want = [(i, t, n if t == a else x, "removed") for i, t, x in want]
    assert out == sorted(want, key=repr)


def test_benchmark_stage(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, f"so {item} it is"), (None, item), (2, "clean text"), (None, None), (2, ""), (3, " ".join(item.split()[:9]))]
    got = corpus_pipeline.benchmark(spark, frame(spark, rows), sf)
    assert got.dtypes == frame(spark, rows).dtypes
    assert sorted((repr(r["doc_id"]), repr(r["text"]), r["spans"][:5]) for r in got.collect()) == sorted((repr(i), repr(t), "spans") for i, t in rows[2:])


def test_quality_stage_goes_by_id_and_text(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(WORDS, 40)) + "." for _ in range(200)]
    bad = ["!!! $$ " * 30 + str(i) for i in range(60)]
    spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = list(enumerate(good)) + [(1000 + i, t) for i, t in enumerate(bad)] + [(None, good[0]), (None, bad[0]), (0, bad[1]), (0, bad[1])]
    got = corpus_pipeline.quality(spark, frame(spark, rows), str(tmp_path))
    assert got.dtypes == frame(spark, rows).dtypes
    kept = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (None, good[0]) in kept and (None, bad[0]) not in kept and (0, good[0]) in kept and (0, bad[1]) not in kept
    assert len(kept) == 201


def test_run_on_empty_tables_and_against_its_stages(spark, tmp_path, sf):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "packing"]


def test_dropping_one_group_leaves_the_others(spark):
    rows = [(i, f"t{i} " + " ".join(WORDS[i : i + 20])) for i in range(12)]
    got = simhash.dedup_simhash(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(rows)
