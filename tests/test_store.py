"""The folder of chunks, in batch and from a stream."""

import hashlib

from pyspark.sql import functions as F

from floorops.operators import chunks
from floorops.sources import store
from floorops.streaming import stateful

DDL = "source_file string, chunk_index int, content string, category string"


def files_of(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in path.rglob("*.parquet")}


def rows_of(spark, path):
    return sorted((r.source_file, r.chunk_index, r.content, r.category) for r in store.read_chunks(spark, str(path)).collect())


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    path = tmp_path / "index"
    many = [(f"s{i}", k, f"{i}.{k}", "old") for i in range(40) for k in range(3)]
    store.write_chunks(spark.createDataFrame(many, DDL), str(path), 0, parts=16)
    assert rows_of(spark, path) == sorted(many)
    before = files_of(path)
    new = spark.createDataFrame([("s3", 0, "new", "x"), ("s99", 0, "n", "y")], DDL)
    store.write_chunks(new, str(path), 1, parts=16)
    want = sorted([r for r in many if r[0] != "s3"] + [("s3", 0, "new", "old"), ("s99", 0, "n", "y")])  # the tail of s3 goes, its category stays
    assert rows_of(spark, path) == want
    touched = {r[0] for r in new.select(store.part_of(F.col("source_file"), 16)).collect()}
    after = files_of(path)
    assert {k: v for k, v in after.items() if int(k.split("=")[1].split("/")[0]) not in touched} == {k: v for k, v in before.items() if int(k.split("=")[1].split("/")[0]) not in touched}
    store.write_chunks(new, str(path), 1, parts=16)  # the same batch again
    assert rows_of(spark, path) == want
    for no in range(2, 6):  # versions do not pile up
        store.write_chunks(new, str(path), no, parts=16)
    assert rows_of(spark, path) == want
    assert all(len({k.split("/")[1] for k in files_of(path) if k.startswith(f"_part={p}/")}) <= 2 for p in range(16))


def test_a_torn_write_leaves_the_version_before(spark, tmp_path):
    path = tmp_path / "index"
    store.write_chunks(spark.createDataFrame([("a", 0, "one", "c"), ("b", 0, "b", "c")], DDL), str(path), 0, parts=1)
    store.write_chunks(spark.createDataFrame([("a", 0, "two", "c")], DDL), str(path), 1, parts=1)
    for p in (path / "_part=0" / "_slot=1").glob("*"):  # as if batch 1 had not come to its end
        p.unlink()
    assert rows_of(spark, path) == [("a", 0, "one", "c"), ("b", 0, "b", "c")]
    store.write_chunks(spark.createDataFrame([("a", 0, "two", "c")], DDL), str(path), 1, parts=1)
    assert rows_of(spark, path) == [("a", 0, "two", "c"), ("b", 0, "b", "c")]


def test_sources_without_chunks_and_new_columns(spark, tmp_path):
    path = tmp_path / "index"
    store.write_chunks(spark.createDataFrame([("a", 0, "one", "c"), ("b", 0, "b", "c")], DDL), str(path), 0, parts=1)
    none = spark.createDataFrame([], DDL)
    store.write_chunks(none, str(path), 1, spark.createDataFrame([("a",)], "source_file string"), parts=1)
    assert rows_of(spark, path) == [("b", 0, "b", "c")]
    store.write_chunks(none, str(path), 2, spark.createDataFrame([("b",), (None,)], "source_file string"), parts=1)
    assert rows_of(spark, path) == []
    store.write_chunks(spark.createDataFrame([("b", 0, "b", 3), (None, 0, "x", 3)], "source_file string, chunk_index int, content string, page int"), str(path), 3, parts=1)
    got = store.read_chunks(spark, str(path)).first()
    assert (got.source_file, got.content, got.page, got.category) == ("b", "b", 3, None)


def test_index_stream(spark, tmp_path):
    src, path = tmp_path / "docs", tmp_path / "out"
    add = lambda rows: spark.createDataFrame(rows, "source_file string, text string").coalesce(1).write.mode("append").json(str(src))

    def run():
        stream = spark.readStream.schema("source_file string, text string").json(str(src))
        stateful.stream_index(stream, lambda b: chunks.chunk_with(b, chunks.by_line), str(path), str(tmp_path / "c"), parts=8).trigger(availableNow=True).start().awaitTermination(180)
        return sorted((r.source_file, r.content) for r in store.read_chunks(spark, str(path)).collect())

    add([("a", "one"), ("b", "two")])
    assert run() == [("a", "one"), ("b", "two")]
    add([("a", "changed")])
    assert run() == [("a", "changed"), ("b", "two")]
    add([("b", ""), ("c", None)])
    assert run() == [("a", "changed")]
