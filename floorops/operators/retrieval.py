"""Vector search, context building, answer cache, graph and text ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vector_search(chunks: DataFrame, query: list[float], k: int, id_col: str = "vec_id", category: int | None = None) -> DataFrame:
    """Top k by cosine for one query: one scan, in which each batch of rows is one product and gives its best k.

    Rows whose vector is null, zero, of another length, or holds a null or
    non-finite component are no hits.
    """
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or np.nan)
    rows = chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(q)))
    if category is not None:
        rows = rows.filter(F.col("label") == category)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = x @ q / np.linalg.norm(x, axis=1)
            fine = np.flatnonzero(np.isfinite(sim))
            if len(fine) > k:
                kth = np.partition(sim[fine], len(fine) - k)[len(fine) - k]
                fine = fine[sim[fine] >= kth]  # with all that tie
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine)), pa.array(sim[fine])], names=["id", "sim"])

    found = rows.select(F.col(id_col).alias("id"), F.col("embedding")).mapInArrow(best, f"id {chunks.schema[id_col].dataType.simpleString()}, sim double")
    return found.orderBy(F.desc("sim"), "id").limit(k).select(F.col("id").alias(id_col), F.round("sim", 4).alias("similarity"))


def build_context(hits: DataFrame, least: float = 0.3, per_source: int = 5) -> DataFrame:
    """Per source: its best hits of at least ``least``, numbered and joined."""
    w = W.partitionBy("source").orderBy(F.desc("similarity"), "vec_id")
    rows = hits.filter(F.col("similarity") >= least).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_source)
    line = F.format_string("[%d] %d %.4f", "rn", "vec_id", "similarity")
    return rows.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def expand(rels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Neighbours of the seeds over relations in either direction."""
    both = rels.select("src", "dst", "type").unionByName(rels.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


def neighbours(nodes: DataFrame, rels: DataFrame, ids: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations): at most ``n`` relations of the given nodes in either direction, and the nodes at their ends, each once.

    Every relation counts for itself, parallel ones too; which ``n`` is decided by their id.
    """
    seeds = ids.select(F.col("id").alias("_id")).distinct()
    ends = rels.select("*", F.explode(F.array_distinct(F.array("src", "dst"))).alias("_id"))
    found = ends.join(seeds, "_id", "left_semi").drop("_id").dropDuplicates(["id"]).orderBy("id").limit(n)
    reached = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(reached, "id", "left_semi"), found


def node_search(nodes: DataFrame, text: str, n: int = 50) -> DataFrame:
    """Nodes (id, props) with the text in any property, at most ``n``."""
    return nodes.filter(F.exists(F.map_values("props"), lambda v: F.contains(v, F.lit(text)))).orderBy("id").limit(n)


def keyword_nodes(nodes: DataFrame, text: str, n: int) -> DataFrame:
    """At most ``n`` nodes (id, name) whose name holds any word of two or more characters, whatever its case."""
    words = [w.lower() for w in text.replace(",", " ").split() if len(w) >= 2]
    name = F.lower("name")
    return nodes.filter(F.exists(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(name, w))).orderBy("id").limit(n)


def induced(rels: DataFrame, nodes: DataFrame, mode: str = "both") -> DataFrame:
    """Relations with both ends among the nodes, or with ``either`` end there; each once."""
    ids = nodes.select("id")
    if mode == "either":
        known = ids.distinct().withColumn("_in", F.lit(True))
        a, b = (known.select(F.col("id").alias(c), F.col("_in").alias(f"_{c}")) for c in ("src", "dst"))
        return rels.join(a, "src", "left").join(b, "dst", "left").filter("_src or _dst").select(*rels.columns)
    return rels.join(ids, rels["src"] == ids["id"], "left_semi").join(ids, rels["dst"] == ids["id"], "left_semi")


def bm25(docs: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Top k documents for a bag of terms (in lower case); only these terms are counted, and only where they can be.

    One pass over the texts takes their lengths and counts; these narrow rows
    are shuffled once, and both the totals and the scores are made of them.
    """
    low = docs.select("doc_id", F.lower("text").alias("low"))

    def times(term: str):
        whole = r"(?<![\p{L}\p{N}])" + re.escape(term) + r"(?![\p{L}\p{N}])"
        return F.when(F.contains("low", F.lit(term)), F.regexp_count("low", F.lit(whole))).otherwise(0).cast("double")

    tf = [times(t) for t in terms]
    # no nulls here: else Spark filters them before the shuffle, in one branch only, and counts all words again for that
    length = F.coalesce(F.regexp_count("low", F.lit(r"[\p{L}\p{N}]+")), F.lit(-1)).alias("len")
    rows = low.select("doc_id", length, *[F.coalesce(t, F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(tf)])
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    s = rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col("len") >= 0, F.col("len"))).alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    joined = rows.join(F.broadcast(s), F.lit(True))  # one row of totals
    return joined.withColumn("s", score).filter("s > 0").orderBy(F.desc(F.round("s", 6)), "doc_id").limit(k).select("doc_id", F.round("s", 4).alias("score"))


def rrf(lists: list[DataFrame], key: str, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists of (key, rank)."""
    out = lists[0].select(key, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(key, "rank"))
    return out.groupBy(key).agg(F.round(F.sum(1.0 / (F.lit(c) + F.col("rank"))), 6).alias("score"))
