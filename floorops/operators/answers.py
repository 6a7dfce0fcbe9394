"""Answers to questions: from the cache, else from what the corpora hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.functions.verdicts import answer_quality, question_topics
from floorops.operators.neighbours import cache_lookup, knn

# What answers are made of.
HISTORY, MANUAL = "[CS이력] ", "[매뉴얼] "
NOTHING = "관련 정보를 찾지 못했습니다."
FROM_CACHE = "캐시 히트"


def retrieved(questions: DataFrame, corpora: dict[str, DataFrame], k: int = 3, cut: int = 200) -> DataFrame:
    """(query_id, answer): the starts of the ``k`` nearest texts of each corpus (id, embedding, text), each after the corpus's mark."""
    parts = None
    for no, (mark, corpus) in enumerate(corpora.items()):
        found = knn(questions.select("query_id", "embedding"), corpus.select("id", "embedding"), k)
        text = found.join(corpus.select(F.col("id").alias("vec_id"), "text"), "vec_id").filter("text <> ''")
        some = text.select("query_id", F.struct(F.lit(no).alias("corpus"), "rank", F.concat(F.lit(mark), F.substring("text", 1, cut)).alias("part")).alias("p"))
        parts = some if parts is None else parts.unionByName(some)
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["part"]), "\n").alias("answer"))


def answer_flow(questions: DataFrame, cache: DataFrame, history: DataFrame, manuals: DataFrame, threshold: float = 0.92, least: float = 0.5, worth: float = 0.4) -> DataFrame:
    """For each question (query_id, question, embedding): answer, source, cached entry, quality, topics, and whether to save it.

    A usable cached answer (``cache``: id, embedding, answer, score) is taken
    as it is, with its quality judged again. Else the answer is what the
    corpora hold, or that nothing was found; one with parts and a quality of at
    least ``worth`` is worth saving (``cache_save``).
    """
    hits = cache_lookup(questions.select("query_id", "embedding"), cache, threshold, least).filter("usable")
    cached = hits.join(cache.select(F.col("id").alias("vec_id"), "answer"), "vec_id").select("query_id", F.col("vec_id").alias("qa_id"), F.col("answer").alias("cached"))
    todo = questions.join(cached, "query_id", "left_anti")
    found = retrieved(todo, {HISTORY: history, MANUAL: manuals}).withColumnRenamed("answer", "found")
    rows = questions.drop("embedding").join(cached, "query_id", "left").join(found, "query_id", "left")
    hit = F.col("qa_id").isNotNull()
    judged = rows.withColumn("answer", F.when(hit, F.col("cached")).otherwise(F.coalesce("found", F.lit(NOTHING)))).withColumn("q", answer_quality(F.col("answer")))
    reasons = F.when(hit, F.concat(F.array(F.lit(FROM_CACHE)), "q.reasons")).otherwise(F.col("q.reasons"))
    saved = ~hit & F.col("found").isNotNull() & (F.col("q.score") >= worth)
    return judged.select("query_id", "answer", F.when(hit, "cache").otherwise("rag").alias("source"), "qa_id", "q.score", reasons.alias("reasons"), question_topics(F.col("question")).alias("topics"), saved.alias("saved"))
