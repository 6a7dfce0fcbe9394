"""Searches and counts over texts and messages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorops.functions.verdicts import NO_TASK_FOR, TASK_PREFIXES, is_task_message, task_name


def session_search(rows: DataFrame, words: str, columns: list[str], equal: Mapping[str, str]) -> DataFrame:
    """Rows with ``words`` in any of ``columns`` and the given values."""
    found = reduce(Column.__or__, [F.contains(c, F.lit(words)) for c in columns])
    return rows.filter(reduce(Column.__and__, [F.col(c) == v for c, v in equal.items()], found))


def embeddable(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of ``columns`` is null or blank."""
    return rows.filter(reduce(Column.__and__, [F.trim(c) != "" for c in columns]))


def without_noise(rows: DataFrame, column: str, noise: list[str]) -> DataFrame:
    """Rows whose text holds none of the noise phrases."""
    return rows.filter(reduce(Column.__and__, [~F.contains(column, F.lit(x)) for x in noise]))


#: What agents say when they have started.
BOOT_PHRASES = ["기동 완료", "준비 완료"]


def agent_replies(rows: DataFrame, agent: str, text: str = "content", noise: list[str] = BOOT_PHRASES) -> DataFrame:
    """What an agent has sent (column ``from``), without boot messages; a missing text is no noise."""
    quiet = reduce(Column.__and__, [~F.contains(F.coalesce(text, F.lit("")), F.lit(x)) for x in noise])
    return rows.filter((F.col("from") == agent) & quiet)


def task_messages(rows: DataFrame, skip: tuple[str, ...] = NO_TASK_FOR) -> DataFrame:
    """Messages (to, content) that give a task to someone outside ``skip``, with the task's name."""
    to = F.coalesce("to", F.lit(""))
    return rows.filter((to != "") & ~to.isin(*skip) & is_task_message(F.col("content"), TASK_PREFIXES)).withColumn("task", task_name(F.col("content")))


def figure_refs(docs: DataFrame, key: str, text: str, figures: DataFrame, pattern: str) -> DataFrame:
    """The figures (no, figure) to which a text refers by number, sorted and joined by commas; a figure counts once."""
    refs = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("no")).select(key, F.col("no").cast("long").alias("no")).distinct()
    return refs.join(figures, "no").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("figure")), ",").alias("figures"))


def reason_counts(rows: DataFrame, reason: str, kinds: list[str], other: str = "other") -> DataFrame:
    """How many rows have a reason of each kind (what stands before its colon); all others count together."""
    kind = F.substring_index(reason, ":", 1)
    return rows.groupBy(F.when(kind.isin(*kinds), kind).otherwise(other).alias("reason")).agg(F.count("*").alias("n"))


def most_frequent(rows: DataFrame, column: str, name: str, n: int) -> DataFrame:
    return rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)
