"""Projections of the driver's tables to the logical tables of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_log(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("tool_name"), F.col("ts").alias("timestamp"))


def response_times(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("channel"), F.col("value").alias("elapsed_sec"))


def pings(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("agent_id"), "ts", (F.col("event_type") != "error").alias("online"))


def chat(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("channel"), F.col("user_id").cast("string").alias("user"), "ts")


def messages(spark, d):
    """Turns of conversations as messages; a synthetic time orders them."""
    t = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.timestamp_add("HOUR", F.col("conv_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("from"), F.col("text").alias("content"), t.alias("time"))


def nc_reports(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.try_element_at(F.create_map(*[F.lit(x) for p in (("1", "critical"), ("2", "high"), ("3", "medium"), ("5", "low")) for x in p]), F.substring("o_orderpriority", 1, 1)).alias("importance"),
        F.col("o_custkey").alias("project_id"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 100).alias("manager_id"),
        (F.col("o_orderkey") % 97).alias("reporter_id"),
        F.concat(F.lit("NC "), "o_orderpriority").alias("title"),
        F.timestamp_add("DAY", F.lit(6), F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(F.col("o_orderdate").cast("date"), 5)).alias("action_completion_date"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").cast("double").alias("cost"),
    )


def projects(spark, d):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "completed").otherwise("active")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), status.alias("status"), F.col("c_nationkey").alias("nation_id"),
        F.date_add(F.lit("2001-07-01").cast("date"), (F.col("c_custkey") % 90).cast("int")).alias("delivery_date"), (F.col("c_custkey") % 101).cast("int").alias("progress"),
    )


def users(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("username"), F.substring("s_name", 1, 8).alias("last_name"), F.substring_index("s_name", "#", -1).alias("first_name"))


def purchases(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("item"), F.col("p_name").alias("project_name"), F.col("l_shipdate").cast("date").alias("order_date"))


def files(spark, d):
    ext = F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".docx")
    return table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("category"),
        (F.col("doc_id") % 100).cast("string").alias("stem"),
        ext.alias("ext"),
        F.col("n_chars").alias("size"),
        F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("hash"),
        "doc_id",
        "text",
        "lang",
    )
