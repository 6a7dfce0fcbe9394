"""Readers and writers of the back office's files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floorops.functions.verdicts import channel_tags

CHATLOG = "_header BOOLEAN, channel_id STRING, channel_name STRING, ts STRING, user_id STRING, username STRING, text STRING, files ARRAY<STRUCT<name STRING, type STRING, saved_path STRING>>, _bad STRING"
SESSIONS = (
    "session_id STRING, timestamp STRING, channel STRING, user STRING, question_source STRING, language STRING, query STRING, question STRING,"
    " full_response STRING, response_summary STRING, answer_preview STRING, answer STRING, status STRING, equipment_type STRING, _bad STRING"
)


def read_chatlog(spark: SparkSession, path: str) -> DataFrame:
    """Messages of one-file-per-channel JSONL; the header row names the channel, else the file's stem; bad lines are skipped."""
    rows = spark.read.schema(CHATLOG).option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.col("_metadata.file_name").alias("file")).filter("_bad is null")
    heads = rows.filter("_header").groupBy("file").agg(F.first("channel_id").alias("head_id"), F.first("channel_name").alias("head_name"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    got = rows.filter("_header is null or not _header").drop("channel_id", "channel_name", "_header", "_bad").join(heads, "file", "left")
    return got.select(F.coalesce("head_id", stem).alias("channel_id"), F.coalesce("head_name", stem).alias("channel_name"), "ts", "user_id", "username", "text", "files")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session rows with old and new field names brought together."""
    rows = spark.read.schema(SESSIONS).option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad is null").drop("_bad")
    answer = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("full_response", "response_summary", "answer_preview", "answer")])
    legacy = F.concat(F.lit("legacy-"), F.col("timestamp"))
    return rows.select(
        F.coalesce("session_id", legacy).alias("session_id"), "timestamp", "channel", "user", F.coalesce("query", "question").alias("question"), answer.alias("answer"), "status", "language", "equipment_type", "question_source"
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a nested manifest that have a saved path and no error; the first entry of a project wins."""
    schema = "files ARRAY<STRUCT<project_id STRING, project_code STRING, saved_path STRING, error STRING>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("files").alias("pos", "f")).select("pos", "f.*").filter("error is null and saved_path is not null")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("project_id").orderBy("pos"))).filter("rn = 1").drop("rn", "pos", "error")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    schema = "files MAP<STRING, STRUCT<status STRING, chunks INT, agent STRING, reason STRING, updated_at STRING>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("files").alias("path", "row")).select("path", "row.*")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("content"))
    return rows.filter(F.length(F.trim("content")) > 0)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files with the category of their folder and the first 16 hex digits of their SHA-256."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("category"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("modificationTime").alias("modified"))


def write_sessions(df: DataFrame, combined: str, per_session: str) -> None:
    df.write.mode("append").json(combined)
    df.write.mode("append").partitionBy("session_id").json(per_session)


def read_transcripts(spark: SparkSession, path: str, agents: dict[str, str]) -> DataFrame:
    """Assistant and user rows of nested transcripts, with all four kinds of tokens; lines that are no JSON are skipped.

    The folder's name gives the agent by a lookup, else stands itself.
    ``content`` is text in one row and an array of objects in the next, so it
    is a variant.
    """
    usage = "input_tokens: BIGINT, output_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT"
    schema = f"type STRING, timestamp STRING, requestId STRING, message STRUCT<role: STRING, content: VARIANT, usage: STRUCT<{usage}>>, _bad STRING"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder")).filter("_bad IS NULL AND type IN ('assistant', 'user')")
    agent = F.coalesce(*[F.when(F.col("folder") == k, F.lit(v)) for k, v in agents.items()], F.col("folder"))
    return rows.select(agent.alias("agent"), "type", "timestamp", F.col("requestId").alias("request_id"), "message.content", "message.usage.*")


# The sources of tagged messages, the tools that send some, and who speaks by telegram.
AGENT_SOURCE, TELEGRAM_SOURCE = "agent-channel", "plugin:telegram:telegram"
AGENT_TOOL, TELEGRAM_TOOL = "mcp__agent-channel__send_message", "mcp__plugin_telegram_telegram__reply"
TELEGRAM_AGENT, TELEGRAM_SENDER = "MAX", "boss"


def transcript_messages(transcripts: DataFrame) -> DataFrame:
    """Messages (from, to, content, type, ts) of transcripts (agent, type, timestamp, content).

    User rows hold tagged messages in their text, assistant rows tool calls in
    an array; both may be of the agents' channel, and those of one agent also
    of telegram. A tag without a time takes its row's. Tool calls without
    receiver or text, and contents of any other shape, give nothing.
    """
    kind = F.schema_of_variant("content")
    said = F.when((F.col("type") == "user") & (kind == "STRING"), F.try_variant_get("content", "$", "string"))
    by_max = F.col("agent") == TELEGRAM_AGENT
    tags = F.concat(
        F.transform(F.when(by_max, channel_tags(F.col("said"), TELEGRAM_SOURCE)).otherwise(F.array()), lambda x: F.struct(F.lit(TELEGRAM_SENDER).alias("from"), x["content"].alias("content"), F.lit("telegram").alias("type"), x["ts"].alias("ts"))),
        F.transform(channel_tags(F.col("said"), AGENT_SOURCE), lambda x: F.struct(x["from"].alias("from"), x["content"].alias("content"), F.lit("chat").alias("type"), x["ts"].alias("ts"))),
    )
    tagged = transcripts.withColumn("said", said).filter("said is not null").select("agent", "timestamp", F.explode(tags).alias("m"))
    tagged = tagged.select("m.from", F.col("agent").alias("to"), "m.content", "m.type", F.coalesce(F.nullif("m.ts", F.lit("")), "timestamp").alias("ts"))

    lists = transcripts.filter((F.col("type") == "assistant") & kind.startswith("ARRAY"))
    calls = lists.lateralJoin(transcripts.sparkSession.tvf.variant_explode(F.col("content").outer())).select("agent", "timestamp", "value")

    def field(at: str):
        return F.nullif(F.try_variant_get("value", at, "string"), F.lit(""))

    calls = calls.filter(field("$.type") == "tool_use").select("agent", "timestamp", field("$.name").alias("name"), field("$.input.to").alias("to"), field("$.input.message").alias("message"), field("$.input.text").alias("text"))
    by_telegram = (F.col("name") == TELEGRAM_TOOL) & by_max
    sent = calls.select(
        F.col("agent").alias("from"),
        F.when(by_telegram, F.lit(TELEGRAM_SENDER)).when(F.col("name") == AGENT_TOOL, F.col("to")).alias("to"),
        F.when(by_telegram, F.col("text")).when(F.col("name") == AGENT_TOOL, F.col("message")).alias("content"),
        F.when(by_telegram, "telegram").otherwise("chat").alias("type"),
        F.col("timestamp").alias("ts"),
    )
    return tagged.unionByName(sent.filter("`to` is not null and content is not null"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of daily files, each a JSON array; files that are no JSON give nothing."""
    return spark.read.schema("id STRING, `from` STRING, `to` STRING, content STRING, time TIMESTAMP, type STRING, msg_type STRING, task_id STRING").option("mode", "DROPMALFORMED").json(path, multiLine=True)


def write_messages(msgs: DataFrame, path: str, tz: str = "Asia/Seoul") -> None:
    """Append messages as JSON lines to the folder of their local day."""
    msgs.withColumn("day", F.to_date(F.from_utc_timestamp("time", tz))).write.mode("append").partitionBy("day").json(path)


def read_checklists(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Items of a JSON map from folders to arrays; folders renamed by the dictionary, items without a name skipped."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, ARRAY<STRUCT<name: STRING, standard: STRING>>>").alias("m"))
    items = text.select(F.explode("m").alias("folder", "items")).select("folder", F.posexplode("items").alias("pos", "item")).filter("trim(item.name) <> ''")
    named = F.coalesce(*[F.when(F.col("folder") == k, F.lit(v)) for k, v in names.items()], F.col("folder"))
    return items.select(named.alias("equipment"), "pos", "item.*")


def read_attachment_csv(spark: SparkSession, path: str, id_col: str, name_col: str, file_col: str) -> DataFrame:
    """(id, name, attachment) of the rows of a UTF-8 CSV whose attachment is not blank; a byte-order mark is left out."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.trim(file_col).alias("attachment")).filter("attachment <> ''")


def files_modified_on(files: DataFrame, day: str, tz: str, col: str = "modified") -> DataFrame:
    """Files modified on a local day."""
    return files.filter(F.to_date(F.from_utc_timestamp(col, tz)) == F.lit(day).cast("date"))


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A database's table over JDBC, read in ``parts`` ranges of ``key`` where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
