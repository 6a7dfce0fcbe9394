"""Operations-log analytics: tools, messages, response times, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tool_stats(log: DataFrame) -> DataFrame:
    """Calls by agent and calls by tool, in one pass over the log."""
    by = log.groupingSets([["agent_id"], ["tool_name"]], "agent_id", "tool_name").agg(F.grouping("agent_id").alias("g"), F.count("*").alias("n"))
    return by.select(F.when(F.col("g") == 0, "agent").otherwise("tool").alias("dim"), F.when(F.col("g") == 0, F.col("agent_id")).otherwise(F.col("tool_name")).alias("key"), "n")


def top_n_keys(stats: DataFrame, dim: str, n: int) -> DataFrame:
    return stats.filter(F.col("dim") == dim).orderBy(F.desc("n"), "key").limit(n)


def sender_counts(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy(F.coalesce("from", F.lit("unknown")).alias("sender")).agg(F.count("*").alias("n"))


def daily_volume(msgs: DataFrame, as_of: str, days: int = 7, tz: str = "UTC", ts: str = "ts") -> DataFrame:
    """Messages per local day for the last days, zero-filled."""
    spark = msgs.sparkSession
    local = F.to_date(F.from_utc_timestamp(F.col(ts), tz))
    end = F.to_date(F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), tz))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = msgs.filter(local.between(F.date_sub(end, days - 1), end)).groupBy(local.alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def response_stats(rt: DataFrame) -> DataFrame:
    """Answers and mean seconds per agent; rows without a time do not count.

    The mean is exact, so that no order of the sum decides a tie: each time
    counts in whole microseconds, and the quotient of the whole numbers is
    rounded to tenths, halves away from zero. Agents with a time that is not
    finite or has 9e12 seconds or more have the plain mean of doubles, rounded.
    """
    micros = F.when(F.abs("elapsed_sec") < 9e12, F.floor(F.col("elapsed_sec") * 1_000_000 + 0.5)).cast("decimal(19,0)")
    by = rt.filter("elapsed_sec is not null").groupBy("agent").agg(F.count("elapsed_sec").alias("n"), F.count(micros).alias("whole"), F.sum(micros).alias("s"), F.round(F.avg("elapsed_sec"), 1).alias("plain"))
    tenths = F.expr("cast(sign(s) AS int) * ((2 * abs(s) + n * 100000BD) div (n * 200000BD))").cast("double")
    return by.select("agent", "n", F.when(F.col("whole") == F.col("n"), tenths / 10).otherwise(F.col("plain")).alias("avg_sec"))


def pair_traffic(msgs: DataFrame, sender: str, receiver: str, hub: str) -> DataFrame:
    """Undirected edge counts; a missing end is the hub, loops are left out."""
    a, b = F.coalesce(F.col(sender), F.lit(hub)), F.coalesce(F.col(receiver), F.lit(hub))
    return msgs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def sessionize(msgs: DataFrame, gap: int = 600, tie: str | None = None, closes: Column | None = None) -> DataFrame:
    """Sessions of one channel and user; a pause of ``gap`` seconds or more starts a new one.

    Rows that meet ``closes`` (good ratings) are no messages: they end the
    session before them, so that the next message starts a new one, and
    ``closed`` tells which sessions ended so.
    """
    order = W.partitionBy("channel", "user").orderBy("ts", *([tie] if tie else []))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    if closes is None:
        new = F.coalesce((us - F.lag(us).over(order) >= gap * 1_000_000).cast("int"), F.lit(1))
        marked = msgs.withColumn("new", new).withColumn("no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        return marked.groupBy("channel", "user", "no").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rated = msgs.withColumn("rating", F.coalesce(closes, F.lit(False)))
    # of the rows before: the time of the last message, and whether a rating came after it
    last = F.last(F.when(~F.col("rating"), us), ignorenulls=True).over(before)
    marked = rated.withColumn("new", F.when(F.col("rating"), 0).when((us - last < gap * 1_000_000) & ~F.lag("rating").over(order), 0).otherwise(1))
    marked = marked.withColumn("ends", F.col("rating") & (us - last < gap * 1_000_000))
    marked = marked.withColumn("no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    message = ~F.col("rating")
    sessions = marked.groupBy("channel", "user", "no").agg(
        F.min(F.when(message, F.col("ts"))).alias("start"), F.max(F.when(message, F.col("ts"))).alias("last"), F.count_if(message).alias("n"), F.max("ends").alias("closed")
    )
    return sessions.filter("n > 0")


def session_ids(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session_id", F.format_string("slack-%s-%s-%d", "channel", "user", F.unix_seconds(F.col("start").cast("timestamp"))))


def session_summary(turns: DataFrame) -> DataFrame:
    """Per session: first and last time, first question (80 characters), number of turns, last speaker; the newest first.

    Where there are such columns, also the first user, channel, question_source
    and equipment_type and the last status. Turns without a session are one for
    each time, ``legacy-`` and the time.
    """
    at = F.struct("time", "turn")
    more = [F.min_by(c, at).alias(c) for c in ("user", "channel", "question_source", "equipment_type") if c in turns.columns] + [F.max_by(c, at).alias("last_status") for c in ("status",) if c in turns.columns]
    if dict(turns.dtypes)["session_id"] == "string":
        turns = turns.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.concat(F.lit("legacy-"), F.coalesce(F.col("time").cast("string"), F.lit("")))))
    q = F.min_by("content", F.struct("time", "turn"))
    first = F.when(F.length(q) > 80, F.concat(F.substring(q, 1, 80), F.lit("..."))).otherwise(q)
    return turns.groupBy("session_id").agg(
        F.min("time").alias("first_ts"), F.max("time").alias("last_ts"), first.alias("first_question"), F.count("*").alias("turns"), F.max_by("from", at).alias("last_from"), *more
    ).orderBy(F.desc("last_ts"), "session_id")


def session_detail(turns: DataFrame, session_id: int) -> DataFrame:
    got = turns.filter(F.col("session_id") == session_id).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("time", "turn", "from", "content"))).alias("t"))
    return got.select("session_id", F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["from"], x["content"])), "\n").alias("transcript"))


def transitions(pings: DataFrame, tie: str = "event_id") -> DataFrame:
    """Rows where an agent's state differs from the one before; agents start offline."""
    order = W.partitionBy("agent_id").orderBy("ts", tie)
    return pings.withColumn("before", F.lag("online", 1, False).over(order)).filter("online <> before").drop("before")


def last_activity(log: DataFrame, as_of: str, busy: int = 30) -> DataFrame:
    last = log.groupBy("agent_id").agg(F.max("timestamp").alias("last"), F.max_by("tool_name", F.struct("timestamp", "event_id")).alias("tool_name"))
    return last.withColumn("working", F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) < busy * 1_000_000)


def recent_per_key(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def chat_search(msgs: DataFrame, q: str, offset: int, limit: int) -> DataFrame:
    hit = F.contains(F.lower(F.concat("content", "from")), F.lit(q.lower()))
    return msgs.filter(hit).orderBy(F.desc("time"), F.desc("session_id"), F.desc("turn")).offset(offset).limit(limit)


def message_key(receiver: str | None = None) -> Column:
    """MD5 of sender, receiver and the first 80 characters."""
    ends = ["from", receiver] if receiver else ["from"]
    return F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ends], F.substring("content", 1, 80)))


def message_dedup(msgs: DataFrame, order: list, receiver: str | None = None) -> DataFrame:
    """First message of each ``message_key``."""
    return msgs.withColumn("key", message_key(receiver)).withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("rn = 1").drop("rn")


def merge_messages(existing: DataFrame, new: DataFrame, receiver: str = "to") -> DataFrame:
    """The log (day, id, from, to, content, time) with the new messages that it lacks.

    New ones are numbered from each day's largest id on, in the order of time.
    """
    fresh = message_dedup(new, ["day", "time", "content"], receiver).join(existing.select(message_key(receiver).alias("key")), "key", "left_anti")
    last = existing.groupBy("day").agg(F.max("id").alias("last"))
    place = F.row_number().over(W.partitionBy("day").orderBy("time", "key"))
    numbered = fresh.withColumn("place", place).join(last, "day", "left").withColumn("id", F.coalesce("last", F.lit(0)) + F.col("place"))
    return existing.unionByName(numbered.select(*[F.col(f"`{c}`") for c in existing.columns]))


def with_roster(counts: DataFrame, roster: DataFrame, key: str) -> DataFrame:
    return roster.join(counts, key, "left").na.fill(0)
