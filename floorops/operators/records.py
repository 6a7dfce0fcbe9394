"""Tasks, usage, CS and quote records: folds, look-ups, clean-up and their reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_tasks(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """Task states after messages (task_id, time, id, kind): the last report decides; ``request`` creates a task; unknown kinds count for nothing.

    Tasks are (task_id, status, completed_at). One shuffle on the task's id.
    """
    status = F.when(F.col("kind") == "complete", "done").when(F.col("kind") == "progress", "in_progress").when(F.col("kind") == "blocked", "blocked")
    known = messages.filter(F.col("kind").isin("complete", "progress", "blocked", "request"))
    last = known.groupBy("task_id").agg(
        F.max_by(F.when(status.isNotNull(), F.struct(status.alias("status"), "time")), F.when(status.isNotNull(), F.struct("time", "id"))).alias("report"),
        F.max((F.col("kind") == "request").cast("int")).alias("made"),
    )
    both = tasks.join(last, "task_id", "full_outer").filter("status IS NOT NULL OR made = 1")
    done = F.when(F.col("report.status") == "done", F.col("report.time")).otherwise(F.col("completed_at"))
    return both.select("task_id", F.coalesce("report.status", "status", F.lit("pending")).alias("status"), done.alias("completed_at"))


def stalled(tasks: DataFrame, as_of: str, minutes: int = 15) -> DataFrame:
    """In-progress tasks whose last update (else creation) is more than ``minutes`` before ``as_of``."""
    idle = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.coalesce("updated_at", "created_at"))
    return tasks.filter((F.col("status") == "in_progress") & (idle > minutes * 60_000_000)).withColumn("idle_hours", F.floor(idle / 3_600_000_000).cast("long"))


def task_summary(tasks: DataFrame, as_of: str, statuses: list[str], minutes: int = 15) -> DataFrame:
    """Tasks by status, active and stalled ones: a line for each agent and one overall, in one pass.

    Stalled are tasks in progress that have not been updated for more than ``minutes``; those without an update are not.
    """
    idle = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("updated_at")
    stalled = F.count_if((F.col("status") == "in_progress") & (idle > minutes * 60_000_000))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    got = tasks.rollup("agent").agg(F.grouping("agent").alias("g"), *counts, F.count_if(F.col("status").isin("pending", "in_progress")).alias("active"), stalled.alias("stalled"), F.count("*").alias("total"))
    return got.select(F.when(F.col("g") == 1, "all").otherwise(F.col("agent")).alias("agent"), *statuses, "active", "stalled", "total")


def task_status(tasks: DataFrame) -> DataFrame:
    """Per agent: pending and in-progress tasks, and both together."""
    pending, busy = F.count_if(F.col("status") == "pending"), F.count_if(F.col("status") == "in_progress")
    return tasks.groupBy("agent").agg(pending.alias("pending"), busy.alias("in_progress"), (pending + busy).alias("active"), F.count("*").alias("total"))


def duplicate_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks after the first with the same agent and first 40 characters of the name."""
    w = W.partitionBy("agent", F.substring("name", 1, 40)).orderBy("task_id")
    return tasks.filter("status = 'pending'").withColumn("rn", F.row_number().over(w)).filter("rn > 1").select("task_id", "agent", "name")


def done_by_agent(tasks: DataFrame, day: str, n: int = 5) -> DataFrame:
    """Tasks done on a day per agent: the first ``n`` names and how many more; only ``n`` names a group are gathered."""
    w = W.partitionBy("agent").orderBy("name", "task_id")
    rows = tasks.filter((F.col("status") == "done") & (F.to_date("completed_at") == F.lit(day).cast("date"))).withColumn("rn", F.row_number().over(w))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= n, F.struct("rn", "name")))), lambda x: x["name"]), ", ")
    return rows.groupBy("agent").agg(F.count("*").alias("n"), names.alias("names"), F.greatest(F.count("*") - n, F.lit(0)).alias("more"))


def dedup_usage(usage: DataFrame, tie: str, keep_missing: bool = False) -> DataFrame:
    """One record per request: the one of most output tokens, the earliest of equals.

    Records without a request are one request together; ``keep_missing`` keeps each of them.
    """
    w = W.partitionBy(F.coalesce("request_id", F.lit("")) if dict(usage.dtypes)["request_id"] == "string" else "request_id").orderBy(F.desc("output_tokens"), tie)
    if not keep_missing:
        return usage.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    missing = F.coalesce(F.col("request_id").cast("string"), F.lit("")) == ""
    named = usage.filter(~missing).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return named.unionByName(usage.filter(missing))


def token_usage(usage: DataFrame, as_of: str, prices: Mapping[str, float], limit: int, tz: str, tie: str) -> DataFrame:
    """Tokens and cost of the local day and of its Monday-Sunday week, and the week's share of the limit."""
    once = dedup_usage(usage, tie)
    day = F.from_utc_timestamp("ts", tz).cast("date")
    today = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), tz).cast("date")
    week = F.date_trunc("week", day) == F.date_trunc("week", today)
    tokens = F.col("input_tokens") + F.col("output_tokens")
    cost = F.col("input_tokens") * F.lit(prices["input"]) + F.col("output_tokens") * F.lit(prices["output"])
    out = once.agg(
        F.coalesce(F.sum(F.when(day == today, tokens)), F.lit(0)).alias("day_tokens"),
        F.round(F.coalesce(F.sum(F.when(day == today, cost)), F.lit(0.0)), 4).alias("day_cost"),
        F.coalesce(F.sum(F.when(week, tokens)), F.lit(0)).alias("week_tokens"),
        F.count_if(week).alias("requests"),
    )
    return out.withColumn("share", F.round(F.col("week_tokens") / F.lit(float(limit)), 4))


def channel_summary(chat: DataFrame) -> DataFrame:
    return chat.groupBy("channel_id", "channel_name").agg(F.count("*").alias("messages"), F.sum(F.coalesce(F.size("files"), F.lit(0)).cast("long")).alias("attachments"))


def cs_backlog(history: DataFrame, as_of: str) -> DataFrame:
    """Open CS cases by region, handler and age: cases, those over 30 days, the oldest."""
    age = F.datediff(F.lit(as_of).cast("date"), "received_at")
    return history.filter("closed_at IS NULL").groupBy("region", "handler").agg(F.count("*").alias("open"), F.count_if(age > 30).alias("over_30"), F.max(age).alias("oldest"))


def zero_stock(items: DataFrame) -> DataFrame:
    """Items without good stock, by their code."""
    return items.filter("good_qty = 0").orderBy("item_cd")


def backlog_report(history: DataFrame, stock: DataFrame, as_of: str) -> DataFrame:
    """The lines of ``cs_backlog``, and beside them a line (region ``stock``, handler null) with the number of items that are out of stock."""
    cases = cs_backlog(history, as_of).select(F.col("region").cast("string").alias("region"), F.col("handler").cast("string").alias("handler"), "open", "over_30", "oldest")
    empty = stock.agg(F.count_if(F.col("good_qty") == 0).alias("open"))
    return cases.unionByName(empty.select(F.lit("stock").alias("region"), "open"), allowMissingColumns=True)


def price_history(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """Quote lines with a price under a dated header, with their margin."""
    margin = F.round((F.col("price") - F.col("cost")) / F.col("price") * 100, 2) + 0.0
    return items.filter("price > 0").join(quotes.filter("quoted_at IS NOT NULL"), "quote_id").select("quote_id", "item", F.to_date("quoted_at").alias("quoted_on"), "price", margin.alias("margin"))


def new_only(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not seen, one for each key."""
    return new.join(seen.select(*keys), keys, "left_anti").dropDuplicates(keys)


def load_stats(new: DataFrame, known: DataFrame, keys: list[str], items: str) -> DataFrame:
    """How many rows an insert-or-skip load takes and leaves, and the items of those taken."""
    total = new.agg(F.count("*").alias("total"))
    taken = new_only(new, known, keys).agg(F.count("*").alias("ok"), F.coalesce(F.sum(items), F.lit(0)).alias("items"))
    return total.join(taken, F.lit(True)).select("ok", (F.col("total") - F.col("ok")).alias("skipped"), "items")


def route_channels(chat: DataFrame, projects: DataFrame, key: str, prefixes: list[tuple[str, str]], exact: Mapping[str, str], default: str) -> DataFrame:
    """Agent of each row: its project's, else the first prefix rule's of its channel, else the channel's own, else the default."""
    c = F.col("channel")
    rules = [F.when(c.startswith(p), F.lit(a)) for p, a in prefixes] + [F.when(c == k, F.lit(a)) for k, a in exact.items()]
    return chat.join(projects.select(key, F.col("agent").alias("by_project")), key, "left").withColumn("agent", F.coalesce("by_project", *rules, F.lit(default))).drop("by_project")


def longer_answer(logged: DataFrame, full: DataFrame, key: list[str]) -> DataFrame:
    """The full answer where it is longer than the logged one."""
    joined = logged.join(full.select(*key, F.col("answer").alias("full")), key, "left")
    return joined.withColumn("answer", F.when(F.coalesce(F.char_length("answer"), F.lit(0)) < F.char_length("full"), F.col("full")).otherwise(F.col("answer"))).drop("full")


def lookup(rows: DataFrame, table: DataFrame, key: list[str], value: str, default=None, order: list | None = None) -> DataFrame:
    """``rows`` with a value looked up by key, the first of ``order`` where the table repeats a key; ``default`` where it has none."""
    table = table.select(*key, value, *(order or []))
    if order:
        table = table.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("rn = 1")
    out = rows.join(table.select(*key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def ordered_distinct(df: DataFrame, col: str, pos: str, drop: Column) -> DataFrame:
    """Distinct values with their first position, automatic ones dropped."""
    return df.filter(~drop).groupBy(col).agg(F.min(pos).alias("first"))


def purge(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that no rule deletes, and how many rows each rule hits. A rule that is null hits nothing."""
    hit = {k: F.coalesce(r, F.lit(False)) for k, r in rules.items()}
    kept = df
    for r in hit.values():
        kept = kept.filter(~r)
    counts = df.agg(*[F.count_if(r).alias(k) for k, r in hit.items()])
    return kept, counts.select(F.stack(F.lit(len(hit)), *[x for k in hit for x in (F.lit(k), F.col(k))]).alias("rule", "n"))


def union_tagged(tables: Mapping[str, DataFrame], tag: str = "corpus") -> DataFrame:
    """Union of tables with the name of each; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merge_graph(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.unionByName(b).dropDuplicates([key])


def label_counts(nodes: DataFrame) -> DataFrame:
    """How many nodes have each of their ``labels``."""
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def rated(answers: DataFrame, rating: str, good: str) -> DataFrame:
    """The answers that were rated as ``good``."""
    return answers.filter(F.col(rating) == good)
