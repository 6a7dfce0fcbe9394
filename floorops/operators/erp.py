"""Purchase-history classification and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equipment_types(purchases: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Set of types per item: every type whose keyword occurs in a project name."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules.items()])
    hits = F.transform(F.filter(table, lambda r: F.contains(F.lower("project_name"), r["k"])), lambda r: r["v"])
    return purchases.select("item", F.explode(hits).alias("t")).groupBy("item").agg(F.sort_array(F.collect_set("t")).alias("types"))


def classify_items(purchases: DataFrame, rules: dict[str, str], excluded: set[str]) -> DataFrame:
    """One row per item; an excluded item keeps its row with an empty set."""
    items = purchases.groupBy("item").agg(F.count("*").alias("n_purchases"))
    types = F.array_except(F.coalesce("types", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in sorted(excluded)]))
    return items.join(equipment_types(purchases, rules), "item", "left").select("item", "n_purchases", F.array_join(types, ",").alias("types"), (F.size(types) == 0).alias("excluded"))


def substitute(purchases: DataFrame, as_of: str, excluded: str, years: int = 3) -> DataFrame:
    """Each item's last project; an excluded one gives way to the newest other one of the last years, if any."""
    order = F.struct("order_date", "project_name")
    out = F.contains("project_name", F.lit(excluded))
    recent = F.col("order_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years)
    got = purchases.groupBy("item").agg(F.max_by("project_name", order).alias("last_project"), F.max_by(F.when(~out & recent, F.col("project_name")), F.when(~out & recent, order)).alias("other"))
    return got.select("item", "last_project", F.when(F.contains("last_project", F.lit(excluded)), F.coalesce("other", "last_project")).otherwise(F.col("last_project")).alias("project"))


def cs_only(purchases: DataFrame, as_of: str, mark: str, years: int = 3) -> DataFrame:
    """Items whose last purchase bears the mark and that have no other purchase in the last years."""
    is_cs = F.contains("project_name", F.lit(mark))
    recent = F.col("order_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years)
    got = purchases.groupBy("item").agg(F.max_by(is_cs, F.struct("order_date", "project_name")).alias("last_cs"), F.count_if(~is_cs & recent).alias("others"))
    return got.filter("last_cs and others = 0").select("item")


def dedicated(purchases: DataFrame, mark: str, as_of: str, years: int = 3) -> DataFrame:
    recent = purchases.filter(F.col("order_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years))
    return recent.groupBy("item").agg(F.bool_and(F.contains("project_name", F.lit(mark))).alias("only")).filter("only").select("item")
