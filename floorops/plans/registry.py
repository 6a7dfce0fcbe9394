"""Named SQL over registered views, run with bound parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class QueryRegistry:
    """Queries by name. Values reach Spark as named markers only, never as text of the query."""

    def __init__(self, spark: SparkSession):
        self._spark, self._sql = spark, {}

    def register(self, name: str, sql: str, description: str = "", defaults: dict | None = None) -> None:
        """``defaults``: values of the markers that a run may leave out."""
        self._sql[name] = (sql, description, defaults or {})

    def list(self) -> list[dict]:
        """Name, description and markers of each query."""
        return [{"name": n, "description": d, "params": sorted(set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", q)))} for n, (q, d, _) in sorted(self._sql.items())]

    def run(self, name: str, **params) -> DataFrame:
        if name not in self._sql:
            raise KeyError(f"no query named {name!r}; known: {sorted(self._sql)}")
        sql, _, defaults = self._sql[name]
        return self._spark.sql(sql, args=defaults | params)
