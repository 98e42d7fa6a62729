"""SQL over sources, and saved views: virtual or written as Parquet."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from eventlens.plans.steps import Sources, run_steps
from eventlens.session import scratch_path


def register_sources(sources: Sources) -> None:
    for name, df in sources.items():
        df.createOrReplaceTempView(name)


def select_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """One SELECT over registered sources; values travel as parameters.

    The text must also be valid as a subquery, which no command and no second
    statement is; Spark's own parser decides, before anything runs.
    """
    body = text.rstrip().rstrip(";")
    if not re.match(r"\s*(select|with)\b", body, re.IGNORECASE):
        raise ValueError("only a single SELECT is allowed")
    try:
        spark.sql(f"SELECT 1 FROM (\n{body}\n) LIMIT 0", args=dict(args or {}))
    except ParseException as error:
        raise ValueError("only a single SELECT is allowed") from error
    return spark.sql(body, args=dict(args or {}))


class Views:
    """Named step lists. Virtual ones run again on each read; materialized ones
    are Parquet until refreshed. Either kind can be a source of later steps."""

    def __init__(self, spark: SparkSession, sources: Sources):
        self.spark = spark
        self.sources = dict(sources)
        self.plans: dict[str, Sequence[Mapping]] = {}
        self.paths: dict[str, str] = {}

    def create(self, name: str, plan: Sequence[Mapping], materialized: bool = False) -> DataFrame:
        self.plans[name] = plan
        if materialized:
            return self.refresh(name)
        return self._publish(name, run_steps(plan, self.sources))

    def refresh(self, name: str) -> DataFrame:
        """Write anew beside the old files, then switch readers over."""
        path = scratch_path(self.spark, f"view-{name}")
        run_steps(self.plans[name], self.sources).write.parquet(path)
        self.paths[name] = path
        return self._publish(name, self.spark.read.parquet(path))

    def _publish(self, name: str, df: DataFrame) -> DataFrame:
        self.sources[name] = df
        df.createOrReplaceTempView(name)
        return df

    def lineage(self, name: str) -> list[str]:
        """Source tables a view rests on, through other views."""
        seen: list[str] = []
        for step in self.plans[name]:
            config = step.get("config", {})
            names = [config.get("table"), *config.get("tables", [])]
            for table in (n for n in names if n):
                seen += self.lineage(table) if table in self.plans else [table]
        return sorted(set(seen))
