"""A query: a function of (spark, folder), the SQL that must agree with it, and its rounded columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: Sequence[str] = ()

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        """Doubles are rounded on both sides: sums of doubles depend on the order of addition."""
        df = self.build(spark, folder)
        return df.withColumns({c: F.round(c, DIGITS) for c in self.doubles}) if self.doubles else df

    def reference_sql(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        rounded = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) AS q"
