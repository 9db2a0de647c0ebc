"""Row totals of the steps of a job, counted in the job's own pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class RowTotals:
    """Call it on the table after each step; read `rows()` once an action has run."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def __call__(self, step: str, df: DataFrame) -> DataFrame:
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        return {step: seen.get["rows"] for step, seen in self._seen.items()}
