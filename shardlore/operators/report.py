"""A report: a named bag of results that grows, its summary, and its table as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import measure


class Report:
    """results has the columns of measure.RESULT. add and extend append, with repeated rows kept."""

    def __init__(self, spark: SparkSession, name: str, results: DataFrame | None = None):
        self.spark, self.name = spark, name
        self.results = spark.createDataFrame([], measure.RESULT) if results is None else results

    def extend(self, results: DataFrame | list) -> Report:
        """results: rows as a DataFrame, or as tuples or dicts in a list, of which there are as many as runs."""
        more = results if isinstance(results, DataFrame) else self.spark.createDataFrame(results, measure.RESULT)
        self.results = self.results.unionByName(more, allowMissingColumns=True)
        return self

    def add(self, result: tuple | dict) -> Report:
        return self.extend([result])

    def successes(self) -> DataFrame:
        return self.results.where(measure.ok())

    def failures(self) -> DataFrame:
        return self.results.where(~measure.ok())

    def success_rate(self) -> float:
        return measure.success_rate(self.results).first()["success_rate"]

    def summary(self) -> str:
        r = measure.success_rate(self.results).first()
        lines = [f"{self.name}: {r['successes']} of {r['total']} runs succeeded"]
        for s in measure.cell_stats(self.results).orderBy("model", "format", "median_ms", "backend").toLocalIterator():
            lines.append(f"{s['model']} {s['format']} {s['backend']}: median {s['median_ms']:.2f} ms, {s['min_ms']:.2f} to {s['max_ms']:.2f}, {s['n']} runs")
        return "\n".join(lines)

    def write_tsv(self, path: str, anchor: bool = False) -> None:
        measure.write_tsv(self.results, path, anchor)
