"""Sinks: result tables as parquet folders, small reports as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_importance(importance: DataFrame, path: str, by: str = "model_id") -> None:
    """All models in one table, one folder per model."""
    importance.write.mode("overwrite").partitionBy(by).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows (best trials, metrics) as one CSV with a header."""
    flat = _flatten(report)
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _flatten(report: DataFrame) -> DataFrame:
    nested = ("map", "array", "struct")
    return report.selectExpr(*[
        f"to_json(`{f.name}`) as `{f.name}`" if f.dataType.typeName() in nested else f"`{f.name}`"
        for f in report.schema.fields
    ])
