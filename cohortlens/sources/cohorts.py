"""Cohort tables: one file or folder per cohort, joined into one DataFrame."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingLabel(ValueError):
    """A cohort table has no label column."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One cohort table. CSV needs a header; give a schema to spare the inference pass."""
    if re.search(r"\.csv(\.\w+)?/?$", path):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


def load_cohorts(
    spark: SparkSession, sources: Mapping[int, str] | Sequence[str], target: tuple[int, str] | str,
    label: str, schema: T.StructType | str | None = None, skip_missing: bool = True,
) -> DataFrame:
    """Union of the source cohorts and the target, with ``cohort``, ``cohort_index`` and ``split``.

    A source that does not exist is skipped but keeps its index, so the fold numbers of later
    cohorts do not move. Columns are matched by name; a cohort without a column has NULLs.
    """
    named = dict(sources) if isinstance(sources, Mapping) else dict(enumerate(sources))
    target_key, target_path = target if isinstance(target, tuple) else (len(named), target)
    if target_key in named or target_path in named.values():
        raise ValueError("the target cohort must not be among the source cohorts")
    parts = []
    for index, (cohort, path) in enumerate(named.items()):
        try:
            part = read_table(spark, path, schema)
        except AnalysisException as problem:
            if skip_missing and problem.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        parts.append(_tag(part, cohort, index, "source", label, path))
    goal = read_table(spark, target_path, schema)
    parts.append(_tag(goal, target_key, len(named), "target", label, target_path))
    return union_by_name(parts)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union; columns by name, missing ones NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _tag(df: DataFrame, cohort: int, index: int, split: str, label: str, path: str) -> DataFrame:
    if label not in df.columns:
        raise MissingLabel(f"{path}: no column {label!r}")
    return df.withColumns({
        "cohort": F.lit(cohort), "cohort_index": F.lit(index), "split": F.lit(split),
    })
