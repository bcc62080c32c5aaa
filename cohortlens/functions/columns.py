"""Column policies: which columns of a cohort table are features. Works on schemas only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.constants import NEVER_FEATURES


@dataclass(frozen=True)
class ColumnPolicy:
    """Columns excluded by exact name or by a (case-sensitive) part of their name."""

    exclude_exact: tuple[str, ...] = NEVER_FEATURES
    exclude_contains: tuple[str, ...] = ()

    def keeps(self, name: str) -> bool:
        return name not in self.exclude_exact and not any(part in name for part in self.exclude_contains)


# The named feature policies.
POLICIES = {
    "with_finish_time": ColumnPolicy(
        NEVER_FEATURES + ("LE_score_off", "LS_score_off"), ("Fixed", "LAcc")),
    "with_finish_time_and_acceleration": ColumnPolicy(
        NEVER_FEATURES + ("LE_score_off", "LS_score_off"), ("Fixed",)),
    "without_finish_time": ColumnPolicy(NEVER_FEATURES, ("完成时间",)),
    "time_before_processing": ColumnPolicy(NEVER_FEATURES, ("完成处理后时间", "提交处理后时间")),
    "predict_offline": ColumnPolicy(
        NEVER_FEATURES + ("offline_grade_label", "班级", "实验成绩_fg", "期末成绩_fg",
                          "grade_to01", "总成绩_fg"),
        ("线下考试相关",)),
    "fusion": ColumnPolicy(NEVER_FEATURES, ("RPI", "LS", "LE")),
    "neural_baseline": ColumnPolicy(NEVER_FEATURES + ("作业总成绩",)),
}


def resolve_features(source: DataFrame, target: DataFrame | None, policy: ColumnPolicy,
                     keep_out: tuple[str, ...] = ()) -> list[str]:
    """Feature names in source order: allowed by the policy and present in the target."""
    shared = set(source.columns if target is None else target.columns)
    return [c for c in source.columns if c in shared and c not in keep_out and policy.keeps(c)]


def finite(column: str | Column) -> Column:
    """The value as a double, NULL where it is NaN or infinite."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """±inf and NaN become NULL, so that averages over the column mean something."""
    return df.withColumns({c: finite(c) for c in columns})


def features_and_label(df: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    return clean_numeric(df.select(*keys, F.col(label).cast("int").alias("label"), *features), features)


def drop_all_missing(df: DataFrame, features: list[str]) -> list[str]:
    """Names of the features that hold a value somewhere (one aggregate, one row)."""
    counts = df.agg(*[F.count(finite(c)).alias(c) for c in features]).first()
    return [c for c in features if counts[c] > 0]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def add_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
