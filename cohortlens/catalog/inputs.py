"""Cohort tables derived from the given tables, in Spark and as SQL.

An order is an entity, its year the cohort (1995-2000 source, 2001 target), and it is positive
when at least three quarters of its lines were returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalars import sigmoid
from cohortlens.operators.folds import assign_folds
from cohortlens.session import stage

SOURCE_YEARS = list(range(1995, 2001))
TARGET_YEAR = 2001
FEATURES = ["qty", "disc", "n_lines"]
PAIR = ["qty", "n_lines"]

# Fixed values: (intercept, weight of n_lines, weight of qty) of three stand-in models.
MODELS = {"a": (0.5, -0.9, 0.004), "b": (-1.5, -0.2, -0.002), "c": (-2.6, 0.01, 0.001)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, cohort, label, qty, disc, tax, n_lines, top_price).

    Lines are combined per order before the join, so the join moves one row per order and
    reuses the aggregate's partitioning.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
        F.count(F.lit(1)).alias("n_lines"), F.max("l_extendedprice").alias("top_price"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("entity_id"), F.year("o_orderdate").alias("cohort"),
        (F.col("returned") >= 0.75).cast("int").alias("label"), "qty", "disc", "tax", "n_lines", "top_price")


FEAT = """feat as (
  select l_orderkey entity_id, cast(year(o_orderdate) as int) cohort, sum(l_quantity) qty, avg(l_discount) disc,
         avg(l_tax) tax, count(*) n_lines, max(l_extendedprice) top_price,
         case when avg(case when l_returnflag = 'R' then 1.0 else 0.0 end) >= 0.75 then 1 else 0 end as label
  from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_orderdate)"""


def source_folds(spark: SparkSession, sf_dir: str, target: bool = False) -> DataFrame:
    """Folded source orders as a staged table; with ``target``, also the target's, fold NULL."""
    feat = stage(orders_with_features(spark, sf_dir))
    folded = assign_folds(feat.where(F.col("cohort") < TARGET_YEAR), SOURCE_YEARS)
    if target:
        folded = folded.unionByName(
            feat.where(F.col("cohort") == TARGET_YEAR).withColumn("fold", F.lit(None).cast("int")))
    return stage(folded)


FOLD = FEAT + """,
fold as (
  select *, cast((cohort - 1995) * 2 + (row_number() over (
           partition by cohort, label order by md5(concat('42:', cast(entity_id as varchar))), entity_id) - 1) % 2
         as int) fold
  from feat where cohort <= 2000)"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scores (entity_id, cohort, label, model_id, p) of the stand-in models over all orders."""
    feat = orders_with_features(spark, sf_dir)
    models = F.array(*[
        F.struct(F.lit(m).alias("model_id"), *[F.lit(v).alias(n) for n, v in zip("abc", w)]) for m, w in MODELS.items()])
    return feat.select("entity_id", "cohort", "label", "n_lines", "qty", F.explode(models).alias("m")).select(
        "entity_id", "cohort", "label", "m.model_id",
        sigmoid(F.col("m.a") + F.col("m.b") * F.col("n_lines") + F.col("m.c") * F.col("qty")).alias("p"))


SCORES = FEAT + """,
models(model_id, a, b, c) as (values """ + ", ".join(
    f"('{m}', {a}::double, {b}::double, {c}::double)" for m, (a, b, c) in MODELS.items()) + """),
scores as (
  select entity_id, cohort, label, model_id, 1 / (1 + exp(-(a + b * n_lines + c * qty))) p from feat, models)"""


def fixed_columns(df: DataFrame, digits: int = 6, **how: int) -> DataFrame:
    """Round every double once, at the output."""
    return df.select(*[
        F.round(f.name, how.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else f.name
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 6) -> str:
    """The SQL of a rounded double; adding 0 turns -0 into 0."""
    return f"(round({expression}, {digits}) + 0)"
