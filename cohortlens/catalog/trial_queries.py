"""Trial tables: ranking, selection, decoding of parameter cells. The trials are derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.catalog import query
from cohortlens.catalog.inputs import fixed_columns, r, table
from cohortlens.functions.scalars import base_name, decode_param, merge_params
from cohortlens.plans.search import best_per_model
from cohortlens.sources.trials import decode_params as decode_table
from cohortlens.sources.trials import rank_trials, select_by_keyword, select_trials, valid_trials


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per (line number, supplier): the line number is the model, the supplier the trial."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(
        F.avg("l_tax").alias("value"), F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"),
        F.min("l_returnflag").alias("flag"))
    number = F.col("l_linenumber")
    name = F.concat(F.when(number <= 3, "LightGBM").when(number <= 5, "XGBoost").otherwise("HGB"), number.cast("string"))
    return lines.select(
        name.alias("model_type"), F.col("l_suppkey").cast("int").alias("trial_id"),
        F.when(F.col("n") > 2, F.round("value", 8)).alias("value"), "q", "n", "flag")


TRIALS = """l as (select l_linenumber, l_suppkey, round(avg(l_tax), 8) value, cast(sum(l_quantity) as bigint) q, count(*) n, min(l_returnflag) flag
  from lineitem group by 1, 2),
trials as (select (case when l_linenumber <= 3 then 'LightGBM' when l_linenumber <= 5 then 'XGBoost' else 'HGB' end) || l_linenumber model_type,
  cast(l_suppkey as int) trial_id, case when n > 2 then value end as value, q, n, flag from l)"""


@query(f"""with {TRIALS}, k as (select model_type, trial_id, value, row_number() over (partition by model_type order by value desc, trial_id) - 1 as rank
  from trials where value is not null)
select model_type, trial_id, {r('value')} as value, cast(rank as int) as rank from k where rank < 50""")
def top_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 50 finished trials of each model; failed ones have no value and no rank."""
    ranked = rank_trials(_trials(spark, sf_dir).select("model_type", "trial_id", "value"), top=K.BASE_TOP)
    return fixed_columns(ranked)


@query(f"""with {TRIALS}, k as (select regexp_replace(model_type, '[0-9]', '', 'g') family, *,
  row_number() over (partition by regexp_replace(model_type, '[0-9]', '', 'g') order by value desc, model_type, trial_id) - 1 as rank
  from trials where value > 0.03)
select family, model_type, trial_id, {r('value')} as value, cast(rank as int) as rank from k where rank in (0, 2, 7)""")
def selected_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials by ordinal within the model family (the model name without its digits)."""
    trials = valid_trials(_trials(spark, sf_dir), above=0.03).withColumn("family", base_name("model_type"))
    keyed = trials.withColumn("tie", F.struct("model_type", "trial_id"))
    ranked = rank_trials(keyed, ["family"], tie="tie", top=8)
    return fixed_columns(select_trials(ranked, [0, 2, 7]).select("family", "model_type", "trial_id", "value", "rank"))


@query(f"""with {TRIALS} select model_type, trial_id, q from trials where regexp_matches(model_type, '(?i)xgb') order by q desc, model_type, trial_id limit 1 offset 3""")
def trial_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth trial whose model name matches a keyword, whatever its case."""
    trials = _trials(spark, sf_dir).withColumn("order", -F.col("q"))
    return select_by_keyword(trials, "xgb", 3, order=["order", "model_type", "trial_id"]).select("model_type", "trial_id", "q")


@query(f"""with {TRIALS} select model_type, max(value) as value, arg_min(trial_id, (-value, trial_id)) trial_id, cast(count(value) as bigint) n_finished
from trials where value is not null group by model_type""".replace("max(value) as value", f"{r('max(value)')} as value"))
def best_trial_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = valid_trials(_trials(spark, sf_dir))
    counts = trials.groupBy("model_type").agg(F.count("value").alias("n_finished"))
    best = best_per_model(rank_trials(trials, top=1)).select("model_type", "value", "trial_id")
    return fixed_columns(best.join(counts, "model_type"))


# --- decoding -----------------------------------------------------------------------------

NAMES = ("n_estimators", "max_depth", "bootstrap", "learning_rate", "random_state", "C", "criterion")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter cells as text, of every kind that occurs in trial tables, one per order line."""
    lines = table(spark, sf_dir, "lineitem")
    number = F.col("l_quantity").cast("int").cast("string")
    flag = F.col("l_returnflag")
    cell = (
        F.when(flag == "A", F.concat(number, F.lit(".75")))
        .when((flag == "N") & (F.col("l_linenumber") == 1), "None")
        .when((flag == "N") & (F.col("l_linenumber") == 2), "TRUE")
        .when((flag == "N") & (F.col("l_linenumber") == 3), "no")
        .when((flag == "N") & (F.col("l_linenumber") == 4), "abc")
        .when((flag == "N") & (F.col("l_linenumber") == 5), "0")
        .when((flag == "N") & (F.col("l_linenumber") == 6), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("-"), number, F.lit(".5")))
    )
    return lines.select("l_orderkey", "l_linenumber", F.explode(F.array(*map(F.lit, NAMES))).alias("param"), cell.alias("cell"))


CELLS = """cells as (select param, case when l_returnflag = 'A' then cast(l_quantity as int)::varchar || '.75'
  when l_returnflag = 'N' and l_linenumber = 1 then 'None' when l_returnflag = 'N' and l_linenumber = 2 then 'TRUE'
  when l_returnflag = 'N' and l_linenumber = 3 then 'no' when l_returnflag = 'N' and l_linenumber = 4 then 'abc'
  when l_returnflag = 'N' and l_linenumber = 5 then '0' when l_returnflag = 'N' and l_linenumber = 6 then null
  else '-' || cast(l_quantity as int)::varchar || '.5' end cell
  from lineitem, (select unnest([""" + ", ".join(f"'{n}'" for n in NAMES) + """]) param))"""


def _decode_sql(lenient: bool) -> str:
    ints = "'n_estimators', 'max_depth'" + (", 'random_state'" if lenient else "")
    floats = "'learning_rate'" + (", 'C'" if lenient else "")
    return f"""with {CELLS}, d as (select *, try_cast(cell as double) num, lower(cell) low,
  case when cell is null or lower(cell) in ('none', 'nan') then 'null' when param in ({ints}) then 'int'
    when param = 'bootstrap' then 'bool' when param in ({floats}) then 'float' else 'str' end wanted from cells),
v as (select param, case when wanted = 'null' then 'null'
    when wanted = 'int' and num is null or wanted = 'float' and num is null
      or wanted = 'bool' and num is null and low not in ('true', 'yes', 'false', 'no') then {"'str'" if lenient else "'null'"}
    else wanted end kind, cast(trunc(num) as bigint) i, num d,
    case when low in ('true', 'yes') then true when low in ('false', 'no') then false else num <> 0 end b, cell from d)
select param, kind, case when kind = 'int' then i end i, case when kind = 'float' then d end d, case when kind = 'bool' then b end b,
  case when kind = 'str' then cell end s, count(*) n from v group by all"""


def _decoded(spark: SparkSession, sf_dir: str, lenient: bool) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("v", decode_param("param", "cell", lenient))
    flat = cells.select("param", "v.*").withColumn("kind", F.coalesce("kind", F.lit("null")))
    return flat.groupBy("param", "kind", "i", "d", "b", "s").agg(F.count(F.lit(1)).alias("n"))


@query(_decode_sql(False))
def decode_params_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, False)


@query(_decode_sql(True))
def decode_params_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, True)


@query(f"""with {TRIALS}, m as (select model_type, trial_id, unnest(['n_estimators', 'learning_rate', 'min_child_weight', 'random_state']) param,
  unnest([q::varchar, '0.1', n::varchar, case when flag = 'A' then '7' else '42' end]) cell from trials)
select model_type, trial_id, param, case param when 'learning_rate' then 'float' when 'random_state' then 'str' else 'int' end kind,
  case when param in ('n_estimators', 'min_child_weight') then cell::bigint end i,
  case when param = 'learning_rate' then 0.1::double end d, null::boolean b, case when param = 'random_state' then cell end s from m""")
def trial_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and tuned parameters merged, metric columns left out, one typed row per parameter."""
    text = lambda c: F.col(c).cast("string")
    tuned = F.create_map(
        F.lit("n_estimators"), text("q"), F.lit("min_child_weight"), text("n"), F.lit("ACC"), text("value"),
        F.lit("Top1_Contrib(%)"), text("n"), F.lit("Weighted_Score"), text("value"))
    own = F.when(F.col("flag") == "A", F.map_concat(tuned, F.create_map(F.lit("random_state"), F.lit("7")))).otherwise(tuned)
    fixed = F.create_map(F.lit("learning_rate"), F.lit("0.1"), F.lit("random_state"), F.lit("42"))
    trials = _trials(spark, sf_dir).withColumn("params", merge_params(fixed, own))
    return decode_table(trials, ["model_type", "trial_id"])
