"""Single trees of every growth rule over the source orders, node by node, and attributions of their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.catalog import query
from cohortlens.catalog.inputs import FEAT, FEATURES, fixed_columns, orders_with_features, r
from cohortlens.operators.attribution import expected_value, tree_attribution
from cohortlens.operators.extra_trees import fit_extra_trees
from cohortlens.operators.histogram_trees import BoostedTrees, Growth, fit_boosted

# The cuts that both sides try.
CUTS = {"qty": [25.0 * i for i in range(1, 12)], "disc": [0.0213, 0.0337, 0.0479, 0.0611, 0.0743], "n_lines": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}
LEVEL = Growth(rounds=1, max_depth=2, reg_lambda=1.0, reg_alpha=2.0, min_hessian=3.0, learning_rate=0.3, base_score=0.5)
LEAF = Growth(rounds=1, shape="leaf", max_depth=None, max_leaves=4, reg_lambda=0.5, min_rows=20, learning_rate=0.1, base_score=0.5)
SYMMETRIC = Growth(rounds=1, shape="symmetric", max_depth=2, reg_lambda=3.0, learning_rate=0.03, base_score=0.5)


def _fitted(spark: SparkSession, sf_dir: str, growth: Growth) -> tuple[DataFrame, BoostedTrees]:
    rows = orders_with_features(spark, sf_dir).where("cohort <= 2000")
    return rows, fit_boosted(rows, FEATURES, growth=growth, cuts=CUTS)


def _nodes(spark: SparkSession, sf_dir: str, growth: Growth) -> DataFrame:
    return fixed_columns(_fitted(spark, sf_dir, growth)[1].nodes(spark).drop("tree"))


# at the start every score is a half: gradient 0.5 - label, hessian 0.25, sums of which are exact
_ROWS = FEAT + """,
cuts(o, feature, cut) as (values """ + ", ".join(
    f"({i}, '{f}', {c!r}::double)" for i, f in enumerate(FEATURES) for c in CUTS[f]) + """),
rows0 as (select entity_id, qty, disc, n_lines, 0.5::double - label g, 0.25::double h, '' path from feat where cohort <= 2000)"""
_GOES = "case case b.feature when 'qty' then qty when 'disc' then disc else n_lines end <= b.cut when true then 'L' else 'R' end"


def _worth(g: str, h: str, growth: Growth) -> str:
    return f"power(greatest(abs({g}) - {growth.reg_alpha!r}::double, 0), 2) / ({h} + {growth.reg_lambda!r}::double)"


def _tried(rows: str, name: str, growth: Growth) -> str:
    """Every possible split of every node of ``rows`` with its gain."""
    return f"""{name} as (select *, {_worth('gl', 'hl', growth)} + {_worth('g - gl', 'h - hl', growth)} - {_worth('g', 'h', growth)} gain from (
  select path, o, feature, cut, sum(g) g, sum(h) h, count(*) n, sum(case when v <= cut then g else 0 end) gl,
    sum(case when v <= cut then h else 0 end) hl, count(*) filter (v <= cut) nl
  from (select r.path, c.*, r.g, r.h, case c.feature when 'qty' then qty when 'disc' then disc else n_lines end v from {rows} r, cuts c)
  group by path, o, feature, cut)
  where least(nl, n - nl) >= {max(growth.min_rows, 1)} and least(hl, h - hl) >= {growth.min_hessian!r})"""


def _best(tried: str, name: str) -> str:
    return f"""{name} as (select path, feature, cut, gain from {tried} where gain > 0
  qualify row_number() over (partition by path order by round(gain, 9) desc, o, cut) = 1)"""


def _split(rows: str, best: str, name: str) -> str:
    return f"{name} as (select r.* exclude (path), r.path || {_GOES} path from {rows} r join {best} b on r.path = b.path)"


def _result(rows: list[str], best: str, growth: Growth) -> str:
    every = " union all ".join(f"select path, g, h from {x}" for x in rows)
    return f"""select n.path, feature, {r('cut')} cut, {r('gain')} gain, n_rows,
  {r(f"-sign(g) * greatest(abs(g) - {growth.reg_alpha!r}::double, 0) / (h + {growth.reg_lambda!r}::double) * {growth.learning_rate!r}::double")} as "value"
from (select path, sum(g) g, sum(h) h, count(*) n_rows from ({every}) group by path) n left join {best} b on n.path = b.path"""


_LEVELS = f"{_ROWS}, {_tried('rows0', 't0', LEVEL)}, {_best('t0', 'b0')}, {_split('rows0', 'b0', 'rows1')}, {_tried('rows1', 't1', LEVEL)}, {_best('t1', 'b1')}, {_split('rows1', 'b1', 'rows2')}, both_ as (from b0 union all from b1)"


@query(f"with {_LEVELS} {_result(['rows0', 'rows1', 'rows2'], 'both_', LEVEL)}")
def boosted_tree_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level-wise tree with penalties on leaves and a least hessian per child."""
    return _nodes(spark, sf_dir, LEVEL)


@query(f"""with {_ROWS}, {_tried('rows0', 't0', LEAF)}, {_best('t0', 'b0')}, {_split('rows0', 'b0', 'rows1')},
{_tried('rows1', 't1', LEAF)}, {_best('t1', 'b1')}, first_ as (from b1 order by gain desc, path limit 1),
{_split('rows1', 'first_', 'rows2')}, {_tried('rows2', 't2', LEAF)}, {_best('t2', 'b2')},
open_ as (select * from b1 where path not in (select path from first_) union all select * from b2),
second_ as (from open_ order by gain desc, length(path), path limit 1), done as (from rows1 union all from rows2),
{_split('done', 'second_', 'rows3')}, kept as (from b0 union all from first_ union all from second_)
{_result(['rows0', 'rows1', 'rows2', 'rows3'], 'kept', LEAF)}""")
def boosted_tree_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A best-first tree of four leaves."""
    return _nodes(spark, sf_dir, LEAF)


@query(f"""with {_ROWS}, {_tried('rows0', 't0', SYMMETRIC)}, {_best('t0', 'b0')}, {_split('rows0', 'b0', 'rows1')},
{_tried('rows1', 't1', SYMMETRIC)}, shared as (select feature, cut from t1 group by o, feature, cut having sum(gain) > 0 order by round(sum(gain), 9) desc, o, cut limit 1),
b1 as (select path, feature, cut, gain from t1 join shared using (feature, cut)), {_split('rows1', 'b1', 'rows2')},
both_ as (from b0 union all from b1) {_result(['rows0', 'rows1', 'rows2'], 'both_', SYMMETRIC)}""")
def boosted_tree_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with one split for all nodes of a level."""
    return _nodes(spark, sf_dir, SYMMETRIC)


@query(f"""with {_LEVELS}, leaves as ({_result(['rows0', 'rows1', 'rows2'], 'both_', LEVEL)}),
last_ as (select entity_id, max_by(path, length(path)) path from (select entity_id, path from rows0 union all
  select entity_id, path from rows1 union all select entity_id, path from rows2) group by entity_id)
select entity_id, {r('"value"', 5)} as margin from last_ join leaves using (path)""")
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The margin of every row as its attributions and the expected margin add up to it."""
    rows, model = _fitted(spark, sf_dir, LEVEL)
    start = expected_value(model.paths()) + model.base
    phi = tree_attribution(rows, model, FEATURES).groupBy("entity_id").agg(F.sum("phi").alias("phi"))
    return fixed_columns(phi.select("entity_id", (F.col("phi") + F.lit(start)).alias("margin")), 5)


# --- extremely randomised trees -------------------------------------------------------------

RANDOM = dict(n_trees=3, max_depth=2, min_leaf=20, max_features=0.7, seed=42)
_VALUE = "case feature when 'qty' then qty when 'disc' then disc else n_lines end"


def _drawn(rows: str, name: str) -> str:
    """The best drawn cut of every node of ``rows``: two of three features, one cut each, by md5."""
    return f"""{name}_n as (select tree, path, feature, min(v) lo, max(v) hi, count(*) n, sum(label) p
  from (select tree, path, label, feature, {_VALUE} v from {rows}, (values ('qty'), ('disc'), ('n_lines')) f(feature)) group by tree, path, feature),
{name}_c as (select *, lo + ('0x' || substr(md5(concat_ws(':', 42, tree, path, feature)), 1, 8))::bigint / 4294967296.0::double * (hi - lo) cut
  from (select *, row_number() over (partition by tree, path order by md5(concat_ws(':', 42, 'pick', tree, path, feature))) k from {name}_n)
  where k <= 2 and lo < hi and n >= 40 and p > 0 and p < n),
{name}_s as (select c.tree, c.path, c.feature, cut, n::double n, p::double p, sum(case when {_VALUE} <= cut then 1 else 0 end)::double nl,
    sum(case when {_VALUE} <= cut then label else 0 end)::double pl
  from {name}_c c join {rows} r on c.tree = r.tree and c.path = r.path group by c.tree, c.path, c.feature, cut, n, p),
{name} as (select tree, path, feature, cut, gain from (select *, (pl * pl + (nl - pl) * (nl - pl)) / nl
    + ((p - pl) * (p - pl) + (n - nl - p + pl) * (n - nl - p + pl)) / (n - nl) - (p * p + (n - p) * (n - p)) / n gain
  from {name}_s where least(nl, n - nl) >= 20)
  qualify row_number() over (partition by tree, path order by round(gain, 9) desc, case feature when 'qty' then 0 when 'disc' then 1 else 2 end) = 1)"""


def _dealt(rows: str, best: str, name: str) -> str:
    return f"""{name} as (select r.* exclude (path), r.path || case when {_VALUE} <= cut then 'L' else 'R' end path
  from {rows} r join {best} b on r.tree = b.tree and r.path = b.path)"""


@query(f"""with {FEAT}, e0 as (select t.tree, '' path, entity_id, qty, disc, n_lines, label from feat, (values (0), (1), (2)) t(tree) where cohort <= 2000),
{_drawn('e0', 'd0')}, {_dealt('e0', 'd0', 'e1')}, {_drawn('e1', 'd1')}, {_dealt('e1', 'd1', 'e2')}
select n.tree, n.path, feature, {r('cut')} cut, {r('gain')} gain, n_rows, {r('"value"')} as "value"
from (select tree, path, count(*) n_rows, avg(label) as "value" from (select tree, path, label from e0 union all select tree, path, label from e1
  union all select tree, path, label from e2) group by tree, path) n left join (from d0 union all from d1) b on n.tree = b.tree and n.path = b.path""")
def extra_trees_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extremely randomised trees, node by node, with the cuts that were drawn."""
    rows = orders_with_features(spark, sf_dir).where("cohort <= 2000")
    return fixed_columns(fit_extra_trees(rows, FEATURES, **RANDOM).nodes(spark))
