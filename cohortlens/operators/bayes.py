"""Naive Bayes in closed form: every fold and every candidate from one scan of statistics."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.columns import add_all
from cohortlens.functions.scalars import sigmoid
from cohortlens.operators.preprocess import FULL, Moments, fold_moments, join_per_fold, long_form, merge

TWO_PI = 6.283185307179586


@dataclass(frozen=True)
class BayesModel:
    """Fitted parameters, one row per (left-out fold, candidate), and the per-feature log ratio."""

    rows: list[tuple]
    schema: str
    features: tuple[str, ...]
    log_ratio: Callable[[str, int], Column]

    def score(self, df: DataFrame, fold: str = "fold") -> DataFrame:
        """Add trial_id and p: out-of-fold where the row has a fold, else by the full model."""
        joined = join_per_fold(df, self.rows, self.schema, fold)
        p = sigmoid(F.col("_prior") + add_all([self.log_ratio(f, i) for i, f in enumerate(self.features)]))
        return joined.withColumn("p", p).drop("_prior", "_fill", "_cut", "_c0", "_c1")


#: Share of the largest variance that a variance of 0 becomes.
LEAST_SMOOTHING = 1e-9


def fit_gaussian_nb(df: DataFrame, features: Sequence[str], candidates: Mapping[int, float] | None = None,
                    fold: str = "fold", label: str = "label", standardise: bool = False,
                    stats: Mapping[int, Mapping[tuple, Moments]] | None = None) -> BayesModel:
    """``candidates`` map trial ids to ``var_smoothing``: that share of the largest feature
    variance is added to each variance. Missing values count as the training mean.

    ``standardise`` fits as on features z-scored with the training statistics of each fold.
    Densities do not change under scaling, so only the smoothing does: it becomes a share of
    each feature's own variance (of 1 for a constant feature, which scaling leaves as it is).
    ``stats`` are the moments per left-out fold, label and feature, where they are known.
    """
    rows = []
    for left_out, found in (stats or fold_moments(df, features, fold, label)).items():
        own = {(y, f): found.get((y, f), Moments()) for y in (0, 1) for f in features}
        seen = [own[(y, features[0])].rows for y in (0, 1)]
        if not sum(seen):
            continue  # the only fold there is
        fill = {f: merge(own[(y, f)] for y in (0, 1)).mean for f in features}
        whole = {key: m.filled(fill[key[1]]) for key, m in own.items()}
        overall = {f: merge(whole[(y, f)] for y in (0, 1)).variance for f in features}
        if standardise:
            overall = {f: v or 1.0 for f, v in overall.items()}
        else:
            overall = dict.fromkeys(features, max(overall.values()) or 1.0)
        for trial, smoothing in (candidates or {0: 0.0}).items():
            params = [
                [(whole[(y, f)].mean, whole[(y, f)].variance + smoothing * overall[f] or LEAST_SMOOTHING * overall[f])
                 for f in features]
                for y in (0, 1)
            ]
            rows.append((left_out, trial, _log_odds(*seen), [fill[f] for f in features], *params))

    def log_ratio(f: str, i: int) -> Column:
        x = F.coalesce(F.col(f).cast("double"), F.col("_fill")[i])

        def density(params: Column) -> Column:
            gap = x - params["mean"]
            return F.lit(-0.5) * (F.log(F.lit(TWO_PI) * params["var"]) + gap * gap / params["var"])
        return density(F.col("_c1")[i]) - density(F.col("_c0")[i])

    per_feature = "array<struct<mean:double,var:double>>"
    schema = f"trial_id int, _prior double, _fill array<double>, _c0 {per_feature}, _c1 {per_feature}"
    return BayesModel(rows, schema, tuple(features), log_ratio)


def fit_bernoulli_nb(df: DataFrame, features: Sequence[str],
                     candidates: Mapping[int, tuple[float, float]] | None = None,
                     fold: str = "fold", label: str = "label", standardise: bool = False,
                     stats: Mapping[int, Mapping[tuple, Moments]] | None = None, times: str | None = None) -> BayesModel:
    """``candidates`` map trial ids to (alpha, binarize cut).

    With ``standardise`` the cut is on z-scores with the training statistics of each fold, so
    every fold has its own cut on the raw value and its training rows are counted at it;
    missing values count as the training mean. ``stats`` are the moments per left-out fold and
    feature, where they are known; ``times`` names how often a row of ``df`` counts.
    """
    candidates = candidates or {0: (1.0, 0.0)}
    cuts = sorted({float(cut) for _, cut in candidates.values()})
    source = df.where(F.col(fold).isNotNull())
    if standardise:
        stats = stats or fold_moments(df, features, fold)
        raw = {(left_out, f, c): m[(f,)].mean + c * m[(f,)].filled_std
               for left_out, m in stats.items() for f in features for c in cuts}
        fill = {left_out: {f: m[(f,)].mean for f in features} for left_out, m in stats.items()}
        counts = _counts_per_fold(source, features, raw, fill, fold, label, times)
    else:
        fill = None
        counts = _counts_once(source, features, cuts, fold, label, times)
        raw = {(left_out, f, c): c for left_out in counts for f in features for c in cuts}
    rows = []
    for left_out, found in counts.items():
        for trial, (alpha, cut) in candidates.items():
            params, seen = [[], []], [0, 0]
            for y in (0, 1):
                for f in features:
                    n, ones = found.get((y, f, float(cut)), (0, 0))
                    share = (ones + alpha) / (n + 2 * alpha)
                    params[y].append((math.log(share), math.log(1 - share)))
                    seen[y] = n
            if sum(seen):
                at = [raw[(left_out, f, float(cut))] for f in features]
                filled = fill and [fill[left_out][f] for f in features]
                rows.append((left_out, trial, _log_odds(*seen), filled, at, *params))

    def log_ratio(f: str, i: int) -> Column:
        above = F.coalesce(F.col(f).cast("double"), F.col("_fill")[i]) > F.col("_cut")[i]
        mass = lambda params: F.when(above, params["yes"]).otherwise(params["no"])
        return mass(F.col("_c1")[i]) - mass(F.col("_c0")[i])

    per_feature = "array<struct<yes:double,no:double>>"
    schema = f"trial_id int, _prior double, _fill array<double>, _cut array<double>, _c0 {per_feature}, _c1 {per_feature}"
    return BayesModel(rows, schema, tuple(features), log_ratio)


def _counts_once(source: DataFrame, features: Sequence[str], cuts: Sequence[float], fold: str, label: str,
                 times: str | None = None) -> dict:
    """{left out fold: {(label, feature, cut): (rows, rows above)}} from one count per fold."""
    own: dict[int, dict] = defaultdict(dict)
    total: dict[tuple, tuple[int, int]] = defaultdict(lambda: (0, 0))
    for in_fold, found in _histograms(source, dict.fromkeys(features, list(cuts)), fold, label, times).items():
        for (y, feature), (above, missing) in found.items():
            for cut, ones in zip(cuts, above[1:]):
                key, n = (y, feature, cut), above[0] + missing
                own[in_fold][key] = (n, ones)
                total[key] = (total[key][0] + n, total[key][1] + ones)
    rest = {
        f: {k: (n - mine.get(k, (0, 0))[0], ones - mine.get(k, (0, 0))[1]) for k, (n, ones) in total.items()}
        for f, mine in own.items()
    }
    return {**rest, FULL: dict(total)}


def _counts_per_fold(source: DataFrame, features: Sequence[str], raw: Mapping, fill: Mapping, fold: str,
                     label: str, times: str | None = None) -> dict:
    """The same where each left-out fold has its own raw cut."""
    places: dict[str, set[float]] = defaultdict(set)
    for (_, feature, _), at in raw.items():
        places[feature].add(at)
    cuts = {f: sorted(places[f]) for f in features}
    found = _histograms(source, cuts, fold, label, times)
    out: dict[int, dict] = defaultdict(dict)
    for (left_out, feature, cut), at in raw.items():
        place = bisect_left(cuts[feature], at) + 1
        filled_above = fill[left_out][feature] > at
        for y in (0, 1):
            trained = [stats[(y, feature)] for f, stats in found.items() if f != left_out and (y, feature) in stats]
            if trained:
                out[left_out][(y, feature, cut)] = (
                    sum(above[0] + missing for above, missing in trained),
                    sum(above[place] + missing * filled_above for above, missing in trained))
    return out


def _histograms(source: DataFrame, cuts: Mapping[str, list[float]], fold: str, label: str, times: str | None = None) -> dict:
    """{fold: {(label, feature): (above, missing)}} for ascending ``cuts`` of each feature: ``above[0]`` rows
    with a value, ``above[i + 1]`` of them beyond cut ``i``. A value is counted once, for all cuts; features
    x cuts numbers are broadcast, and one count for each interval between cuts reaches the driver."""
    table = source.sparkSession.createDataFrame(list(cuts.items()), "feature string, cuts array<double>")
    passed = _passed(F.col("value"), F.col("cuts"), max(map(len, cuts.values())))
    counted = (
        long_form(source, [fold, label, *([times] if times else [])], list(cuts)).join(F.broadcast(table), "feature")
        .groupBy(fold, label, "feature", F.when(F.col("value").isNotNull(), passed).alias("passed"))
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("n")).collect()
    )
    own: dict[int, dict] = defaultdict(dict)
    for r in counted:
        feature = r["feature"]
        counts = own[r[fold]].setdefault((r[label], feature), [0] * (len(cuts[feature]) + 2))
        counts[-1 if r["passed"] is None else r["passed"]] += r["n"]
    return {f: {key: (list(accumulate(reversed(counts[:-1])))[::-1], counts[-1]) for key, counts in stats.items()}
            for f, stats in own.items()}


def _passed(value: Column, cuts: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, ``most`` at the most, lie below ``value``: by halved steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def gaussian_nb(df: DataFrame, features: Sequence[str], candidates: Mapping[int, float] | None = None,
                fold: str = "fold", label: str = "label", keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Scores (keys, fold, label, trial_id, p): out-of-fold for folded rows, full model for the rest."""
    scored = fit_gaussian_nb(df, features, candidates, fold, label).score(df, fold)
    return scored.select(*keys, fold, label, "trial_id", "p")


def bernoulli_nb(df: DataFrame, features: Sequence[str],
                 candidates: Mapping[int, tuple[float, float]] | None = None, fold: str = "fold",
                 label: str = "label", keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """As ``gaussian_nb``, on features cut to 0/1."""
    scored = fit_bernoulli_nb(df, features, candidates, fold, label).score(df, fold)
    return scored.select(*keys, fold, label, "trial_id", "p")


def _log_odds(negatives: int, positives: int) -> float:
    if not negatives or not positives:
        raise ValueError("a training part holds one class only")
    return math.log(positives) - math.log(negatives)
