"""Out-of-fold scores: pooled over folds, never averaged per fold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import add_all
from cohortlens.functions.scalars import sigmoid
from cohortlens.operators.bayes import BayesModel, fit_bernoulli_nb, fit_gaussian_nb
from cohortlens.operators.folds import train_rows, valid_rows
from cohortlens.operators.learners import Learner, make_learner
from cohortlens.operators.linear import fit_discriminants
from cohortlens.operators.neighbors import knn_join, neighbor_vote
from cohortlens.operators.preprocess import FULL, Moments, fold_moments, join_per_fold, scale_by, trains
from cohortlens.operators.resample import borderline_smote, smote, with_synthetic
from cohortlens.session import stage
from cohortlens.sources.cohorts import union_by_name

ONE_PASS = ("GNB", "BNB", "KNN")  # families whose candidates share one scan or one join
TIMES = "_times"  # how many rows a row of ``FoldedData.counted`` stands for
RESAMPLERS = {"regular": smote, "borderline": borderline_smote}


class FoldedData:
    """Source rows with folds (and target rows without) plus training statistics per fold.

    A negative fold never validates but always trains. ``past_only`` trains on earlier cohorts
    (``parts`` folds each) only; ``leaky`` scales by all source rows; ``resample`` oversamples
    the training rows.
    The rows should be a staged table: every fold and every trial reads them again.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str = "label", key: str = "entity_id",
                 fold: str = "fold", scale: bool = True, leaky: bool = False, past_only: bool = False,
                 parts: int = 2, resample: str | None = None):
        self.df, self.features, self.label, self.key, self.fold = df, list(features), label, key, fold
        self.scale, self.leaky, self.past_only, self.parts, self.resample = scale, leaky, past_only, parts, resample
        self.stats: Mapping[int, dict[tuple, Moments]] = fold_moments(
            df, features, fold, past_only=past_only, parts=parts)
        known = [r[fold] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect()]  # a few dozen
        self.folds = sorted(f for f in known if f >= 0 and any(trains(g, f, past_only, parts) for g in known))

    def scaled(self, left_out: int) -> DataFrame:
        if not self.scale:
            return self.df
        return scale_by(self.df, self.stats[FULL if self.leaky else left_out], self.features)

    def split(self, left_out: int) -> tuple[DataFrame, DataFrame]:
        """(training rows, rows to score). FULL trains on all source rows and scores the target."""
        rows = self.scaled(left_out)
        source = rows.where(F.col(self.fold).isNotNull())
        if left_out == FULL:
            train, valid = source, rows.where(F.col(self.fold).isNull())
        else:
            train, valid = train_rows(source, left_out, self.past_only, self.parts), valid_rows(source, left_out)
        if self.resample:
            made = RESAMPLERS[self.resample](train, self.features, self.label, self.key)
            train = with_synthetic(train, made, self.key)
        return train, valid

    @cached_property
    def label_stats(self) -> Mapping[int, dict[tuple, Moments]]:
        """Training statistics per left-out fold, label and feature."""
        return fold_moments(self.df, self.features, self.fold, self.label)

    @cached_property
    def counted(self) -> DataFrame:
        """Rows that agree in fold, label and all features as one row with their number, staged. A model without
        the key gives them the same score, so many candidates are rated on these."""
        spark = self.df.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        merged = self.df.groupBy(self.fold, self.label, *self.features).agg(F.count(F.lit(1)).alias(TIMES))
        return stage(merged.repartition(tasks))  # few rows, but each is scored once per candidate

    def keys(self) -> list[str]:
        return [self.key, self.label, self.fold]

    def on(self, features: Sequence[str]) -> FoldedData:
        """The same rows and folds on some of the features; their statistics are kept."""
        part = copy(self)
        part.features = [f for f in self.features if f in set(features)]
        return part

    @property
    def plain(self) -> bool:
        """Every fold trains on all other source rows as they are."""
        return not (self.past_only or self.resample or self.leaky)


def in_parallel(spark: SparkSession, job: Callable, items: Iterable, workers: int = 4) -> list:
    """Run independent Spark jobs from a few driver threads; the cluster shares its slots."""
    items = list(items)
    if workers <= 1 or len(items) <= 1:
        return [job(i) for i in items]
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job), i) for i in items]]


def oof_scores(data: FoldedData, learner: Learner, target: bool = False, workers: int = 4) -> DataFrame:
    """Scores of every folded row by the model that did not see it; with ``target``, also the
    target rows by the model of all source rows (their fold is NULL).

    Naive Bayes and discriminant analysis do it in one scan of statistics and one scoring
    pass, other families fit once per fold.
    """
    columns = [*data.keys(), "p"]
    scored = score_closed_form(data, learner.family, learner.params)
    if scored is not None:
        return (scored if target else scored.where(F.col(data.fold).isNotNull())).select(*columns)

    def one(left_out: int) -> DataFrame:
        train, valid = data.split(left_out)
        return learner.fit(train).score(valid).select(*columns)

    left_out = [*data.folds, *([FULL] if target else [])]
    return union_by_name(in_parallel(data.df.sparkSession, one, left_out, workers))


def _fit_bayes(data: FoldedData, family: str, candidates: Mapping[int, Mapping], counted: bool = False) -> BayesModel:
    if family == "GNB":
        smoothing = {t: float(p.get("var_smoothing", 1e-9)) for t, p in candidates.items()}
        return fit_gaussian_nb(data.df, data.features, smoothing, data.fold, data.label, data.scale, data.label_stats)
    settings = {t: (float(p.get("alpha", 1.0)), float(p.get("binarize", 0.0))) for t, p in candidates.items()}
    rows, times = (data.counted, TIMES) if counted else (data.df, None)
    return fit_bernoulli_nb(rows, data.features, settings, data.fold, data.label, data.scale,
                            None if data.past_only else data.stats, times)


def score_closed_form(data: FoldedData, family: str, params: Mapping) -> DataFrame | None:
    """Scores of all rows at once, out-of-fold and target; None where a fit per fold is needed."""
    if not data.plain:
        return None
    rows = data.df.where(F.col(data.fold).isNull() | (F.col(data.fold) >= 0))
    if family in ("GNB", "BNB"):
        return _fit_bayes(data, family, {0: params}).score(rows, data.fold)
    complete = all(m.vals == m.rows for m in data.stats[FULL].values())
    if family != "LDA" or not complete:
        return None
    centred = scale_by(data.df, data.stats[FULL], data.features)
    models = fit_discriminants(centred, data.features, data.fold, data.label)
    fitted = [(f, [m.coefficients[c] for c in data.features], m.intercept) for f, m in models.items()]
    joined = join_per_fold(
        scale_by(rows, data.stats[FULL], data.features), fitted, "_w array<double>, _b double", data.fold)
    margin = F.col("_b") + add_all([F.col("_w")[i] * F.col(c) for i, c in enumerate(data.features)])
    return joined.withColumn("p", sigmoid(margin)).drop("_w", "_b")


def scores_counted(data: FoldedData, family: str, candidates: Mapping[int, Mapping], target: bool = False) -> DataFrame:
    """Scores (label, trial_id, p, number of rows) by naive Bayes of all candidates: out-of-fold, or of the target rows."""
    fold = F.col(data.fold)
    rows = data.counted.where(fold.isNull() if target else fold >= 0)
    return _fit_bayes(data, family, candidates, True).score(rows, data.fold).select(data.label, "trial_id", "p", TIMES)


def target_one_pass(data: FoldedData, family: str, candidates: Mapping[int, Mapping]) -> DataFrame:
    """Scores of the target rows by naive Bayes models of all source rows, with their trial_id."""
    target = data.df.where(F.col(data.fold).isNull())
    return _fit_bayes(data, family, candidates).score(target, data.fold).select(*data.keys(), "trial_id", "p")


def oof_one_pass(data: FoldedData, family: str, candidates: Mapping[int, Mapping], workers: int = 4) -> DataFrame:
    """Out-of-fold scores of all candidates of a closed-form family, with their trial_id."""
    columns = [*data.keys(), "trial_id", "p"]
    source = data.df.where(F.col(data.fold) >= 0)
    if family != "KNN":
        return _fit_bayes(data, family, candidates).score(source, data.fold).select(*columns)
    powers = sorted({int(p.get("p", 2)) for p in candidates.values()})

    def vote(task: tuple[int, int]) -> DataFrame:
        left_out, power = task
        train, valid = data.split(left_out)
        mine = {t: p for t, p in candidates.items() if int(p.get("p", 2)) == power}
        k = max(int(p["n_neighbors"]) for p in mine.values())
        # rows at the same place have the same neighbours: one of them asks (a key that repeats has several places)
        place = F.struct(*(F.col(f).cast("double").alias(f) for f in data.features))
        places = valid.groupBy(data.key).agg(F.sort_array(F.collect_list(place)).alias("_places"))
        asking = stage(places.groupBy("_places").agg(F.min(data.key).alias("_asks")))
        queries = asking.select(F.col("_asks").alias(data.key), F.inline("_places"))
        near = stage(knn_join(queries, train, data.features, k, data.key, None, power, [data.label]))
        voted = union_by_name([
            neighbor_vote(near, int(p["n_neighbors"]), p.get("weights", "uniform"), data.key, data.label)
            .withColumn("trial_id", F.lit(t)) for t, p in mine.items()]).withColumnRenamed(data.key, "_asks")
        return places.join(asking, "_places").select(data.key, "_asks").join(voted, "_asks").drop("_asks")

    votes = in_parallel(data.df.sparkSession, vote, [(f, p) for f in data.folds for p in powers], workers)
    return source.select(*data.keys()).join(union_by_name(votes), data.key).select(*columns)


def oof_candidates(data: FoldedData, family: str, candidates: Mapping[int, Mapping], workers: int = 4) -> DataFrame:
    """Out-of-fold scores of some candidates, with their trial_id."""
    if family in ONE_PASS and data.plain:
        return oof_one_pass(data, family, candidates, workers)
    parts = []
    for trial, params in candidates.items():
        learner = make_learner(family, params, data.features, label=data.label, key=data.key,
                               cost_sensitive=params.get("class_weight", "balanced") is not None)
        parts.append(oof_scores(data, learner, workers=workers).withColumn("trial_id", F.lit(trial)))
    return union_by_name(parts)
