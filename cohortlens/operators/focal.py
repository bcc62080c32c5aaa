"""Logistic scorer trained on the focal loss by full-batch gradient steps.

One epoch is one aggregate over the rows: training loss and d + 1 gradient sums, validation
loss. Only those few numbers reach the driver. Schedule: Adam with weight
decay, gradient-norm clip, learning rate halved when the validation loss stalls, early stop,
best epoch kept.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens.functions.scalars import focal_loss
from cohortlens.operators.linear import LinearScore
from cohortlens.session import stage


@dataclass(frozen=True)
class FocalSchedule:
    epochs: int = K.FOCAL_EPOCHS
    learning_rate: float = K.FOCAL_LEARNING_RATE
    weight_decay: float = K.FOCAL_WEIGHT_DECAY
    patience: int = K.FOCAL_PATIENCE
    plateau: int = K.FOCAL_PLATEAU
    clip: float = K.FOCAL_CLIP
    alpha: float = K.FOCAL_ALPHA
    gamma: float = K.FOCAL_GAMMA


def epoch_sums(rows: DataFrame, model: LinearScore, label: str, schedule: FocalSchedule,
               part: str = "part") -> tuple[float, np.ndarray, float]:
    """(training loss, its gradient in (intercept, coefficients), validation loss), one aggregate."""
    y = F.col(label).cast("double")
    logits = rows.withColumn("_z", model.margin())
    # pt = probability of the true class; d loss / dz by the chain rule through pt
    sign = 2 * y - 1
    pt = 1.0 / (1.0 + F.exp(-sign * F.col("_z")))
    alpha = F.lit(schedule.alpha) * y + F.lit(1 - schedule.alpha) * (1 - y)
    g = schedule.gamma
    slope = alpha * sign * F.pow(1 - pt, F.lit(g)) * (g * pt * F.log(F.greatest(pt, F.lit(1e-300))) - (1 - pt))
    steep = logits.withColumns({"_loss": focal_loss("_z", y, schedule.alpha, g), "_s": slope})
    train = F.col(part) == "train"
    names = list(model.coefficients)
    sums = steep.agg(
        F.avg(F.when(train, F.col("_loss"))).alias("loss"), F.avg(F.when(~train, F.col("_loss"))).alias("checked"),
        F.avg(F.when(train, F.col("_s"))).alias("g"),
        *[F.avg(F.when(train, F.col("_s") * F.col(f))).alias(f"g{i}") for i, f in enumerate(names)]).first()
    return float(sums["loss"]), np.array([sums["g"], *[sums[f"g{i}"] for i in range(len(names))]]), float(sums["checked"])


def fit_focal(rows: DataFrame, features: Sequence[str], label: str = "label", part: str = "part",
              schedule: FocalSchedule = FocalSchedule()) -> tuple[LinearScore, list[tuple[float, float]]]:
    """The model of the best epoch, and (training loss, validation loss) of every epoch.

    ``part`` is 'train' or 'valid'; both are read in the same pass.
    """
    rows = stage(rows.select(label, part, *features))
    theta = np.zeros(len(features) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    rate, best, best_theta, stalled, flat = schedule.learning_rate, np.inf, theta, 0, 0
    history: list[tuple[float, float]] = []
    for epoch in range(schedule.epochs + 1):
        loss, gradient, checked = epoch_sums(rows, _model(theta, features), label, schedule, part)
        if epoch:  # the losses of the step before; epoch 0 only supplies the first gradient
            history.append((loss, checked))
            if checked < best:
                best, best_theta, stalled, flat = checked, theta, 0, 0
            else:
                stalled, flat = stalled + 1, flat + 1
                if flat > schedule.plateau:
                    rate, flat = rate / 2, 0
                if stalled >= schedule.patience:
                    break
        gradient = gradient + schedule.weight_decay * theta
        gradient = gradient * min(1.0, schedule.clip / (np.linalg.norm(gradient) + 1e-12))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        step = epoch + 1
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return _model(best_theta, features), history


def _model(theta: np.ndarray, features: Sequence[str]) -> LinearScore:
    return LinearScore(dict(zip(features, map(float, theta[1:]))), float(theta[0]))


def save_model(model: LinearScore, df: DataFrame, path: str) -> None:
    """Keep a fitted linear model as one JSON row under ``path``."""
    df.sparkSession.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark, path: str) -> LinearScore:
    return LinearScore(**json.loads(spark.read.text(path).first()["value"]))
