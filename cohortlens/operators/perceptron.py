"""A perceptron with one hidden layer of sigmoids and two classes, fitted as MLlib fits it.

The objective is MLlib's: rows follow each other in blocks of 128, the last block of a partition may be shorter, and the
loss is the mean over blocks of the mean cross entropy of a block's rows. So is the search: L-BFGS with ten corrections
and a line search for the strong Wolfe conditions, which starts from given weights.

A pass answers one evaluation. It is arithmetic on arrays: of a block of rows only the hidden layer is worked out, as
hyperbolic tangents that stay in the cache, and its square; loss and gradient are three products with them, since two
classes need one margin only. Rows are packed once and dealt evenly over the tasks, in memory or on disk. Of each
partition as many numbers as the model has weights reach the driver, added up in a fixed order; beyond ``DIRECT_NUMBERS``
of them, tasks add them up first.

Weights agree with MLlib's to rounding for the first dozens of steps. Further on the search magnifies rounding, MLlib's
own as well: after 200 steps digits differ, as they do between two orders of summation, the loss hardly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of MLlib's; each block counts the same.
BLOCK_ROWS = 128
#: Values of features that are packed into one record, about.
RECORD_CELLS = 1 << 15
#: Numbers of a hidden layer that are worked out at a time.
CACHED_CELLS = 51200
#: Partial sums (partitions x weights) that the driver adds up itself.
DIRECT_NUMBERS = 1 << 21
#: Rows of a partition at most, about; there are at least three partitions for each core.
PARTITION_ROWS = 1 << 23

# MLlib's tolerance and number of corrections, constants of its line search.
TOLERANCE, CORRECTIONS, REMEMBERED = 1e-6, 10, 20
DECREASE, CURVATURE, TRIES = 1e-4, 0.9, 10


def fit_perceptron(train: DataFrame, features: Sequence[str], label: str, hidden: int, start: np.ndarray, max_iter: int,
                   tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights in MLlib's order: features x hidden, biases, hidden x 2, biases."""
    d = len(features)
    # dealt evenly in some tasks for each core, for a pass takes as long as the slowest core
    tasks = max(3 * train.sparkSession.sparkContext.defaultParallelism, math.ceil(train.count() / PARTITION_ROWS))
    blocks = _packed(train, features, label, tasks).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        return minimise(lambda theta: _objective(_pass(blocks, theta, d, hidden), theta, d, hidden), np.asarray(start, float), max_iter, tolerance)
    finally:
        blocks.unpersist()


# --- rows -----------------------------------------------------------------------------------

def _packed(train: DataFrame, features: Sequence[str], label: str, tasks: int) -> RDD:
    """Rows in records: features by rows, labels, and the rows of a block."""
    rows = train.select(*(F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)),
                        F.col(f"`{label}`").cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, RECORD_CELLS // (len(features) * BLOCK_ROWS)) * BLOCK_ROWS
        place, held = TaskContext.get().partitionId() << 33, np.zeros((len(features) + 1, 0))
        for batch in batches:
            fresh = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float)
            if not np.isfinite(fresh[:-1]).all():
                raise ValueError(f"training rows miss a value of {', '.join(features)}, or have an infinite one; impute them first")
            if not np.isin(fresh[-1], (0.0, 1.0)).all():
                raise ValueError(f"{label} is missing, or neither 0 nor 1")
            held = np.concatenate([held, fresh], axis=1)
            while held.shape[1] >= size:
                yield _record(place, held[:, :size], BLOCK_ROWS)
                place, held = place + 1, held[:, size:]
        whole = held.shape[1] // BLOCK_ROWS * BLOCK_ROWS
        for part, block in ((held[:, :whole], BLOCK_ROWS), (held[:, whole:], held.shape[1] - whole)):
            if part.size:
                yield _record(place, part, block)
                place += 1

    packed = rows.mapInArrow(pack, "place long, x binary, y binary, block int")
    # in order, so that sums are the same whenever a partition is made again
    return packed.repartition(tasks).sortWithinPartitions("place").select("x", "y", "block").rdd.map(tuple)


def _record(place: int, part: np.ndarray, block: int) -> pa.RecordBatch:
    x, y = np.ascontiguousarray(part[:-1]), part[-1].astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([block], pa.int32())],
        ["place", "x", "y", "block"])


# --- one evaluation -----------------------------------------------------------------------------

def _layers(theta: np.ndarray, d: int, hidden: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights into the hidden layer (hidden x (features, 1)), and of the margin of class 1 over class 0."""
    first, second = theta[:(d + 1) * hidden].reshape(d + 1, hidden), theta[(d + 1) * hidden:]
    pairs = second[:-2].reshape(hidden, 2)
    return np.ascontiguousarray(first.T), pairs[:, 1] - pairs[:, 0], float(second[-1] - second[-2])


def _sums(records: Iterable[tuple], theta: np.ndarray, d: int, hidden: int) -> np.ndarray:
    """What ``block_sums`` says of all records; a single 0 where there are none."""
    layers, total = _layers(theta, d, hidden), np.zeros(1)
    for record in records:
        total = total + block_sums(*record, *layers)
    return total


def _pass(blocks: RDD, theta: np.ndarray, d: int, hidden: int) -> np.ndarray:
    parts = blocks.mapPartitions(lambda records: [_sums(records, theta, d, hidden)])
    return parts.treeReduce(np.add) if blocks.getNumPartitions() * len(theta) > DIRECT_NUMBERS else sum(parts.collect(), np.zeros(1))


def _objective(total: np.ndarray, theta: np.ndarray, d: int, hidden: int) -> tuple[float, np.ndarray]:
    """The objective and its gradient by the sums of all blocks."""
    if len(total) == 1:
        raise ValueError("no training rows")
    out = _layers(theta, d, hidden)[1]
    number, loss, by_hidden, rest = total[0], total[1], total[2:2 + hidden], total[2 + hidden:]
    squares, plain = rest[:hidden * (d + 1)].reshape(hidden, d + 1), rest[hidden * (d + 1):]
    inner = out[:, None] / 4 * (plain - squares)
    outer = np.append((plain[-1] + by_hidden) / 2, plain[-1])
    return loss / number, np.concatenate([inner.T.ravel(), np.stack([-outer, outer], axis=1).ravel()]) / number


def block_sums(x: bytes, y: bytes, block: int, into: np.ndarray, out: np.ndarray, bias: float) -> np.ndarray:
    """Of one record: blocks, loss, and what the gradient is made of. With a hidden unit (1 + t) / 2 and the gap r between
    probability and label, these are the sums of t r, of t t r x and of r x, where x ends with 1."""
    labels = np.frombuffer(y, np.uint8).astype(float)
    hidden, width = into.shape
    rows = np.ones((width, len(labels)))
    rows[:-1] = np.frombuffer(x).reshape(width - 1, -1)
    half, slopes, level = into / 2, out / 2, bias + out.sum() / 2
    size = min(len(labels), max(BLOCK_ROWS, CACHED_CELLS // hidden))
    cells = np.empty((hidden, size))
    loss, by_hidden, squares, plain = 0.0, np.zeros(hidden), np.zeros((hidden, width)), np.zeros(width)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(labels), size):
            own, t = rows[:, at:at + size], cells[:, :min(size, len(labels) - at)]
            np.tanh(np.matmul(half, own, out=t), out=t)
            margin, label = slopes @ t + level, labels[at:at + size]
            gap = 1 / (1 + np.exp(-margin)) - label
            loss += np.logaddexp(0, margin - 2 * label * margin).sum()
            by_hidden += t @ gap
            pulled = own * gap
            squares += np.multiply(t, t, out=t) @ pulled.T
            plain += pulled.sum(axis=1)
    return np.concatenate([[math.ceil(len(labels) / block)], np.concatenate([[loss], by_hidden, squares.ravel(), plain]) / block])


# --- the search ---------------------------------------------------------------------------------

class _Stuck(ArithmeticError):
    """A direction or step that leads nowhere."""


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int,
             tolerance: float = TOLERANCE) -> np.ndarray:
    """L-BFGS by the rules of MLlib's optimiser. Stuck once, it forgets its corrections; stuck again, it stops."""
    value, slope = evaluate(x)
    first, recent, moves, stuck, step = abs(value), [np.inf], [], False, 0
    with np.errstate(all="ignore"):
        while step < max_iter:
            if len(recent) > 1 and abs(value - max(recent)) <= tolerance * first:
                break
            if np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8):
                break
            try:
                direction = _direction(slope, moves)
                begin = 1.0 if step else 1.0 / np.linalg.norm(direction)
                length, new_value, new_slope = _line_search(evaluate, x, direction, value, slope, begin)
                if length * np.linalg.norm(slope) < 1e-10:
                    raise _Stuck
            except _Stuck:
                if stuck:
                    break
                stuck, moves = True, []
                continue
            new_x = x + direction * length
            moves = [(new_x - x, new_slope - slope), *moves][:CORRECTIONS]
            x, value, slope, stuck, step = new_x, new_value, new_slope, False, step + 1
            recent = [*recent, value][-REMEMBERED:]
    return x


def _direction(slope: np.ndarray, moves: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; ``moves`` are steps and changes of the gradient, newest first."""
    scale = 1.0
    if moves:
        s, change = moves[0]
        along = s @ change
        if along < 0 or np.isnan(along):
            raise _Stuck
        scale = along / (change @ change)
    found, shares = slope.copy(), []
    for s, change in moves:
        shares.append((s @ found) / (s @ change))
        if np.isnan(shares[-1]):
            raise _Stuck
        found -= shares[-1] * change
    found *= scale
    for (s, change), share in reversed(list(zip(moves, shares))):
        found += (share - (change @ found) / (s @ change)) * s
    return -found


def _line_search(evaluate: Callable, x: np.ndarray, direction: np.ndarray, value: float, slope: np.ndarray,
                 t: float) -> tuple[float, float, np.ndarray]:
    """(step, value, gradient) that meets the strong Wolfe conditions."""
    def at(t: float) -> tuple[float, float, float, np.ndarray]:
        found, gradient = evaluate(x + direction * t)
        return t, found, gradient @ direction, gradient

    start = (0.0, value, slope @ direction, slope)
    fall = start[2]
    if fall > 0:
        raise _Stuck

    def zoom(low: tuple, high: tuple) -> tuple[float, float, np.ndarray]:
        for _ in range(TRIES):
            t = _between(high, low) if low[0] > high[0] else _between(low, high)
            if np.isnan(t):
                raise _Stuck
            here = at(t)
            if here[1] > value + DECREASE * t * fall or here[1] >= low[1]:
                high = here
                continue
            if abs(here[2]) <= CURVATURE * abs(fall):
                return t, here[1], here[3]
            if here[2] * (high[0] - low[0]) >= 0:
                high = low
            low = here
        raise _Stuck

    low = start
    for i in range(TRIES):
        here = at(t)
        if not np.isfinite(here[1]):
            t /= 2
            continue
        if here[1] > value + DECREASE * t * fall or here[1] >= low[1] and i:
            return zoom(low, here)
        if abs(here[2]) <= CURVATURE * abs(fall):
            return t, here[1], here[3]
        if here[2] >= 0:
            return zoom(here, low)
        low, t = here, t * 1.5
    raise _Stuck


def _between(left: tuple, right: tuple) -> float:
    """Where a cubic through both ends is least, not too close to either."""
    (t0, f0, s0, _), (t1, f1, s1, _) = left, right
    a = s0 + s1 - 3 * np.float64(f0 - f1) / (t0 - t1)
    b = np.sqrt(a * a - s0 * s1)
    t = t1 - (t1 - t0) * (s1 + b - a) / (s1 - s0 + 2 * b)
    least, most = t0 + 0.1 * (t1 - t0), t0 + 0.9 * (t1 - t0)
    return least if t < least else most if t > most else t
