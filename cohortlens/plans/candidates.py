"""Candidate parameters from search ranges: a random batch, then batches near the best."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from cohortlens import constants as K


def uniform(*parts) -> float:
    """A number in [0, 1) from the md5 of the joined parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _ends(values: Sequence) -> set[str]:
    """What the values of a space are: whole numbers, real numbers or labels (switches are labels)."""
    kinds = {int: "whole", float: "real"}
    return {kinds.get(type(v), "label") for v in values}


def base_kind(name: str, values: Sequence) -> tuple[str, bool]:
    """(kind, log scale) by the base rules: ends of one numeric type span a range, all else is a choice."""
    ends = _ends(values)
    only = ends.pop() if len(ends) == 1 else "label"
    return {"whole": "int", "real": "float", "label": "choice"}[only], False


def fusion_kind(name: str, values: Sequence) -> tuple[str, bool]:
    """(kind, log scale) by the fusion rules: two numbers are a range, log scaled when wide."""
    ends = _ends(values)
    if "label" in ends or len(values) != 2:
        return "choice", False
    spread = max(values) / values[0] if values[0] > 0 else 0
    return ("float" if "real" in ends or name in K.FLOAT_RANGE_PARAMS else "int"), spread >= K.LOG_RANGE_RATIO


RULES = {"base": base_kind, "fusion": fusion_kind}


def draw(space: Mapping[str, Sequence], fixed: Mapping, trials: Sequence[int], rules: str = "fusion",
         seed: int = K.SEED) -> dict[int, dict]:
    """{trial id: full parameters}, fixed ones included."""
    return {
        t: {**fixed, **{name: _value(name, values, uniform(seed, t, name), rules) for name, values in space.items()}}
        for t in trials
    }


def draw_near(space: Mapping[str, Sequence], fixed: Mapping, trials: Sequence[int], best: Sequence[Mapping],
              rules: str = "fusion", seed: int = K.SEED, spread: float = 0.2) -> dict[int, dict]:
    """Candidates close to good trials: each value within ``spread`` of the range of one of them."""
    out = {}
    for t in trials:
        near = best[int(uniform(seed, t, "parent") * len(best))]
        params = dict(fixed)
        for name, values in space.items():
            kind, log = RULES[rules](name, values)
            u = uniform(seed, t, name)
            if kind == "choice":
                params[name] = near[name] if u < 0.7 else _value(name, values, uniform(seed, t, name, "new"), rules)
            else:
                at = _position(near[name], min(values), max(values), log)
                params[name] = _value(name, values, min(max(at + (2 * u - 1) * spread, 0.0), 1.0), rules)
        out[t] = params
    return out


def _value(name: str, values: Sequence, u: float, rules: str):
    kind, log = RULES[rules](name, values)
    if kind == "choice":
        return values[min(int(u * len(values)), len(values) - 1)]
    low, high = min(values), max(values)
    if kind == "int":
        if log:
            return min(high, int(math.exp(math.log(low) + u * (math.log(high + 1) - math.log(low)))))
        return min(high, low + int(u * (high - low + 1)))
    value = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if log else low + u * (high - low)
    return min(max(value, low), high)


def _position(value: float, low: float, high: float, log: bool) -> float:
    if high == low:
        return 0.0
    if log:
        return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low))
    return (value - low) / (high - low)


def fusion_space(family: str) -> tuple[dict, dict]:
    """Search range of a fusion method: the base range with the fusion layer's changes."""
    tuned, fixed = K.BASE_SPACES[family]
    more_tuned, more_fixed = K.FUSION_SPACE_CHANGES.get(family, ({}, {}))
    return {**tuned, **more_tuned}, {**fixed, **more_fixed}
