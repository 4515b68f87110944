"""Random search over model parameters, scored on the chronological validation part: all trials to their end, or, for boosted
trees, by successive halving."""

from __future__ import annotations

import logging
import math
import random
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators.evaluation import regression_metrics
from airlake.operators import boosting
from airlake.operators.models import fit_forest, fit_ridge

log = logging.getLogger(__name__)


def _log_uniform(r: random.Random, low: float, high: float) -> float:
    return math.exp(r.uniform(math.log(low), math.log(high)))


# The search spaces.
def boosted_space(r: random.Random) -> dict:
    return {
        "rounds": r.randrange(50, 301, 25),
        "depth": r.randint(3, 10),
        "rate": _log_uniform(r, 0.01, 0.25),
        "rows": r.uniform(0.6, 1.0),
        "columns": r.uniform(0.6, 1.0),
        "least": float(r.randint(1, 8)),
    }


def forest_space(r: random.Random) -> dict:
    """Spark has one minimum for a node: the leaf minimum, raised by half the split minimum."""
    split, leaf = r.randint(2, 10), r.randint(1, 6)
    return {
        "numTrees": r.randrange(50, 201, 25),
        "maxDepth": r.randint(5, 20),
        "minInstancesPerNode": max(leaf, split // 2),
        "featureSubsetStrategy": r.choice(["sqrt", "log2", "0.8"]),
    }


def ridge_space(r: random.Random) -> dict:
    return {"alpha": _log_uniform(r, 0.01, 100.0), "degree": r.randint(1, 2)}


def search(
    fit: Callable,
    space: Callable[[random.Random], dict],
    train: DataFrame,
    val: DataFrame,
    trials: int,
    timeout: float | None = None,
    parallel: int = 3,
    seed: int = 42,
    fixed: Mapping | None = None,
    trial_log: list | None = None,
) -> tuple[dict, float]:
    """The parameters of smallest validation RMSE over all trials; ``trial_log`` gets (number, parameters, RMSE) of each.

    With ``timeout``, no new trial starts after so many seconds, and those left out are logged: the result then depends on
    speed. Trials run from driver threads, so Spark schedules their jobs side by side. ``fixed``
    overrides the space, for small data.
    """
    r = random.Random(seed)
    draws = [{**space(r), **(fixed or {})} for _ in range(trials)]
    train, val = train.persist(), val.persist()
    deadline = math.inf if timeout is None else time.monotonic() + timeout

    def trial(params: dict) -> tuple[float, dict] | None:
        if time.monotonic() > deadline:
            log.warning("search: trial left out after %s seconds: %s", timeout, params)
            return None
        model = fit(train, **params)
        score = regression_metrics(model.transform(val), S.LABEL, "prediction").first()["rmse"]
        return score, params

    try:
        with ThreadPoolExecutor(parallel) as pool:
            ended = list(pool.map(trial, draws))
    finally:
        train.unpersist()
        val.unpersist()
    if trial_log is not None:
        trial_log += [(k, t[1], t[0]) for k, t in enumerate(ended) if t]
    done = [t for t in ended if t]
    if not done:
        raise TimeoutError("no trial finished")
    score, params = min(done, key=lambda t: t[0])
    return params, score


#: Rounds after which the better half of the trials goes on.
STAGES = (25, 50, 100, 200)


def halving(
    train: DataFrame, val: DataFrame, trials: int, seed: int = 42, fixed: Mapping | None = None, trial_log: list | None = None, label: str = S.LABEL, features=S.FEATURES
) -> tuple[dict, float]:
    """Boosted trees by successive halving: all trials start on one binned table, and after each of ``STAGES`` the half of
    smallest validation errors goes on, up to the rounds each trial has drawn.

    A trial's score is its smallest error so far, so no trial that stopped is better than the best that went on, and its
    ``rounds`` are those that reach it. ``trial_log`` gets (number, parameters, RMSE, rounds reached) of each.
    """
    r = random.Random(seed)
    draws = {k: boosting.Params(**{**S.BOOSTED_PARAMS, **boosted_space(r), **(fixed or {}), "patience": 0}) for k in range(trials)}
    both = train.withColumn("held_out", F.lit(False)).unionByName(val.withColumn("held_out", F.lit(True)), allowMissingColumns=True)
    data = boosting.binned(both, features, label, "held_out", next(iter(draws.values())).bins)
    grown: dict[int, list] = {k: [] for k in draws}
    live = list(draws)

    def score(k: int) -> tuple[float, int]:
        return min((e for _, e in grown[k] if not math.isnan(e)), default=math.inf), k

    for stage in (*STAGES, None):
        goals = {k: min(draws[k].rounds, stage or draws[k].rounds) for k in live}
        boosting.advance(data, {k: draws[k] for k in live}, grown, goals)
        if stage:
            live = [k for _, k in sorted(score(k) for k in live)[: -(-len(live) // 2)]]
    keys = "rounds", "depth", "rate", "rows", "columns", "least"
    if trial_log is not None:
        trial_log += [(k, {c: getattr(p, c) for c in keys}, math.sqrt(score(k)[0]), len(grown[k])) for k, p in draws.items()]
    error, best = min(score(k) for k in draws)
    if math.isinf(error):
        raise ValueError("no validation rows")
    found = {c: getattr(draws[best], c) for c in keys}
    found["rounds"] = next(n for n, (_, e) in enumerate(grown[best], 1) if e == error)
    return found, math.sqrt(error)


def tune_boosted(train: DataFrame, val: DataFrame, trials: int = 15, **options) -> tuple[dict, float]:
    return halving(train, val, trials, **options)


def tune_forest(train: DataFrame, val: DataFrame, trials: int = 15, **options) -> tuple[dict, float]:
    return search(fit_forest, forest_space, train, val, min(trials, 10), **options)


def tune_ridge(train: DataFrame, val: DataFrame, trials: int = 15, **options) -> tuple[dict, float]:
    return search(fit_ridge, ridge_space, train, val, min(trials, 10), **options)
