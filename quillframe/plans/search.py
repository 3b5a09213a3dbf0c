"""Search for the parameters of an algorithm: seeded draws, then draws near the best trials, with weak trials stopped early.

The driver holds one row per trial; every score is a fit on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quillframe.operators.analysis import report
from quillframe.plans.train import SEED, Prepared, algorithms, evaluator, with_folds


@dataclass(frozen=True)
class Span:
    """The values a parameter may take; ``log`` draws evenly over magnitudes, ``whole`` rounds to integers."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, share: float):
        a, b = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        value = a + (b - a) * min(max(share, 0.0), 1.0)
        value = math.exp(value) if self.log else value
        return int(round(value)) if self.whole else float(value)


# The spans searched, per family.
SPANS: dict[str, dict[str, Span]] = {
    "LogisticRegression": {"regParam": Span(1e-5, 1.0, log=True), "elasticNetParam": Span(0.0, 1.0)},
    "LinearRegression": {"regParam": Span(1e-5, 10.0, log=True), "elasticNetParam": Span(0.0, 1.0)},
    "DecisionTreeClassifier": {"maxDepth": Span(2, 12, whole=True), "minInstancesPerNode": Span(1, 20, whole=True)},
    "DecisionTreeRegressor": {"maxDepth": Span(2, 12, whole=True), "minInstancesPerNode": Span(1, 20, whole=True)},
    "RandomForestClassifier": {"maxDepth": Span(3, 12, whole=True), "numTrees": Span(30, 200, whole=True), "subsamplingRate": Span(0.5, 1.0)},
    "RandomForestRegressor": {"maxDepth": Span(3, 12, whole=True), "numTrees": Span(30, 200, whole=True), "subsamplingRate": Span(0.5, 1.0)},
    "GBTClassifier": {"maxDepth": Span(2, 8, whole=True), "stepSize": Span(0.01, 0.3, log=True), "subsamplingRate": Span(0.5, 1.0)},
    "GBTRegressor": {"maxDepth": Span(2, 8, whole=True), "stepSize": Span(0.01, 0.3, log=True), "subsamplingRate": Span(0.5, 1.0)},
    "LinearSVC": {"regParam": Span(1e-5, 1.0, log=True)},
    "NaiveBayes": {"smoothing": Span(1e-3, 10.0, log=True)},
    "MultilayerPerceptronClassifier": {"stepSize": Span(0.003, 0.3, log=True)},
}


@dataclass
class Searched:
    """The model fitted on all training rows with the best parameters, and the trials in the order they ran."""

    model: object
    params: dict
    score: float
    trials: DataFrame


def proposal(rng: np.random.Generator, done: list[tuple[dict, float]], names: list[str], warm: int) -> dict[str, float]:
    """Shares of the spans for the next trial: even draws for the first ``warm``, then steps from one of the best
    quarter (``done`` holds shares and losses), as wide as the best ones lie apart and never below a twentieth."""
    if len(done) < warm:
        return {n: float(rng.random()) for n in names}
    best = [p for p, _ in sorted(done, key=lambda t: t[1])[:max(2, len(done) // 4)]]
    centre = best[int(rng.integers(len(best)))]
    return {n: float(np.clip(rng.normal(centre[n], max(np.std([p[n] for p in best]), 0.05)), 0.0, 1.0)) for n in names}


def search(data: Prepared, task: str, name: str, trials: int = 12, folds: int = 3, seed: int = SEED, spans: Mapping[str, Span] | None = None) -> Searched:
    """The defaults, then ``trials`` proposals, each scored on ``folds`` folds (F1, or RMSE).

    A trial stops after a fold if its mean so far is worse than the median that whole
    trials had after as many folds; three whole trials come first. Stopped trials guide the proposals by their mean so far but
    cannot win, and the defaults always run whole, so the result never scores below them. Algorithms without spans give
    the defaults alone. The same rows and seed give the same trials.
    """
    make = algorithms(task, data)[name]
    spans = dict(SPANS.get(type(make()).__name__, {}) if spans is None else spans)
    sign = -1.0 if task == "classification" else 1.0
    ev = evaluator(task)
    rows = with_folds(data.train, folds, task == "classification").persist()
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    whole: list[tuple[dict, list[float]]] = []
    table = []
    for trial in range(trials + 1 if spans else 1):
        shares = proposal(rng, done, list(spans), max(3, trials // 3)) if trial else {}
        params = {n: spans[n].at(s) for n, s in shares.items()}
        scores: list[float] = []
        for fold in range(folds):
            estimator = make()
            model = estimator.fit(rows.where(f"fold <> {fold}"), {estimator.getParam(n): v for n, v in params.items()})
            scores.append(float(ev.evaluate(model.transform(rows.where(f"fold = {fold}")))))
            earlier = [sign * float(np.mean(s[:fold + 1])) for _, s in whole]
            if len(earlier) >= 3 and fold + 1 < folds and sign * float(np.mean(scores)) > float(np.median(earlier)):
                break
        mean = float(np.mean(scores))
        if shares:
            done.append((shares, sign * mean))
        if len(scores) == folds:
            whole.append((params, scores))
        table.append((trial, ", ".join(f"{n}={v:.6g}" for n, v in sorted(params.items())) or "defaults", len(scores), len(scores) < folds, round(mean, 6)))
    rows.unpersist()
    params, scores = min(whole, key=lambda t: sign * float(np.mean(t[1])))
    estimator = make()
    model = estimator.fit(data.train, {estimator.getParam(n): v for n, v in params.items()})
    return Searched(model, params, float(np.mean(scores)), report(data.train, table, "trial int, params string, folds int, stopped boolean, score double"))
