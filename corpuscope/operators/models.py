"""Risk and complexity models over the eighteen function features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import first_items, round_half_up
from corpuscope.operators.structure import FEATURES

# Training rows of the bug model (features in FEATURES order) and labels.
BUG_ROWS = [
    [2.0, 0.3, 0.2, 0.0, 0.4, 0.2, 3.0, 2.0, 5.0, 7.0, 1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0],
    [0.1, 0.1, 0.0, 0.0, 0.2, 0.1, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.3, 0.0],
    [1.5, 0.4, 0.3, 0.0, 0.8, 0.5, 2.0, 0.0, 4.0, 5.0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0],
    [0.2, 0.1, 0.1, 0.2, 0.3, 0.2, 1.0, 1.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.2, 1.0],
    [3.0, 0.5, 0.4, 0.0, 0.9, 0.7, 4.0, 0.0, 6.0, 8.0, 3.0, 2.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0],
    [0.3, 0.2, 0.1, 0.1, 0.4, 0.3, 1.0, 1.0, 2.0, 2.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.1, 0.0],
    [1.0, 0.2, 0.1, 0.0, 0.3, 0.4, 0.0, 0.0, 3.0, 4.0, 1.0, 3.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0],
    [0.5, 0.1, 0.2, 0.3, 0.5, 0.3, 2.0, 2.0, 2.0, 3.0, 0.0, 0.0, 2.0, 0.0, 1.0, 1.0, 0.2, 0.0],
    [2.5, 0.6, 0.5, 0.0, 1.2, 0.8, 5.0, 0.0, 7.0, 9.0, 2.0, 1.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0],
    [0.1, 0.0, 0.0, 0.0, 0.1, 0.1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5, 1.0],
    [0.8, 0.3, 0.0, 0.0, 0.5, 0.3, 1.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0],
    [0.4, 0.2, 0.2, 0.1, 0.4, 0.2, 2.0, 1.0, 2.0, 2.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 0.15, 0.0],
    [1.8, 0.4, 0.4, 0.0, 0.7, 0.6, 3.0, 0.0, 5.0, 6.0, 1.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0],
    [0.2, 0.1, 0.1, 0.2, 0.3, 0.1, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.3, 1.0],
    [0.6, 0.0, 0.0, 0.0, 0.2, 0.2, 0.0, 0.0, 1.0, 3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [0.3, 0.1, 0.1, 0.1, 0.3, 0.2, 1.0, 0.5, 2.0, 2.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5, 0.1, 0.0],
]
BUG_LABELS = [1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0]

# Training rows of the complexity model and target scores.
COMPLEXITY_ROWS = [
    [0.1, 0.1, 0, 0, 0.2, 0.1, 1, 0, 1, 1, 0, 0, 0, 0, 1, 1, 0.3, 0],
    [0.3, 0.2, 0.1, 0.1, 0.4, 0.2, 2, 1, 2, 2, 0, 0, 1, 1, 1, 1, 0.2, 0],
    [0.8, 0.3, 0.2, 0, 0.5, 0.3, 2, 0, 3, 4, 1, 0, 0, 2, 0, 0, 0.1, 0],
    [1.5, 0.4, 0.3, 0, 0.8, 0.5, 3, 0, 4, 5, 1, 1, 0, 3, 0, 0, 0, 0],
    [2.5, 0.5, 0.4, 0, 1.0, 0.7, 4, 0, 6, 8, 2, 2, 0, 4, 0, 0, 0, 0],
    [3.0, 0.6, 0.5, 0, 1.2, 0.8, 5, 0, 7, 9, 3, 3, 0, 5, 0, 0, 0, 0],
    [0.5, 0.1, 0.3, 0.2, 0.6, 0.3, 3, 2, 2, 3, 0, 1, 3, 0, 1, 0, 0.1, 0],
    [0.2, 0, 0, 0, 0.1, 0.1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 1, 0.5, 1],
]
COMPLEXITY_SCORES = [10, 25, 45, 65, 85, 95, 35, 5]


def _standardise(rows: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns at mean 0 and population deviation 1; a constant column is only centred."""
    x = np.asarray(rows, dtype=float)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    return (x - mean) / spread, mean, spread


def _fold(weights: np.ndarray, bias: float, mean: np.ndarray, spread: np.ndarray):
    """Weights and bias that apply to raw features."""
    raw = weights / spread
    return tuple(float(w) for w in raw), float(bias - raw @ mean)


@lru_cache
def bug_coefficients(strength: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Ridge-penalised logistic regression on the sixteen training rows, by Newton steps."""
    x, mean, spread = _standardise(BUG_ROWS)
    y = np.asarray(BUG_LABELS, dtype=float)
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(design.shape[1]) / strength
    penalty[-1, -1] = 0.0
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-design @ beta))
        slope = design.T @ (p - y) + penalty @ beta
        curve = design.T @ (design * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return _fold(beta[:-1], beta[-1], mean, spread)


@lru_cache
def complexity_coefficients(alpha: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Ridge regression on the eight training rows, from the normal equations."""
    x, mean, spread = _standardise(COMPLEXITY_ROWS)
    y = np.asarray(COMPLEXITY_SCORES, dtype=float)
    w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return _fold(w, y.mean(), mean, spread)


def _summed(rows: DataFrame, columns: list[str], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``work`` on the rows as a matrix, summed: every task returns one vector, and Spark adds these up."""
    rows = rows.select(*[F.col(c).cast("double") for c in columns]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "part"])

    sums = rows.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()
    out = np.zeros(len(sums))
    for place, s in sums:
        out[place] = s
    return out


def _spreads(rows: DataFrame, columns: list[str], features: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, means of all columns, and population deviations of the first ``features`` (1 where constant)."""
    sums = _summed(rows, columns, lambda x: np.append(x.sum(axis=0), len(x)))
    if not len(sums) or not sums[-1]:
        raise ValueError("there are no complete rows to learn from")
    n, mean = sums[-1], sums[:-1] / sums[-1]
    spread = np.sqrt(_summed(rows, columns, lambda x: ((x - mean) ** 2).sum(axis=0)) / n)[:features]
    spread[spread < 1e-12 * np.maximum(1.0, np.abs(mean[:features]))] = 1.0
    return n, mean, spread


def fit_complexity(
    rows: DataFrame, target: str, features: list[str] = FEATURES, alpha: float = 1.0
) -> tuple[tuple[float, ...], float]:
    """Ridge regression of ``target`` on labelled rows, from normal equations that Spark sums up.

    Rows with a null are left out. Only sums as wide as the square of the number of features come to the driver.
    """
    columns, k = [*features, target], len(features)
    _, mean, spread = _spreads(rows, columns, k)

    def work(x: np.ndarray) -> np.ndarray:
        z = (x[:, :k] - mean[:k]) / spread
        return np.append((z.T @ z).ravel(), z.T @ (x[:, k] - mean[k]))

    sums = _summed(rows, columns, work)
    w = np.linalg.solve(sums[: k * k].reshape(k, k) + alpha * np.eye(k), sums[k * k :])
    return _fold(w, mean[k], mean[:k], spread)


def fit_bug_risk(
    rows: DataFrame, label: str, features: list[str] = FEATURES, strength: float = 1.0, rounds: int = 50
) -> tuple[tuple[float, ...], float]:
    """Ridge-penalised logistic regression of a 0/1 ``label``, by Newton steps over sums that Spark adds up, one pass a step."""
    columns, k = [*features, label], len(features)
    _, mean, spread = _spreads(rows, columns, k)
    penalty = np.eye(k + 1) / strength
    penalty[-1, -1] = 0.0

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(x: np.ndarray) -> np.ndarray:
            design = np.hstack([(x[:, :k] - mean[:k]) / spread, np.ones((len(x), 1))])
            score = design @ beta
            p = 1.0 / (1.0 + np.exp(-score))
            loss = np.logaddexp(0.0, score) - x[:, k] * score
            return np.concatenate([[loss.sum()], design.T @ (p - x[:, k]), (design.T @ (design * (p * (1 - p))[:, None])).ravel()])

        got = _summed(rows, columns, work)
        curve = got[k + 2 :].reshape(k + 1, k + 1) + penalty
        return got[0] + beta @ penalty @ beta / 2, got[1 : k + 2] + penalty @ beta, curve

    beta = np.zeros(k + 1)
    loss, slope, curve = sums(beta)
    for _ in range(rounds):
        step = np.linalg.solve(curve, slope)
        while True:  # a step that makes the loss larger is halved
            tried = sums(beta - step)
            if tried[0] <= loss + 1e-12 * abs(loss) or np.abs(step).max() < 1e-10:
                break
            step = step / 2
        beta, (loss, slope, curve) = beta - step, tried
        if np.abs(step).max() < 1e-9:
            break
    return _fold(beta[:-1], beta[-1], mean[:k], spread)


def linear_score(coefficients: tuple[tuple[float, ...], float], features: list[str] = FEATURES) -> Column:
    """Weighted sum of the feature columns plus the bias, in feature order."""
    weights, bias = coefficients
    total = F.lit(bias)
    for name, w in zip(features, weights):
        total = total + F.col(name) * F.lit(w)
    return total


def heuristic_score() -> Column:
    return F.least(
        F.lit(100.0),
        F.col("loc_100") * 20.0 + F.col("depth") * 10.0 + F.col("params") * 5.0
        + (F.lit(1.0) - F.col("documented")) * 15.0 + F.col("globals") * 8.0,
    )


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 50, "MEDIUM").otherwise("LOW")


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FEATURES]


def bug_risk_heuristic(features: DataFrame, floor: float = 40.0) -> DataFrame:
    score = heuristic_score()
    return features.filter(score >= floor).select(
        *_columns(features), round_half_up(score, 1).alias("risk_score"),
        risk_band(score).alias("risk_level"),
        F.array().cast("array<string>").alias("factors"),
    )


#: factors that the reference names at most
REFERENCE_FACTORS = 4


def bug_risk_model(
    features: DataFrame, floor: float = 40.0, max_factors: int | None = None,
    coefficients: tuple[tuple[float, ...], float] | None = None,
) -> DataFrame:
    """Model probability times 70 plus bonuses for conspicuous features; ``factors`` names all or ``max_factors`` of them.

    ``coefficients`` are those of ``fit_bug_risk``; by default those of the fixed rows.
    """
    odds = linear_score(coefficients or bug_coefficients())
    base = F.lit(70.0) / (F.lit(1.0) + F.exp(-odds))
    loc = F.col("loc_100") * 100.0
    whole = lambda c: F.floor(c + F.lit(1e-9)).cast("int").cast("string")
    # condition, points, text
    signs = [
        (loc > 80.0 + 1e-9, 8.0, F.concat(F.lit("Function is "), whole(loc), F.lit(" lines"))),
        (F.col("depth") >= 5, 10.0, F.concat(F.lit("Nesting depth "), whole(F.col("depth")))),
        (F.col("params") >= 6, 7.0, F.concat(whole(F.col("params")), F.lit(" parameters"))),
        (F.col("documented") < 0.5, 5.0, F.lit("No documentation")),
        (F.col("globals") >= 2, 6.0,
         F.concat(whole(F.col("globals")), F.lit(" global accesses"))),
    ]
    bonus = F.lit(0.0)
    for test, points, _ in signs:
        bonus = bonus + F.when(test, F.lit(points)).otherwise(F.lit(0.0))
    factors = first_items(F.array_compact(F.array(*[F.when(t, text) for t, _, text in signs])), max_factors)
    scored = features.withColumn("_score", F.least(F.lit(100.0), base + bonus))
    return scored.filter(F.col("_score") >= floor).select(
        *_columns(features), round_half_up(F.col("_score"), 1).alias("risk_score"),
        risk_band(F.col("_score")).alias("risk_level"), factors.alias("factors"),
    )


def complexity_model(
    features: DataFrame, floor: float = 40.0, coefficients: tuple[tuple[float, ...], float] | None = None
) -> DataFrame:
    """Predicted complexity next to the cyclomatic number in column ``complexity``; ``coefficients`` as of ``fit_complexity``."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), linear_score(coefficients or complexity_coefficients())))
    scored = features.withColumn("_score", score).withColumn(
        "_delta", F.col("_score") - F.col("complexity") * 10.0
    )
    deceptive = (F.col("_delta") > 20) & (F.col("complexity") <= 5)
    return scored.filter((F.col("_score") >= floor) | deceptive).select(
        *_columns(features), round_half_up(F.col("_score"), 1).alias("ml_complexity"),
        round_half_up(F.col("_delta"), 1).alias("delta"), deceptive.alias("deceptive"),
    )


def complexity_heuristic(features: DataFrame, floor: float = 40.0) -> DataFrame:
    score = heuristic_score()
    return features.filter(score >= floor).select(
        *_columns(features), round_half_up(score, 1).alias("ml_complexity"),
        F.lit(1).alias("cyclomatic"), F.lit(0.0).alias("delta"), F.lit(False).alias("deceptive"),
    )


def ml_summary(**results: DataFrame) -> DataFrame:
    """Row counts of the model results of each repository.

    ``results``: name -> table with a ``repo`` column and optionally a boolean
    ``counted`` column that says which rows count.
    """
    rows = None
    for name, table in results.items():
        counted = F.col("counted") if "counted" in table.columns else F.lit(True)
        part = table.select("repo", F.lit(name).alias("what"), counted.alias("counted"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("repo").agg(
        *[F.count_if((F.col("what") == name) & F.col("counted")).alias(name) for name in results]
    )
