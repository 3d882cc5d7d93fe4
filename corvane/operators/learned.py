"""A learned linear ranker over few features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ranker:
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def logit(self, features: list[str]) -> Column:
        """Linear, not a probability."""
        return sum(((F.col(f) - m) / s * w for f, m, s, w in zip(features, self.means, self.scales, self.weights)), start=F.lit(self.bias))


def fit(rows: DataFrame, features: list[str], label: str, split: str | None = "split", steps: int = 500, rate: float = 0.05, l2: float = 0.01) -> Ranker:
    """Class-balanced logistic regression by full gradient steps: each is one aggregate over the cached rows.

    Refuses rows of any split but validation. The gradient comes back as one row, however many rows there are.
    """
    if split is not None and split in rows.columns and not rows.filter(F.col(split) != "validation").isEmpty():
        raise ValueError("the ranker is fitted on validation rows only")
    stats = rows.agg(*(F.avg(f) for f in features), *(F.stddev_pop(f) for f in features), F.sum((F.col(label) == 1).cast("double")), F.count(F.lit(1))).first()
    n = len(features)
    means, scales = tuple(stats[:n]), tuple(s or 1.0 for s in stats[n : 2 * n])
    ones, count = stats[2 * n], stats[2 * n + 1]
    if not 0 < ones < count:
        raise ValueError("both labels are needed")
    std = rows.select(*(((F.col(f) - m) / s).alias(f"x{i}") for i, (f, m, s) in enumerate(zip(features, means, scales))), F.col(label).cast("double").alias("y"), F.when(F.col(label) == 1, 0.5 / ones).otherwise(0.5 / (count - ones)).alias("c")).persist()
    weights, bias = [0.0] * n, 0.0
    for _ in range(steps):
        z = sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), start=F.lit(bias))
        z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))
        error = F.col("c") * (1 / (1 + F.exp(-z)) - F.col("y"))
        g = std.agg(*(F.sum(error * F.col(f"x{i}")) for i in range(n)), F.sum(error)).first()
        weights = [w - rate * (g[i] + l2 * w) for i, w in enumerate(weights)]
        bias -= rate * g[n]
    std.unpersist()
    return Ranker(means, scales, tuple(weights), bias)
