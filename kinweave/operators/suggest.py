"""Scored suggestions: the best per left record, and one-sided or mutual relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RELATIONS = ("m:m", "1:m", "m:1", "1:1")


def linear_score(intercept: float, weights: dict[str, float], link: str = "logit") -> Column:
    """Probability of a fixed linear model over feature columns."""
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.col(name) * float(w)
    if link != "logit":
        raise ValueError("only the logit link has an expression")
    return 1.0 / (1.0 + F.exp(-z))


def top_k(scored: DataFrame, k: int = 10, left: str = "left", right: str = "right", prediction: str = "prediction") -> DataFrame:
    """The ``k`` best rights of every left, ties to the smaller right; pruned before the shuffle."""
    w = Window.partitionBy(left).orderBy(F.col(prediction).desc(), F.col(right).asc())
    return scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def relation(scored: DataFrame, kind: str = "m:m", left: str = "left", right: str = "right", prediction: str = "prediction") -> DataFrame:
    """m:m all; 1:m the best of each left; m:1 the best of each right; 1:1 first by left, then by right."""
    if kind not in RELATIONS:
        raise ValueError(f"relation must be one of {RELATIONS}")

    def best(df: DataFrame, by: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(F.col(prediction).desc(), F.col(left), F.col(right))
        return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")

    if kind in ("1:m", "1:1"):
        scored = best(scored, left)
    if kind in ("m:1", "1:1"):
        scored = best(scored, right)
    return scored
