"""How frequent a value is in a reference corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.similarity import missing
from kinweave.runtime import skew_lookup

SCORINGS = ("relative", "minmax", "log")


def frequency_scores(values: DataFrame, column: str, scoring: str = "minmax", by: Column | None = None) -> DataFrame:
    """(value, score) of every non-missing value.

    relative: share of the rows; minmax: count scaled to 0..1, all 1 if equal;
    log: ln(1+count) over ln(1+greatest count).  Counts are pre-aggregated; the
    totals are one row.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {SCORINGS}")
    c = by if by is not None else F.col(column)
    kind = values.schema[column].dataType.typeName()
    counts = values.filter(~missing(F.col(column), kind)).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    score = {
        "relative": F.col("n") / F.col("all"),
        "minmax": F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.try_divide(F.col("n") - F.col("lo"), F.col("hi") - F.col("lo"))),
        "log": F.log1p("n") / F.log1p("hi"),
    }[scoring]
    return counts.crossJoin(F.broadcast(total)).select("value", score.cast("double").alias("score"))  # one row


def commonness(
    left: DataFrame, right: DataFrame, variables: list[str], left_full: DataFrame, right_full: DataFrame, source: str = "left", *, scoring: str = "minmax", fill_value: float = 0.0, preprocess: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``<variable>_commonness``; unseen and missing values get ``fill_value``.

    ``source`` is the reference corpus: left, right or both; ``preprocess``
    trims and lowers corpus and looked-up values alike.
    """
    if source not in ("left", "right", "both"):
        raise ValueError("source must be left, right or both")
    norm = (lambda c: F.lower(F.trim(c.cast("string")))) if preprocess else (lambda c: c)
    for v in variables:
        corpus = {"left": lambda: left_full.select(v), "right": lambda: right_full.select(v), "both": lambda: left_full.select(v).unionByName(right_full.select(v))}[source]()
        scores = frequency_scores(corpus, v, scoring, norm(F.col(v)))

        def add(df: DataFrame) -> DataFrame:
            keyed = df.withColumn("__k", norm(F.col(v)))
            out = skew_lookup(keyed, "__k", scores, "value", keyed.count(), "left")
            return out.withColumn(f"{v}_commonness", F.coalesce("score", F.lit(float(fill_value)))).drop("__k", "score")

        left, right = add(left), add(right)
    return left, right
