"""Choosing similarity features: correlation filter, then elastic net with cross-validation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators import metrics
from kinweave.operators.pairs import order_hash
from kinweave.plans.models import compact
from kinweave.spec import MatchSpec


@dataclass(frozen=True)
class SelectionResult:
    spec: MatchSpec
    features: list[str]
    coefficients: dict[str, float]
    dropped: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)


def correlation_filter(df: DataFrame, features: list[str], label: str, limit: float) -> tuple[list[str], list[str]]:
    """(kept, dropped): in order, a column joins the kept earlier ones it correlates with beyond ``limit``; of such
    a group the one most correlated with the label stays."""
    corr = metrics.correlations(df, [*features, label])
    r = lambda a, b: abs(corr.get((a, b), corr.get((b, a), 0.0)))
    kept: list[str] = []
    for c in features:
        group = [k for k in kept if r(k, c) > limit]
        best = max([*group, c], key=lambda x: (r(x, label), -features.index(x)))
        kept = [k for k in kept if k not in group or k == best]
        if best == c:
            kept.append(c)
    return kept, [c for c in features if c not in kept]


def stratified_folds(df: DataFrame, keys: list[str], label: str, folds: int, seed: int = 42) -> DataFrame:
    """``fold`` 0..folds-1, dealt round robin within each label.

    Rows are dealt within 256 hash groups of each label and the groups start at
    different folds, so no task orders a whole class.
    """
    h = order_hash(seed, *keys)
    part = F.pmod(F.xxhash64(h), F.lit(256))
    w = Window.partitionBy(label, part).orderBy(h, *keys)
    return df.withColumn("fold", ((F.row_number().over(w) + part) % folds).cast("int"))


def select_features(
    pairs: DataFrame, spec, keys: list[str], match_col: str = "match", *, cv: int = 5, l1_ratios=(0.8, 0.9, 1.0), cs=None, class_weight: str | None = "balanced", max_iter: int = 200, seed: int = 42,
    min_coef: float = 0.0, max_correlation: float | None = None, always_keep: tuple[str, ...] = (), scoring: str = "average_precision",
) -> SelectionResult:
    """The triples of a similarity map that an elastic-net logit keeps, at the penalty with the best mean fold score."""
    if scoring not in ("average_precision", "f1", "mcc"):
        raise ValueError("scoring must be average_precision, f1 or mcc")
    spec = MatchSpec.of(spec)
    cs = list(np.logspace(-2, 3, 20)) if cs is None else list(cs)
    data = compact(metrics.clean_features(pairs, spec.features).withColumn("label", F.coalesce(F.col(match_col).cast("double"), F.lit(0.0))))
    try:
        positives = data.filter(F.col("label") == 1).count()
        if positives < cv:
            raise ValueError(f"{positives} positives are too few for {cv} folds")
        n = data.count()
        features = metrics.varying_columns(data, spec.features)
        if not features:
            raise ValueError("every feature has one value only")
        dropped: list[str] = []
        if max_correlation is not None:
            features, dropped = correlation_filter(data, features, "label", max_correlation)
        moments = data.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(features)]).first()
        scaled = data.select(*keys, "label", *[((F.col(c) - moments[f"m{k}"]) / (moments[f"s{k}"] or 1.0)).alias(c) for k, c in enumerate(features)])
        w = {1.0: n / (2.0 * positives), 0.0: n / (2.0 * max(1, n - positives))} if class_weight == "balanced" else {1.0: 1.0, 0.0: 1.0}
        scaled = scaled.withColumn("w", F.when(F.col("label") == 1, w[1.0]).otherwise(w[0.0]))
        ready = VectorAssembler(inputCols=features, outputCol="features").transform(stratified_folds(scaled, keys, "label", cv, seed))
        ready = compact(ready)
        total = float(ready.agg(F.sum("w")).first()[0])

        def fit(df: DataFrame, weight: float, l1: float, c: float):
            return LogisticRegression(regParam=1.0 / (c * weight), elasticNetParam=float(l1), standardization=False, weightCol="w", maxIter=max_iter).fit(df)

        scores: dict[tuple[float, float], list[float]] = {}
        for k in range(cv):
            train, held = ready.filter(F.col("fold") != k).persist(), ready.filter(F.col("fold") == k).persist()
            weight = float(train.agg(F.sum("w")).first()[0])
            for l1 in l1_ratios:
                for c in cs:
                    p = fit(train, weight, l1, c).transform(held).select("label", vector_to_array("probability")[1].alias("p"))
                    if scoring == "average_precision":
                        s = metrics.average_precision(p, "label", "p").first()[0]
                    else:
                        s = metrics.evaluate(p, 0.5, "label", "p")["F1" if scoring == "f1" else "MCC"]
                    scores.setdefault((float(l1), float(c)), []).append(float(s))
            train.unpersist()
            held.unpersist()
        best = max(scores, key=lambda k: (round(sum(scores[k]) / cv, 12), -list(scores).index(k)))
        coef = dict(zip(features, map(float, fit(ready, total, *best).coefficients)))
        ready.unpersist()
    finally:
        data.unpersist()
    chosen = [c for c in features if (abs(coef[c]) >= min_coef if min_coef > 0 else coef[c] != 0.0)]
    chosen += [c for c in spec.features if c in always_keep and c not in chosen]
    out = spec.restricted_to(chosen) if chosen else spec
    ranked = dict(sorted(coef.items(), key=lambda x: -abs(x[1])))
    return SelectionResult(out, out.features, ranked, dropped, {"l1_ratio": best[0], "C": best[1], "score": sum(scores[best]) / cv, "n": n, "positives": positives})
