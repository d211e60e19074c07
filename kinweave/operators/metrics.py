"""Quality measures of scored pairs, losses, class weights and column statistics; each is one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.runtime import Shelf

COUNTS = ("TP", "FP", "TN", "FN")


def metrics_from_counts(tp: float, fp: float, tn: float, fn: float) -> dict[str, float]:
    """Counts, Accuracy, Recall, Precision, F1 and MCC; a zero denominator gives 0."""
    div = lambda a, b: a / b if b else 0.0
    recall, precision = div(tp, tp + fn), div(tp, tp + fp)
    root = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "TP": tp, "FP": fp, "TN": tn, "FN": fn, "Accuracy": div(tp + tn, tp + fp + tn + fn), "Recall": recall, "Precision": precision,
        "F1": div(2 * precision * recall, precision + recall), "MCC": div(tp * tn - fp * fn, root),
    }


def _quality(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    d = lambda c: c.cast("double")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, precision = div(d(tp), d(tp + fn)), div(d(tp), d(tp + fp))
    root = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    return {
        "accuracy": div(d(tp + tn), d(tp + fp + tn + fn)), "recall": recall, "precision": precision,
        "f1": div(2 * precision * recall, precision + recall), "mcc": div(d(tp) * d(tn) - d(fp) * d(fn), root),
    }


def confusion(scored: DataFrame, threshold: float = 0.5, label: str = "match", prediction: str = "prediction") -> DataFrame:
    """One row: the four counts and the measures; scores equal to the threshold count as matches."""
    yes, said = F.coalesce(F.col(label) == 1, F.lit(False)), F.coalesce(F.col(prediction) >= threshold, F.lit(False))
    n = scored.agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn"))
    return n.withColumns(_quality(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def evaluate(scored: DataFrame, threshold: float = 0.5, label: str = "match", prediction: str = "prediction") -> dict[str, float]:
    r = confusion(scored, threshold, label, prediction).first()
    return metrics_from_counts(r["tp"], r["fp"], r["tn"], r["fn"])


def threshold_curve(scored: DataFrame, label: str = "match", prediction: str = "prediction", steps: int = 100) -> DataFrame:
    """Measures at the thresholds 1/steps .. (steps-1)/steps from one pass: scores are counted by bucket."""
    yes = F.coalesce(F.col(label) == 1, F.lit(False)).cast("long")
    p = F.col(prediction)
    guess = F.floor(p * steps)
    # the comparison itself decides at a threshold, so that i/steps on either side is the same number
    exact = guess + F.when(p >= (guess + 1) / float(steps), 1).when(p < guess / float(steps), -1).otherwise(0)
    bucket = F.coalesce(F.least(F.greatest(exact, F.lit(0)), F.lit(steps - 1)), F.lit(0)).cast("int")
    by = scored.select(bucket.alias("b"), yes.alias("y")).groupBy("b").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = scored.sparkSession.range(0, steps).select(F.col("id").cast("int").alias("b"))
    full = grid.join(by, "b", "left").fillna(0, ["pos", "neg"])
    above, all_rows = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # `steps` rows
    c = full.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "allp": F.sum("pos").over(all_rows), "alln": F.sum("neg").over(all_rows)}).filter(F.col("b") > 0)
    c = c.select((F.col("b") / float(steps)).alias("threshold"), "tp", "fp", (F.col("alln") - F.col("fp")).alias("tn"), (F.col("allp") - F.col("tp")).alias("fn"))
    return c.withColumns(_quality(*[F.col(x) for x in ("tp", "fp", "tn", "fn")]))


def best_threshold(scored: DataFrame, metric: str = "mcc", label: str = "match", prediction: str = "prediction") -> DataFrame:
    """One row (threshold, score): the smallest threshold with the best measure."""
    if metric not in ("mcc", "f1"):
        raise ValueError("metric must be mcc or f1")
    curve = threshold_curve(scored, label, prediction)
    best = curve.agg(F.max_by(F.struct("threshold", F.col(metric).alias("score")), F.struct(F.round(metric, 12), -F.col("threshold"))).alias("m"))
    return best.select("m.threshold", "m.score")


def class_weights(labelled: DataFrame, label: str = "match") -> DataFrame:
    """One row (w_pos, w_neg): each class weighted by the share of the other; 1 and 1 if a class is empty."""
    yes = F.coalesce(F.col(label) == 1, F.lit(False))
    n = labelled.agg(F.count_if(yes).cast("double").alias("p"), F.count_if(~yes).cast("double").alias("q"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    share = lambda c: F.when(both, F.try_divide(F.col(c), F.col("p") + F.col("q"))).otherwise(1.0)
    return n.select(share("q").alias("w_pos"), share("p").alias("w_neg"))


def alpha_balanced(n_left: int, n_right: int, n_matches: int, mismatch_share: float = 1.0, max_alpha: float = 0.95) -> float:
    """The weight of positives that balances both classes, at most ``max_alpha``."""
    if n_matches <= 0 or n_left <= 0 or n_right <= 0:
        raise ValueError("both tables and the matches must have rows")
    negatives = mismatch_share * (n_left * n_right - n_matches)
    return min(negatives / (negatives + n_matches), max_alpha)


def _p(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(1e-7)), F.lit(1 - 1e-7))


def focal_loss(scored: DataFrame, alpha: float = 0.99, gamma: float = 1.5, label: str = "match", prediction: str = "prediction") -> DataFrame:
    """One row (loss): mean of alpha_t (1 - p_t)^gamma (-ln p_t)."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    p, y = _p(F.col(prediction)), F.col(label) == 1
    pt, at = F.when(y, p).otherwise(1 - p), F.when(y, alpha).otherwise(1 - alpha)
    return scored.agg(F.avg(at * F.pow(1 - pt, F.lit(float(gamma))) * -F.ln(pt)).alias("loss"))


def soft_f1_loss(scored: DataFrame, epsilon: float = 1e-7, label: str = "match", prediction: str = "prediction") -> DataFrame:
    """One row (loss): 1 less the F1 of the soft counts."""
    p, y = F.col(prediction), F.col(label).cast("double")
    n = scored.agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"))
    loss = 1 - F.try_divide(2 * F.col("tp") + epsilon, 2 * F.col("tp") + F.col("fp") + F.col("fn") + epsilon)
    return n.select(F.coalesce(F.when(~F.isnan(loss), loss), F.lit(1.0)).alias("loss"))


def combined_loss(scored: DataFrame, weight_f1: float = 0.5, epsilon: float = 1e-7, alpha: float = 0.99, gamma: float = 1.5, label: str = "match", prediction: str = "prediction") -> DataFrame:
    if not 0 <= weight_f1 <= 1 or epsilon <= 0 or not 0 < alpha < 1 or gamma < 0:
        raise ValueError("weight_f1 in [0, 1], epsilon above 0, alpha in (0, 1) and gamma not negative")
    f, s = focal_loss(scored, alpha, gamma, label, prediction).withColumnRenamed("loss", "f"), soft_f1_loss(scored, epsilon, label, prediction).withColumnRenamed("loss", "s")
    return s.crossJoin(f).select((weight_f1 * F.col("s") + (1 - weight_f1) * F.col("f")).alias("loss"))  # one row each


def average_precision(scored: DataFrame, label: str = "match", prediction: str = "prediction") -> DataFrame:
    """One row (average_precision): sum of precision times gained recall over the distinct scores, best first.

    Rows are counted per score before anything is ordered; the distinct scores
    are cut into ranges of about equal size, however the scores lie, and the
    totals of the ranges before are added, so no task orders all of them.
    """
    spark, y = scored.sparkSession, F.coalesce(F.col(label) == 1, F.lit(False)).cast("long")
    by = scored.select(F.col(prediction).alias("s"), y.alias("y")).groupBy("s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = by.repartitionByRange(n, F.desc("s")).withColumn("r", F.spark_partition_id())
    cut = Shelf(spark, "precision").put(cut, "scores")
    per = cut.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))  # one row a range
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("r", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("bn"), F.sum("rp").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.join(F.broadcast(per), "r").withColumns({"tp": F.col("bp") + F.sum("pos").over(inside), "seen": F.col("bn") + F.sum("n").over(inside)})
    gain = F.coalesce(F.try_divide(F.col("pos").cast("double"), F.col("all").cast("double")), F.lit(0.0)) * F.col("tp") / F.col("seen")
    return run.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision"))


def clean_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Infinite, NaN and null features become 0."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return df.withColumns({c: F.when(ok(c), F.col(c).cast("double")).otherwise(0.0) for c in features})


def varying_columns(df: DataFrame, features: list[str]) -> list[str]:
    """The columns with more than one value, from one aggregation."""
    if not features:
        return []
    r = df.agg(*[F.min(c).alias(f"lo{k}") for k, c in enumerate(features)], *[F.max(c).alias(f"hi{k}") for k, c in enumerate(features)]).first()
    return [c for k, c in enumerate(features) if r[f"lo{k}"] is not None and r[f"lo{k}"] < r[f"hi{k}"]]


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Pearson correlation of every two columns (none of them constant), from one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    if not pairs:
        return {}
    r = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    return {p: float(r[f"c{k}"]) for k, p in enumerate(pairs)}
