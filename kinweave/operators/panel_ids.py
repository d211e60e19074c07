"""Consistent identifiers for the entities of repeated cross sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions.similarity import Similarities
from kinweave.operators.components import _jump
from kinweave.operators.pairs import candidate_pairs, score_pairs
from kinweave.operators.suggest import relation, top_k
from kinweave.runtime import Shelf, rows_of
from kinweave.spec import MatchSpec

Scorer = Callable[[DataFrame], DataFrame] | Column


def period_suggestions(
    panel: DataFrame, spec, scorer: Scorer, index: str, time: str, blocks: list[str] | None = None, threshold: float = 0.9, kind: str = "m:m", sims: Similarities | None = None, count: int = 1,
) -> DataFrame:
    """(left, right, prediction, period_left, period_right, periods_compared) between neighbouring periods.

    Periods are neighbours within their block, however far apart; rows with a
    null block or period are compared with none.  One equi-join on block and
    period rank covers all blocks and periods at once.
    """
    spec = MatchSpec.of(spec)
    blocks = blocks or []
    rows = panel.filter(F.col(time).isNotNull())
    for b in blocks:
        rows = rows.filter(F.col(b).isNotNull())
    slices = rows.select(*blocks, time).distinct()
    w = Window.partitionBy(*blocks).orderBy(time) if blocks else Window.orderBy(time)
    slices = slices.withColumn("__rank", F.dense_rank().over(w))  # one row per block and period
    ranked = rows.join(slices, [*blocks, time])
    own = [c for c in dict.fromkeys([index, *spec.left_columns, *spec.right_columns])]
    left = ranked.select(*own, *[F.col(b).alias(f"__b_{b}") for b in blocks], (F.col("__rank") + 1).alias("__at"), F.col(time).alias("__t"))
    right = ranked.select(*own, *[F.col(b).alias(f"__b_{b}") for b in blocks], F.col("__rank").alias("__at"), F.col(time).alias("__t"))
    on = [("__at", "__at"), *[(f"__b_{b}", f"__b_{b}") for b in blocks]]
    pairs = candidate_pairs(left, right, spec, index, index, on, unique=False)
    feats = score_pairs(pairs, spec, sims)
    scored = scorer(feats) if callable(scorer) else feats.withColumn("prediction", scorer)
    scored = scored.select(F.col(f"{index}_left").alias("left"), F.col(f"{index}_right").alias("right"), "prediction")
    kept = relation(top_k(scored, count).filter(F.col("prediction") >= threshold), kind)
    pl = panel.select(F.col(index).alias("left"), F.col(time).alias("period_left"))
    pr = panel.select(F.col(index).alias("right"), F.col(time).alias("period_right"))
    out = kept.join(pl, "left").join(pr, "right")
    compared = F.concat_ws("-", F.col("period_left").cast("string"), F.col("period_right").cast("string"))
    return out.select("left", "right", "prediction", "period_left", "period_right", compared.alias("periods_compared"))


def harmonize_ids(suggestions: DataFrame, panel: DataFrame, index: str, parent: str = "last", shelf: Shelf | None = None) -> DataFrame:
    """(index, index_harm): every row's root along its parents.

    If several lefts claim one right, the greatest left is its parent
    (``last``), or the one of highest prediction (``best``); the others stay
    roots of their own.  Roots are found by pointer jumping.
    """
    if parent not in ("last", "best"):
        raise ValueError("parent must be last or best")
    shelf = shelf or Shelf(panel.sparkSession, "harmonize")
    pick = F.max("left") if parent == "last" else F.max_by("left", F.struct("prediction", "left"))
    up = shelf.put(suggestions.groupBy(F.col("right").alias("u")).agg(pick.alias("p")), "parents")
    roots = _jump(up, shelf, rows_of(up))
    own = panel.select(index)
    return own.join(roots, F.col(index) == F.col("u"), "left").select(index, F.coalesce("p", F.col(index)).alias("index_harm"))


def hash_uuid(c: Column, seed: str = "") -> Column:
    """A reproducible identifier in the form of a UUID."""
    h = F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def assign_ids(mapping: DataFrame, index: str, panel_var: str = "panel_id", seed: str | None = "") -> DataFrame:
    """(index, panel_var): one identifier per root; random ones (written once) if ``seed`` is None."""
    if seed is not None:
        return mapping.select(index, hash_uuid(F.col("index_harm"), seed).alias(panel_var))
    roots = Shelf(mapping.sparkSession, "ids").put(mapping.select("index_harm").distinct().withColumn(panel_var, F.uuid()), "ids")
    return mapping.join(roots, "index_harm").select(index, panel_var)


def default_threshold(given, model, has_map: bool) -> float:
    """The given threshold; for None the model's own best one, else 0.9 with a similarity map, else 0.5."""
    if given is not None:
        return float(given)
    own = getattr(model, "best_threshold", None)
    return float(own) if own is not None else 0.9 if has_map else 0.5


def generate_ids(
    panel: DataFrame, panel_var: str, time: str, scorer: Scorer, spec, index: str = "index", threshold: float | None = 0.9, blocks: list[str] | None = None, kind: str = "m:m", parent: str = "last", seed: str | None = "",
) -> DataFrame:
    """(index, panel_var) of every row: suggestions between periods, roots, identifiers."""
    if not panel.groupBy(index).count().filter("count > 1").isEmpty():
        raise ValueError("the index must be unique")
    shelf = Shelf(panel.sparkSession, "panelids")
    found = shelf.put(period_suggestions(panel, spec, scorer, index, time, blocks, default_threshold(threshold, scorer, True), kind), "suggestions")
    return assign_ids(harmonize_ids(found, panel, index, parent, shelf), index, panel_var, seed)
