"""The training pipeline: features, sampling, fit, threshold, evaluation, export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from kinweave.functions.similarity import Similarities
from kinweave.operators.matches import unpack_split
from kinweave.operators.pairs import id_names, similarity_features, subsample_non_matches
from kinweave.plans.models import MatchingModel, load_model, make_model
from kinweave.sources.io import export_statistics
from kinweave.spec import MatchSpec


@dataclass
class TrainingResult:
    model: MatchingModel
    train: dict
    test: dict
    threshold: float
    paths: list[str] = field(default_factory=list)


def train_pipeline(
    spark, model_name: str, spec, training, testing, validation=None, *, model_kind: str = "gb", left_id: str = "id", right_id: str = "id", matches_left: str = "left", matches_right: str = "right",
    matches_are_positions: bool = False, block_on=None, sims: Similarities | None = None, mismatch_share_fit: float = 1.0, seed: int = 42, threshold: float = 0.5, tune_threshold: bool = True,
    tune_metric: str = "mcc", base_dir: str | None = None, export_model: bool = True, export_stats: bool = True, reload_check: bool = True, model_options: dict | None = None,
) -> TrainingResult:
    """Fits a match classifier on one split and measures it on whole train and test pairs.

    Boosted trees tune their threshold on ``validation`` if asked to.  With
    ``base_dir`` the model and its measures are written, and the written model
    is read back and must give the same measures.
    """
    spec = MatchSpec.of(spec)
    if model_kind == "gb" and tune_threshold and validation is None:
        raise ValueError("tuning the threshold needs validation data")
    keys = list(id_names(left_id, right_id))

    def pairs(split):
        s = unpack_split(split)
        return similarity_features(s.left, s.right, s.matches, spec, left_id, right_id, block_on=block_on, sims=sims, matches_left=matches_left, matches_right=matches_right, matches_are_positions=matches_are_positions).persist()

    train, test = pairs(training), pairs(testing)
    try:
        model = make_model(model_kind, **(model_options or {}))
        model.fit(subsample_non_matches(train, keys, mismatch_share_fit, seed))
        model.spec = spec
        if model_kind == "gb" and tune_threshold:
            held = pairs(validation)
            threshold, _ = model.tune_threshold(held, tune_metric)
            held.unpersist()
        result = TrainingResult(model, model.evaluate(train, threshold=threshold), model.evaluate(test, threshold=threshold), threshold)
        if base_dir and export_model:
            result.paths.append(model.save(base_dir, model_name, spec))
        if base_dir and export_stats:
            result.paths.append(export_statistics(spark, base_dir, model_name, spec, result.train, result.test))
        if base_dir and export_model and reload_check:
            again = load_model(f"{base_dir}/{model_name}/model").evaluate(test, threshold=threshold)
            if any(abs(again[k] - result.test[k]) > 1e-9 for k in again):
                raise RuntimeError("the written model gives other measures")
        return result
    finally:
        train.unpersist()
        test.unpersist()


def required_batch_size(n_matches: int, n_left: int, n_right: int, mismatch_share: float, desired_positives: int = 8) -> tuple[int, float]:
    """(rows, expected positives) of a batch that holds the desired positives."""
    negatives = mismatch_share * (n_left * n_right - n_matches)
    share = n_matches / max(n_matches + negatives, 1e-12)
    size = -int(-(desired_positives / max(share, 1e-12)) // 1)
    return size, size * share


def match_share(pairs, match_col: str = "match") -> float:
    return float(pairs.agg(F.avg(F.coalesce(F.col(match_col).cast("double"), F.lit(0.0)))).first()[0] or 0.0)
