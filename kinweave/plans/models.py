"""Match classifiers on feature columns: logit, probit, boosted trees."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.operators import metrics
from kinweave.operators.suggest import top_k
from kinweave.spec import MatchSpec

RIDGE_LADDER = (1e-3, 1e-2, 1e-1, 1.0, 10.0)


def feature_columns(df: DataFrame, prefix: str = "col_") -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


def to_xy(df: DataFrame, match_col: str = "match", prefix: str = "col_") -> tuple[DataFrame, list[str]]:
    """(features VECTOR, label DOUBLE) over the prefixed columns in sorted order, and their names."""
    cols = feature_columns(df, prefix)
    xy = VectorAssembler(inputCols=cols, outputCol="features").transform(metrics.clean_features(df, cols)) if cols else df
    return xy.withColumn("label", F.coalesce(F.col(match_col).cast("double"), F.lit(0.0))), cols


def compact(df: DataFrame, rows_a_part: int = 100_000) -> DataFrame:
    """The table cached, in no more parts than its size needs: iterative fits run a job per step."""
    held = df.persist()
    parts = held.count() // rows_a_part + 1
    if parts >= held.rdd.getNumPartitions():
        return held
    small = held.coalesce(parts).persist()  # what the caller frees is what is held
    small.count()
    held.unpersist()
    return small


class MatchingModel:
    """What the classifiers share: scoring, evaluation, suggestions, persistence."""

    kind = ""

    def __init__(self):
        self.features: list[str] = []
        self.best_threshold: float | None = None
        self.spec: MatchSpec | None = None

    def _training(self, df: DataFrame, match_col: str, prefix: str) -> DataFrame:
        """Features and label, without columns of one value."""
        if match_col not in df.columns:
            raise ValueError(f"no column {match_col}")
        cols = feature_columns(df, prefix)
        if not cols:
            raise ValueError(f"no features with prefix {prefix}")
        clean = metrics.clean_features(df, cols).withColumn("label", F.coalesce(F.col(match_col).cast("double"), F.lit(0.0)))
        self.features = metrics.varying_columns(clean, cols)
        if not self.features:
            raise ValueError("every feature has one value only")
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(clean)

    def probability(self) -> Column | None:
        """The score as an expression, where the model has one."""
        return None

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the probability of a match."""
        p = self.probability()
        if p is None:
            raise NotImplementedError
        return metrics.clean_features(df, self.features).withColumn("prediction", p)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.predict(df)

    def evaluate(self, df: DataFrame, match_col: str = "match", threshold: float = 0.5) -> dict[str, float]:
        return metrics.evaluate(self.predict(df), threshold, match_col)

    def suggest(self, pairs: DataFrame, left: str, right: str, count: int = 10) -> DataFrame:
        return top_k(self.predict(pairs).select(F.col(left).alias("left"), F.col(right).alias("right"), "prediction"), count)

    def tune_threshold(self, df: DataFrame, metric: str = "mcc", match_col: str = "match", store: bool = True) -> tuple[float, float]:
        r = metrics.best_threshold(self.predict(df), metric, match_col).first()
        if store:
            self.best_threshold = float(r["threshold"])
        return float(r["threshold"]), float(r["score"])

    def _meta(self) -> dict:
        return {"kind": self.kind, "features": self.features, "best_threshold": self.best_threshold, "similarity_map": self.spec.to_dict() if self.spec else None}

    def save(self, target: str, name: str, spec=None, overwrite: bool = True) -> str:
        """Writes target/name/model: JSON, and the trees where there are any."""
        if spec is not None:
            self.spec = MatchSpec.of(spec)
        path = f"{target}/{name}/model"
        if os.path.exists(path):
            if not overwrite:
                raise FileExistsError(path)
            shutil.rmtree(path)
        os.makedirs(path)
        with open(f"{path}/meta.json", "w") as f:
            json.dump(self._meta(), f, indent=1)
        return path


class _Linear(MatchingModel):
    def __init__(self, **own):
        super().__init__()
        self.intercept, self.weights, self.p_values, self.std_errors, self.penalty = 0.0, {}, {}, {}, 0.0

    def _prepared(self, df: DataFrame, match_col: str, prefix: str) -> DataFrame:
        return compact(self._training(compact(df), match_col, prefix))

    def _z(self) -> Column:
        z = F.lit(float(self.intercept))
        for c, w in self.weights.items():
            z = z + F.col(c) * float(w)
        return z

    def _take(self, model, inference: bool) -> None:
        self.intercept, self.weights = float(model.intercept), dict(zip(self.features, map(float, model.coefficients)))
        if inference:
            try:
                self.p_values = dict(zip([*self.features, "intercept"], map(float, model.summary.pValues)))
                self.std_errors = dict(zip([*self.features, "intercept"], map(float, model.summary.coefficientStandardErrors)))
            except Exception:  # noqa: BLE001  # not available for penalised or singular fits
                self.p_values, self.std_errors = {}, {}

    def summary(self) -> list[dict]:
        rows = [("intercept", self.intercept), *self.weights.items()]
        return [{"feature": c, "coefficient": w, "std_error": self.std_errors.get(c), "p_value": self.p_values.get(c)} for c, w in rows]

    def _meta(self) -> dict:
        return super()._meta() | {"intercept": self.intercept, "weights": self.weights, "p_values": self.p_values, "std_errors": self.std_errors, "penalty": self.penalty}


class LogitModel(_Linear):
    """Maximum likelihood with standard errors; where the features are collinear or the classes separate, a growing ridge."""

    kind = "logit"

    def fit(self, df: DataFrame, match_col: str = "match", prefix: str = "col_") -> LogitModel:
        data = self._prepared(df, match_col, prefix)
        try:
            self.penalty = 0.0
            try:
                m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=100, tol=1e-10).fit(data)
                usable = max(map(abs, (*m.coefficients, m.intercept))) < 30 and not self._collinear(data)
            except Exception:  # noqa: BLE001  # singular normal equations
                usable = False
            if usable:
                self._take(m, True)
                return self
            for ridge in RIDGE_LADDER:
                self.penalty = ridge
                m = LogisticRegression(regParam=ridge, elasticNetParam=0.0, maxIter=300).fit(data)
                if max(map(abs, (*m.coefficients, m.intercept))) < 1e4:
                    self._take(m, False)
                    return self
            raise RuntimeError("no ridge made the fit converge")
        finally:
            data.unpersist()

    def _collinear(self, data: DataFrame) -> bool:
        return any(abs(r) > 1 - 1e-9 for r in metrics.correlations(data, self.features).values())

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self._z()))


class ProbitModel(_Linear):
    """Probit likelihood with a slight ridge, enlarged until the fit converges."""

    kind = "probit"

    def __init__(self):
        super().__init__()
        self._model = None

    def fit(self, df: DataFrame, match_col: str = "match", prefix: str = "col_") -> ProbitModel:
        data = self._prepared(df, match_col, prefix)
        try:
            for ridge in (1e-4, *RIDGE_LADDER):
                try:
                    self._model = GeneralizedLinearRegression(family="binomial", link="probit", regParam=ridge, maxIter=100).fit(data)
                    self.penalty = ridge
                    self._take(self._model, False)
                    return self
                except Exception:  # noqa: BLE001
                    continue
            raise RuntimeError("no ridge made the fit converge")
        finally:
            data.unpersist()

    def probability(self) -> Column:
        """The normal distribution function, by the error function's rational approximation (absolute error below 1.5e-7)."""
        x = self._z() / float(2**0.5)
        t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
        poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
        erf = F.signum(x) * (1.0 - poly * F.exp(-x * x))
        return 0.5 * (1.0 + erf)


class BoostedModel(MatchingModel):
    """Gradient-boosted trees, optionally with balanced class weights."""

    kind = "gb"

    def __init__(self, trees: int = 300, rate: float = 0.05, depth: int = 3, seed: int = 42):
        super().__init__()
        self.trees, self.rate, self.depth, self.seed, self.model = trees, rate, depth, seed, None

    def fit(self, df: DataFrame, match_col: str = "match", prefix: str = "col_", use_class_weight: bool = False) -> BoostedModel:
        data = self._training(compact(df), match_col, prefix)
        gbt = GBTClassifier(maxIter=self.trees, stepSize=self.rate, maxDepth=self.depth, subsamplingRate=1.0, seed=self.seed)
        if use_class_weight:
            w = metrics.class_weights(df, match_col).first()
            data = data.withColumn("w", F.when(F.col("label") == 1, w["w_pos"]).otherwise(w["w_neg"]))
            gbt = gbt.setWeightCol("w")
        self.model = gbt.fit(compact(data))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        x = VectorAssembler(inputCols=self.features, outputCol="features").transform(metrics.clean_features(df, self.features))
        drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c not in df.columns]
        out = self.model.setPredictionCol("__class").transform(x)
        return out.withColumn("prediction", vector_to_array("probability")[1]).drop("__class", *[c for c in drop if c != "prediction"])

    def summary(self, top_k: int = 20) -> list[tuple[str, float]]:
        return sorted(zip(self.features, map(float, self.model.featureImportances.toArray())), key=lambda x: -x[1])[:top_k]

    def save(self, target: str, name: str, spec=None, overwrite: bool = True) -> str:
        path = super().save(target, name, spec, overwrite)
        self.model.write().overwrite().save(f"{path}/trees")
        return path


def make_model(kind: str, **own) -> MatchingModel:
    kinds = {"logit": LogitModel, "probit": ProbitModel, "gb": BoostedModel}
    if kind not in kinds:
        raise ValueError(f"model kind must be one of {sorted(kinds)}")
    return kinds[kind](**own)


def load_model(path: str) -> MatchingModel:
    """A saved model; a similarity map missing in its JSON is looked for beside the model folder."""
    with open(f"{path}/meta.json") as f:
        meta = json.load(f)
    m = make_model(meta["kind"])
    m.features, m.best_threshold = meta["features"], meta["best_threshold"]
    beside = os.path.join(os.path.dirname(path.rstrip("/")), "similarity_map.json")
    if meta["similarity_map"]:
        m.spec = MatchSpec.of(meta["similarity_map"])
    elif os.path.exists(beside):
        with open(beside) as f:
            m.spec = MatchSpec.of(json.load(f))
    if isinstance(m, BoostedModel):
        m.model = GBTClassificationModel.load(f"{path}/trees")
    else:
        m.intercept, m.weights, m.p_values, m.std_errors, m.penalty = (meta[k] for k in ("intercept", "weights", "p_values", "std_errors", "penalty"))
    return m
