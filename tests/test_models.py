import random

import pytest
from pyspark.sql import functions as F

from kinweave.plans import models, network, selection, training
from kinweave.sources import io


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(1)
    data = []
    for k in range(300):
        y = int(k % 3 == 0)
        x = min(1.0, max(0.0, rng.gauss(0.75 if y else 0.35, 0.2)))
        data.append((k, k + 1000, x, min(1.0, max(0.0, x + rng.gauss(0, 0.02))), rng.random(), 1.0, y))
    return spark.createDataFrame(data, "l long, r long, col_a_a_levenshtein double, col_a_a_cosine double, col_b_b_levenshtein double, col_b_b_notmissing double, match int").persist()


@pytest.mark.parametrize("kind,own", [("logit", {}), ("probit", {}), ("gb", {"trees": 10})])
def test_fit_save_load(spark, pairs, tmp_path, kind, own):
    m = models.make_model(kind, **own).fit(pairs)
    assert "col_b_b_notmissing" not in m.features
    e = m.evaluate(pairs)
    assert e["F1"] > 0.75 and sum(e[k] for k in ("TP", "FP", "TN", "FN")) == 300
    t, s = m.tune_threshold(pairs)
    assert 0 < t < 1 and m.best_threshold == t and s >= e["MCC"] - 1e-9
    path = m.save(str(tmp_path), "demo", {"a": ["levenshtein", "cosine"], "b": ["levenshtein"]})
    again = models.load_model(path)
    assert again.evaluate(pairs) == pytest.approx(e) and again.best_threshold == t and again.spec.features[0] == "col_a_a_levenshtein"
    with pytest.raises(FileExistsError):
        m.save(str(tmp_path), "demo", overwrite=False)
    assert m.suggest(pairs, "l", "r", 1).count() == 300


def test_logit_ridge_on_collinear(spark):
    d = spark.createDataFrame([(x / 10, x / 10, int(x > 4)) for x in range(10)], "col_a double, col_b double, match int")
    m = models.LogitModel().fit(d)
    assert m.penalty > 0 and m.evaluate(d)["F1"] == 1.0


def test_probit_matches_the_normal_curve(pairs):
    m = models.ProbitModel().fit(pairs)
    a = {r["l"]: r["prediction"] for r in m.predict(pairs).collect()}
    from pyspark.ml.feature import VectorAssembler

    b = m._model.transform(VectorAssembler(inputCols=m.features, outputCol="features").transform(pairs)).collect()
    assert max(abs(a[r["l"]] - r["prediction"]) for r in b) < 1e-5


def test_no_features(spark):
    with pytest.raises(ValueError):
        models.LogitModel().fit(spark.createDataFrame([(1,)], "match int"))
    with pytest.raises(ValueError):
        models.make_model("tree")


def test_selection(pairs):
    r = selection.select_features(pairs, {"a": ["levenshtein", "cosine"], "b": ["levenshtein", "notmissing"]}, ["l", "r"], cv=3, l1_ratios=(1.0,), cs=(0.02, 1.0), max_correlation=0.95)
    assert len(r.dropped) == 1 and ("col_a_a_levenshtein" in r.features or "col_a_a_cosine" in r.features) and "col_b_b_notmissing" not in r.features
    folds = selection.stratified_folds(pairs, ["l"], "match", 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and max(f["count"] for f in folds) < 120


def test_network(spark, pairs, tmp_path):
    m = network.NetworkModel({"a": ["levenshtein", "cosine"], "b": ["levenshtein"]}, width_scale=6, depth=1, record_scale=6, record_depth=1)
    m.fit(pairs, epochs=12, peak=0.1, loss="binary_crossentropy")
    assert len(m.history) == 12 and m.evaluate(pairs)["F1"] > 0.7
    again = network.load_network(m.save(str(tmp_path), "net"))
    assert again.evaluate(pairs) == pytest.approx(m.evaluate(pairs))
    assert network.describe(m.spec).startswith("a: 2 > 20 > 10 > 1")
    assert network.warmup_cosine(0, 1.0, 4, 10) == 0.25 and network.warmup_cosine(10, 1.0, 4, 10) == pytest.approx(0.1)


def test_network_gradients():
    import numpy as np

    rng = np.random.default_rng(0)
    y, p = np.array([1.0, 0, 1])[:, None], np.array([0.9, 0.2, 0.7])[:, None]
    sums = np.array([(y * p).sum(), ((1 - y) * p).sum(), (y * (1 - p)).sum(), 3.0])

    def loss(name, q):
        if name == "soft_f1":
            tp, fp, fn = (y * q).sum(), ((1 - y) * q).sum(), (y * (1 - q)).sum()
            return 1 - (2 * tp + 1e-7) / (2 * tp + fp + fn + 1e-7)
        if name == "focal":
            pt, at = np.where(y == 1, q, 1 - q), np.where(y == 1, 0.25, 0.75)
            return (at * (1 - pt) ** 2 * -np.log(pt)).mean()
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    for name in ("soft_f1", "focal", "binary_crossentropy"):
        g = network.loss_gradient(name, y, p, sums, 0.25, 2.0)
        for k in range(3):
            e = np.zeros_like(p)
            e[k] = 1e-6
            assert g[k, 0] == pytest.approx((loss(name, p + e) - loss(name, p - e)) / 2e-6, abs=1e-5)
    assert rng is not None


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(24)]
    l = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, name string")
    r = spark.createDataFrame([(k, w[:5] + "x" + w[6:]) for k, w in enumerate(words)], "id long, name string")
    m = spark.createDataFrame([(k, k) for k in range(24)], "left long, right long")
    out = training.train_pipeline(spark, "demo", {"name": ["levenshtein", "cosine"]}, (l, r, m), {"left": l, "right": r, "matches": m}, model_kind="logit", base_dir=str(tmp_path), mismatch_share_fit=0.5)
    assert out.test["F1"] > 0.9 and io.load_spec(f"{tmp_path}/demo/similarity_map.json").features == ["col_name_name_levenshtein", "col_name_name_cosine"]
    assert [x["data"] for x in spark.read.csv(f"{tmp_path}/demo/performance.csv", header=True).collect()] == ["test", "train"]
    with pytest.raises(ValueError):
        training.train_pipeline(spark, "demo", {"name": ["levenshtein"]}, (l, r, m), (l, r, m), model_kind="gb")


def test_two_stage_network(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20)]
    l = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id long, name string")
    r = spark.createDataFrame([(k, w[:5] + "x" + w[6:]) for k, w in enumerate(words)], "id long, name string")
    m = spark.createDataFrame([(k, k) for k in range(20)], "left long, right long")
    model, train, test = network.train_network({"name": ["levenshtein", "cosine"]}, (l, r, m), (l, r, m), epochs_1=10, epochs_2=2, mismatch_share_1=0.2, mismatch_share_2=0.5, stage1_loss="binary_crossentropy", peak_1=0.1, base_dir=str(tmp_path), width_scale=5, depth=1, record_scale=5, record_depth=1)
    assert train == test and train["F1"] > 0.6 and len(model.history) == 12
    assert (tmp_path / "network" / "stage_1" / "epoch_03" / "model" / "weights.npz").exists()
    with pytest.raises(ValueError):
        network.train_network({"name": ["levenshtein"]}, (l, r, m), (l, r, m), stage_1=False, stage_2=False)


def test_measured_steps_and_own_losses(spark):
    d = spark.createDataFrame([(k % 2, 0.9 * (k % 2) + 0.01 * (k % 5), 0.5 + 0.02 * (k % 7)) for k in range(60)], "match int, col_a_a_levenshtein double, col_a_a_cosine double")
    make = lambda: network.NetworkModel({"a": ["levenshtein", "cosine"]}, width_scale=3, depth=1, record_scale=3, record_depth=1)
    m = make()
    data = d.withColumn("label", F.col("match").cast("double")).select(*m.features, "label")
    assert m.measured_rate(data) in network.RATES
    slope = lambda y, p, totals: (p - y) / totals[3]
    fitted = make().fit(d, epochs=8, peak=None, weight_decay=None, loss=slope)
    assert len(fitted.history) == 8 and fitted.history[-1]["f1"] > 0.6
    assert make().fit(d, epochs=2, loss="combined").history
    with pytest.raises(ValueError):
        make().fit(d, loss="hinge")


def test_batch_size():
    assert training.required_batch_size(346, 346, 346, 0.01, 16) == (72, pytest.approx(16.1798, abs=1e-4))
    assert training.required_batch_size(346, 346, 346, 0.1, 8) == (284, pytest.approx(8.0))


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinweave.streaming.scoring import score_stream

    spark.createDataFrame([(1, "anna", "x"), (2, "otto", "y")], "id long, name string, b string").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([(7, "anna", "x"), (8, "hanna", "x"), (9, "otto", "x")], "id long, name string, b string")
    got = []
    s = spark.readStream.schema("id long, name string, b string").parquet(str(tmp_path / "in"))
    score_stream(s, table, {"name": ["levenshtein"]}, "id", "id", [("b", "b")], F.col("col_name_name_levenshtein"), lambda df, _: got.extend(df.collect()), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert [(x["id_left"], x["id_right"]) for x in got] == [(1, 7)]
