import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import kernels
from kinweave.operators import closure, dual_tree, matches as known, metrics, pairs, panel_ids, suggest, synthetic
from kinweave.operators.components import components_in_one_task, connected_components
from kinweave.operators.ordering import global_positions
from kinweave.runtime import Shelf, skew_lookup
from tests.conftest import rows


def test_pairs_names_labels_and_missing(spark):
    l = spark.createDataFrame([(1, "ab"), (2, None)], "id long, name string")
    r = spark.createDataFrame([(1, "ab"), (3, "ax")], "id long, name string")
    m = spark.createDataFrame([("1", "3"), ("1", "3")], "left string, right string")
    f = pairs.similarity_features(l, r, m, {"name": ["levenshtein"]}, "id", "id")
    assert f.columns == ["id_left", "id_right", "col_name_name_levenshtein", "match"]
    assert rows(f, *f.columns) == [(1, 1, 1.0, 0), (1, 3, 0.5, 1), (2, 1, 0.0, 0), (2, 3, 0.0, 0)]


def test_pairs_empty_side_and_duplicates(spark):
    l = spark.createDataFrame([(1, "ab")], "id long, name string")
    f = pairs.similarity_features(l, l.limit(0), None, {"name": ["levenshtein", "jaro_winkler"]}, "id", "id")
    assert f.count() == 0 and "col_name_name_jaro_winkler" in f.columns
    with pytest.raises(ValueError):
        pairs.similarity_features(l.union(l), l, None, {"name": ["levenshtein"]}, "id", "id")
    with pytest.raises(KeyError):
        pairs.similarity_features(l, l, None, {"name": ["unheard"]}, "id", "id")


def test_blocks_and_value_scoring_agree(spark):
    d = spark.createDataFrame([(k, n, b) for k, (n, b) in enumerate([("anna", "x"), ("hanna", "x"), ("anna", "y"), ("otto", None), ("", "y"), (None, "x")])], "id long, name string, b string")
    c = pairs.candidate_pairs(d, d, {"name": ["jaro_winkler"]}, "id", "id", [("b", "b")])
    a, b = pairs.score_pairs(c, {"name": ["jaro_winkler"]}), pairs.score_pairs(c, {"name": ["jaro_winkler"]}, distinct_values=False)
    assert c.count() == 9 + 4 and rows(a, *a.columns) == rows(b, *b.columns)


def test_positions_mode(spark):
    l = spark.createDataFrame([(30, "a"), (10, "b"), (20, "c")], "id long, name string")
    m = spark.createDataFrame([(0, 2)], "left long, right long")
    f = pairs.similarity_features(l, l, m, {"name": ["levenshtein"]}, "id", "id", matches_are_positions=True)
    assert rows(f.filter("match = 1"), "id_left", "id_right") == [(10, 30)]


def test_subsample(spark):
    d = spark.createDataFrame([(k, 1 if k < 3 else 0) for k in range(8)], "id long, match int")
    out = pairs.subsample_non_matches(d, ["id"], 0.5)
    assert out.filter("match = 1").count() == 3 and out.filter("match = 0").count() == 2
    with pytest.raises(ValueError):
        pairs.subsample_non_matches(d, ["id"], 0)


def test_reorder(spark):
    l, r = spark.createDataFrame([(100,), (200,), (300,)], "id long"), spark.createDataFrame([(20, 0), (10, 1), (40, 2)], "id long, o int")
    m = spark.createDataFrame([(100, 10), (200, 20), (999, 40)], "left_id long, right_id long")
    out = known.matches_reorder(l, r, m, "id", "id", "left_id", "right_id", order_right="o")
    assert [tuple(x) for x in out.collect()] == [(None, 2), (0, 1), (1, 0)]


@pytest.mark.parametrize("m,n", [([(0, 0), (1, 1), (3, 2), (2, 3), (4, 4)], 5), ([(0, 0), (0, 1), (1, 3), (2, 2), (3, 4)], 4)])
def test_split(spark, m, n):
    l, r = spark.createDataFrame([(k,) for k in range(n)], "_pos long"), spark.createDataFrame([(k,) for k in range(5)], "_pos long")
    ms = spark.createDataFrame(m, "left long, right long")
    parts = known.split_test_train(l, r, ms, test_ratio=0.2, validation_ratio=0.2)
    assert [p.matches.count() for p in parts] == [3, 1, 1]
    for p in parts:
        for side in (p.left, p.right):
            assert sorted(x["_pos"] for x in side.collect()) == list(range(side.count()))
        back = p.matches.join(p.left.select(F.col("_pos").alias("left"), F.col("index_original").alias("a")), "left").join(p.right.select(F.col("_pos").alias("right"), F.col("index_original").alias("b")), "right")
        assert set(rows(back, "a", "b")) <= set(m)
    again = known.split_test_train(l, r, ms, test_ratio=0.2, validation_ratio=0.2)
    assert rows(parts[2].matches, "left", "right") == rows(again[2].matches, "left", "right")
    with pytest.raises(known.SplitError):
        known.split_ranks(ms, 0.9, 0.2)


CLOSURE = [
    ([(i, c) for i, c in zip(range(1, 9), "abcdabcd")], [(1, 5), (2, 6), (3, 7), (4, 8)], {(1, 5), (2, 6), (3, 7), (4, 8)}),
    ([(1, "a"), (2, "b"), (3, "c"), (7, "c"), (5, "a"), (6, "b"), (7, "c"), (8, "c")], [(1, 5), (2, 6), (3, 7), (7, 8)], {(1, 5), (2, 6), (3, 7), (3, 8), (7, 8), (7, 7)}),
]


@pytest.mark.parametrize("panel,m,expected", CLOSURE)
def test_panel_closure(spark, panel, m, expected):
    out = closure.data_preparation_panel(spark.createDataFrame(panel, "id long, col string"), spark.createDataFrame(m, "l long, r long"), "id")
    assert rows(out.matches, "left", "right") == sorted(expected)
    assert {x["left"] for x in out.matches.collect()} == {x["id"] for x in out.left.collect()}
    assert {x["right"] for x in out.matches.collect()} == {x["id"] for x in out.right.collect()}


def test_panel_ids_link(spark):
    p = spark.createDataFrame([(10 * ((i + 1) // 2), i, "c") for i in range(1, 9)], "pid long, id long, col string")
    only = closure.data_preparation_panel(p, None, "id", "pid").matches
    assert rows(only, "left", "right") == [(1, 2), (3, 4), (5, 6), (7, 8)]
    both = closure.data_preparation_panel(p, spark.createDataFrame([(1, 8)], "left long, right long"), "id", "pid").matches
    assert set(rows(both, "left", "right")) == {(1, 2), (1, 7), (1, 8), (2, 7), (2, 8), (7, 8), (3, 4), (5, 6), (2, 2), (7, 7)}


def test_cs_closure(spark):
    l, r = spark.createDataFrame([(1, "a"), (3, "c"), (5, "e")], "id long, col string"), spark.createDataFrame([(2, "b"), (4, "d"), (6, "f")], "id long, col string")
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "left long, right long")
    out = closure.data_preparation_cs(l, r, m, "id").matches
    assert set(rows(out, "left", "right")) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6), (2, 2), (3, 3)} and out.count() == 9


def test_component_size_guard(spark):
    with pytest.raises(ValueError):
        closure.closure_pairs(spark.createDataFrame([(1, 2), (2, 3)], "left long, right long"), max_component=2)


def test_relations(spark):
    s = spark.createDataFrame([(1, 3, 0.95), (1, 4, 0.90), (2, 3, 0.85), (2, 3, 0.85), (3, 4, 0.80)], "left long, right long, prediction double").distinct()
    get = lambda k: rows(suggest.relation(s, k), "left", "right")
    assert len(get("m:m")) == 4 and get("1:m") == [(1, 3), (2, 3), (3, 4)] and get("m:1") == [(1, 3), (1, 4)] and get("1:1") == [(1, 3), (3, 4)]
    with pytest.raises(ValueError):
        suggest.relation(s, "x")


def test_drop_repetitions(spark):
    d = spark.createDataFrame([(3, 1), (1, 3), (5, 4), (2, 2)], "left long, right long")
    assert rows(closure.drop_repetitions(d), "left", "right") == [(1, 3), (2, 2), (5, 4)]


def test_roots(spark):
    p = spark.createDataFrame([(k,) for k in range(1, 7)], "idx long")
    s = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (4, 6, 0.99), (5, 6, 0.9)], "left long, right long, prediction double")
    assert rows(panel_ids.harmonize_ids(s, p, "idx"), "idx", "index_harm") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]
    assert (6, 4) in rows(panel_ids.harmonize_ids(s, p, "idx", "best"), "idx", "index_harm")


def test_generate_ids(spark):
    p = spark.createDataFrame([(1, 1900, "a", "anna"), (2, 1901, "a", "anna"), (3, 1905, "a", "anna"), (4, 1900, "b", "otto"), (5, 1901, "b", "paul"), (6, 1901, None, "anna")], "index long, year int, block string, name string")
    ids = {r["index"]: r["pid"] for r in panel_ids.generate_ids(p, "pid", "year", F.col("col_name_name_levenshtein"), {"name": ["levenshtein"]}, blocks=["block"]).collect()}
    assert ids[1] == ids[2] == ids[3] and len({ids[k] for k in (1, 4, 5, 6)}) == 4 and all(len(v) == 36 for v in ids.values())
    with pytest.raises(ValueError):
        panel_ids.generate_ids(p.union(p), "pid", "year", F.lit(1.0), {"name": ["levenshtein"]})


def test_metrics_published_counts():
    m = metrics.metrics_from_counts(305, 12, 119358, 41)
    assert m["F1"] == pytest.approx(0.920060, abs=1e-6) and m["MCC"] == pytest.approx(0.920725, abs=1e-6) and m["Accuracy"] == pytest.approx(0.999557, abs=1e-6)
    assert metrics.metrics_from_counts(0, 0, 0, 0)["MCC"] == 0.0


def test_losses_and_threshold(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.7)], "match int, prediction double")
    assert metrics.soft_f1_loss(d, 1e-6).first()[0] == pytest.approx(0.157894695, abs=1e-8)
    assert metrics.focal_loss(d, 0.25, 2.0).first()[0] == pytest.approx(0.004994298, abs=1e-7)
    assert tuple(metrics.best_threshold(d).first()) == pytest.approx((0.21, 1.0))
    assert metrics.average_precision(d).first()[0] == pytest.approx(1.0)
    assert metrics.evaluate(d, 0.7)["TP"] == 2
    with pytest.raises(ValueError):
        metrics.focal_loss(d, 2.0)
    with pytest.raises(ValueError):
        metrics.alpha_balanced(0, 1, 1)
    assert metrics.alpha_balanced(346, 346, 346, 0.1, 1.0) == pytest.approx(0.971830986)


def test_components_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 960)] + [(7, 7), (None, 3), (4, None)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = rows(connected_components(spark.createDataFrame(edges, "left long, right long")), "id", "group_id")
    assert got == sorted((x, find(x)) for x in list(parent))


def test_components_in_one_task(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(1990, 2000)] + [(7, 7), (None, 3), (4, None), (2**62, -(2**62))]
    for kind, given in (("long", edges), ("string", [tuple(x if x is None else f"ä{x}" for x in e) for e in edges])):
        d = spark.createDataFrame(given, f"left {kind}, right {kind}").repartition(5)
        assert rows(components_in_one_task(d), "id", "group_id") == rows(connected_components(d), "id", "group_id")
        assert components_in_one_task(d.limit(0)).count() == 0


def test_string_components_and_empty(spark):
    assert rows(connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "left string, right string")), "id", "group_id") == [("a", "a"), ("b", "a"), ("c", "a")]
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_global_positions(spark):
    d = spark.range(1000).withColumn("k", F.col("id") % 3)
    out = global_positions(d, [F.col("k"), F.col("id")], Shelf(spark, "t"))
    assert [r["pos"] for r in out.orderBy("k", "id").collect()] == list(range(1000))
    assert global_positions(d.limit(0), [F.col("id")], Shelf(spark, "t")).count() == 0


def test_skew_lookup_paths_agree(spark):
    d = spark.range(3000).withColumn("k", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 700))
    t = spark.range(500).select(F.col("id").alias("u"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain, hot, small = (rows(skew_lookup(d, "k", t, "u", n, how, table_rows=s).select("id", "v").fillna(-1), "id", "v") for n, s in ((3000, None), (10**7, None), (3000, 500)))
        assert plain == small and plain == hot


def brute_near(a, b, m):
    out = []
    for i, x, y in a:
        for j, u, v in b:
            h = math.sin(math.radians(u - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(u)) * math.sin(math.radians(v - y) / 2) ** 2
            if 2 * 6371.0088 * math.asin(min(1, math.sqrt(h))) * 1000 <= m:
                out.append((i, j))
    return sorted(out)


def test_dual_tree_against_brute_force(spark):
    import random

    rng = random.Random(5)
    spots = [(52.0, 13.0), (89.999, 10.0), (-10.0, 179.9999), (-10.0, -179.9999)]
    make = lambda n, o: [(o + k, *(lambda s: (max(-90.0, min(90.0, s[0] + rng.gauss(0, 0.002))), max(-180.0, min(180.0, s[1] + rng.gauss(0, 0.002)))))(rng.choice(spots))) for k in range(n)]
    a, b = make(150, 0), make(150, 1000)
    a += [(500 + k, 48.0, 8.0) for k in range(30)]
    b += [(1500 + k, 48.0, 8.0) for k in range(30)] + [(1600, 0.0, 0.0), (1601, None, 3.0), (1602, float("nan"), 3.0), (1603, 95.0, 3.0), (None, 48.0, 8.0), (1500, 48.0, 8.0)]
    l, r = spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "id long, lat double, lon double").withColumn("node", F.lit("clash"))
    got = rows(dual_tree.near_pairs(l, r, 250.0, spot_ids=7), "left_id", "right_id")  # crowded spots dealt over keys
    assert got == brute_near(a, [x for x in b[:-6]], 250.0)
    assert dual_tree.near_pairs(l.limit(0), r, 250.0).count() == 0


def test_only_points_below_decided_nodes_are_shuffled(spark):
    spots = spark.createDataFrame([(k / 40, k / 40) for k in range(-1600, 1600)], "lat double, lon double")
    at = dual_tree._locations(spots)
    some = at.limit(5).withColumn("node", dual_tree._node(F.lit(16))).select(F.lit(16).alias("level"), F.col("node").alias("a"))
    few = dual_tree._below(at, [(16, 5, some)], "a")
    assert few.count() == 5 and {r[0] for r in few.select("level").distinct().collect()} == {16}
    assert dual_tree._below(at, [(16, 10**9, some)], "a").count() == 3200  # one level, not all levels


def in_ring(ring, y, x):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(y1, y2) <= y <= max(y1, y2) and min(x1, x2) <= x <= max(x1, x2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_regions_against_brute_force(spark):
    import random

    rng = random.Random(3)
    points = [(k, rng.choice([rng.uniform(-90, 90), rng.gauss(50, 0.2)]), rng.choice([rng.uniform(-180, 180), rng.gauss(8, 0.2)])) for k in range(400)] + [(900 + k, 50.0, 8.0) for k in range(60)] + [(990, 49.0, 7.0)]
    star = lambda y, x, r, n: [(y + r * (1 if k % 2 else 0.4) * math.sin(2 * math.pi * k / n), x + r * (1 if k % 2 else 0.4) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    rings = {f"s{k}": star(rng.gauss(50, 0.2), rng.gauss(8, 0.2), rng.choice([0.01, 0.1, 0.5]), 10) for k in range(25)}
    rings |= {"world": [(-90.0, -180.0), (-90.0, 180.0), (90.0, 180.0), (90.0, -180.0)], "square": [(49.0, 7.0), (49.0, 8.0), (50.0, 8.0), (50.0, 7.0)], "far": star(100.0, 300.0, 5, 6), "speck": star(50.0, 8.0, 1e-9, 6)}
    want = sorted((i, name) for i, y, x in points for name, ring in rings.items() if in_ring(ring, y, x))
    bad = [(None, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), ("two", [(0.0, 0.0), (80.0, 80.0)]), ("null", None), ("gap", [(0.0, 0.0), (None, 90.0), (90.0, 0.0)]), ("square", rings["square"])]
    r = spark.createDataFrame([*rings.items(), *bad], "id string, ring array<struct<lat: double, lon: double>>").withColumn("lat", F.lit("clash"))
    p = spark.createDataFrame(points + points[:9] + [(None, 50.0, 8.0), (991, None, 8.0), (992, float("nan"), 8.0), (993, 0.0, 0.0)], "id long, lat double, lon double").withColumn("ring", F.lit("clash"))
    assert rows(dual_tree.containing_regions(p, r, leaf=3, spot_ids=20), "id", "region_id") == want
    assert dual_tree.containing_regions(p.limit(0), r).count() == 0 and dual_tree.containing_regions(p, r.limit(0)).count() == 0


def test_synthetic_rows(spark):
    data = [(k, f"name {k}", 20 + 3 * k, f"city{k % 4}", 1000.0 + 90 * k) for k in range(10)]
    r = spark.createDataFrame(data, "rid long, name string, age long, city string, salary double")
    out = synthetic.synth_mismatches(r, "rid", ["name"], ["age", "city", "salary"], str_similarity_range=(0.0, 0.9), n_cols=3, sample_share=0.5)
    syn = out.filter("synthetic").join(r.select("name", F.col("age").alias("a"), F.col("salary").alias("s")), "name").collect()
    assert out.filter("not synthetic").count() == 10 and len(syn) == 5
    assert all(0.0999 <= abs(x["salary"] - x["s"]) / x["s"] <= 0.2001 for x in syn)
    assert synthetic.synth_mismatches(r, "rid", ["name"], ["age"], sample_share=0.0).count() == 10
    blank = synthetic.synth_mismatches(r, "rid", ["name"], ["city", "age"], str_similarity_range=(0.0, 0.9), n_cols=2, nan_share=1.0).filter("synthetic")
    assert blank.filter("city is not null or age is not null").count() == 0 and blank.count() == 10
    with pytest.raises(ValueError):
        synthetic.synth_mismatches(r, "rid", [], ["age"], n_cols=2)


def test_large_components_are_whole(spark):
    chain = spark.range(20_001).select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    p = spark.range(20_002).select("id", F.lit("a").alias("col"))
    assert closure.data_preparation_panel(p, chain, "id").left.count() == 20_001  # without any pairs
    groups = spark.createDataFrame([(1, k) for k in range(1, 24)] + [(50, 50), (50, 51)], "group_id long, id long")
    assert rows(closure.linked_pairs(groups, "left", "right", 4), "left", "right") == [(a, b) for a in range(1, 24) for b in range(a + 1, 24)] + [(50, 51)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_value_pairs_are_scored_in_place(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 3)
    d = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(["anna", "hanna", "", "otto", None, "ärna", "a" * 70, "naan"])], "id long, name string, b int")
    f = pairs.similarity_features(d, d, None, {"name": ["jaro_winkler"]}, "id", "id", block_on=[("b", "b")])
    assert "Aggregate" not in _plan(f)  # no second pass over the pairs for their distinct values
    name = {r["id"]: r["name"] for r in d.collect()}
    want = {(i, j): kernels.jaro_winkler(name[i] or "", name[j] or "") for i in name for j in name if i % 2 == j % 2}
    assert {(r[0], r[1]): r[2] for r in f.collect()} == want


def test_many_words_at_once_agree_with_one_by_one():
    rng = random.Random(1)
    words = ["".join(rng.choice(a) for _ in range(rng.choice([0, 1, 3, 9, 31, 32, 33, 64, 65]))) for a in ["ab", "abcd ", "aä日", "a\0"] * 12]
    at = np.array([[rng.randrange(len(words)), rng.randrange(len(words))] for _ in range(600)])
    for f, many in ((getattr(kernels, n), many) for n, many in kernels.MANY.items()):
        assert many(words, words, at[:, 0], at[:, 1]).tolist() == [f(words[i], words[j]) for i, j in at.tolist()]


def test_few_matches_are_looked_up_without_a_shuffle_of_pairs(spark):
    d = spark.range(40).withColumn("name", F.lit("a"))
    m = spark.createDataFrame([(1, 2), (1, 2), (3, None)], "left long, right long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = pairs.candidate_pairs(d, d, {"name": ["notmissing"]}, "id", "id", [("name", "name")])
        out = pairs.label_pairs(p, m, "id_left", "id_right")
        assert "BroadcastHashJoin" in _plan(out) and rows(out.filter("match = 1"), "id_left", "id_right") == [(1, 2)] and out.count() == 1600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rounding_of_scores(spark):
    from kinweave.queries.core import _rounded

    values = [0.1234567895, -0.1234567895, 2.5e-9, -2.5e-9, 0.0009765625, 1 / 3, 0.0, 1e300, float("inf"), float("-inf"), None, 4.9e-10, 5e-10, 123456.7891234564]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").withColumn("r", _rounded(F.col("v"), 9))

    def half_away(v):
        if v is None or math.isinf(v) or abs(v) * 1e9 >= 2**52:
            return v
        x = abs(v) * 1e9
        return math.copysign((math.floor(x) + (x - math.floor(x) >= 0.5)) / 1e9, v)

    assert {r["k"]: r["r"] for r in d.collect()} == {k: half_away(v) for k, v in enumerate(values)}
    assert d.withColumn("n", _rounded(F.lit(float("nan")), 9)).filter(F.isnan("n")).count() == len(values)


def test_all_text_comparisons_of_few_values_are_looked_up(spark):
    d = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(["anna b", "b anna", "", None, "anna b", "otto"])], "id long, name string, b int")
    spec = {"name": ["cosine", "levenshtein", "token_sort_ratio", "notmissing"]}
    f = pairs.similarity_features(d, d, None, spec, "id", "id", block_on=[("b", "b")])
    top = _plan(f.select("id_left", "col_name_name_cosine")).split("BroadcastExchange")[0]
    assert "array_intersect" not in top  # compared for each value pair, not for each pair
    slow = pairs.score_pairs(pairs.candidate_pairs(d, d, spec, "id", "id", [("b", "b")]), spec, distinct_values=False)
    assert rows(f, *slow.columns) == rows(slow, *slow.columns) and f.count() == 18


def test_large_blocks_are_cut_into_tiles(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"n{k}", "x" if k < 30 else f"y{k % 3}" if k < 45 else None, k % 2) for k in range(60)], "id long, name string, b string, c int")
    want = rows(pairs.candidate_pairs(d, d, {"name": ["levenshtein"]}, "id", "id", [("b", "b"), ("c", "c")]), "id_left", "id_right", "l_name", "r_name")
    for rows_cast, small in ((0, False), (100, True)):
        monkeypatch.setattr(pairs, "PAIRS_A_TASK", 20)
        monkeypatch.setattr(pairs, "BROADCAST_ROWS", rows_cast)
        p = pairs.candidate_pairs(d, d, {"name": ["levenshtein"]}, "id", "id", [("b", "b"), ("c", "c")])
        assert rows(p, "id_left", "id_right", "l_name", "r_name") == want and ("__left_left" in _plan(p)) != small
        assert p.columns == ["id_left", "l_name", "id_right", "r_name"]
        sizes = [r[1] for r in p.groupBy(F.spark_partition_id()).count().collect()] if small else []
        assert all(n <= 60 for n in sizes)


def test_edit_distance_of_many_values_in_batches(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 3)
    d = spark.createDataFrame([(k, n) for k, n in enumerate(["anna", "hanna", "", "otto", None, "ärna日", "a" * 70])], "id long, name string")
    f = pairs.similarity_features(d, d, None, {"name": ["levenshtein"]}, "id", "id", block_on=[])
    native = pairs.score_pairs(pairs.candidate_pairs(d, d, {"name": ["levenshtein"]}, "id", "id"), {"name": ["levenshtein"]})
    assert "ArrowEvalPython" in _plan(f) and "ArrowEvalPython" not in _plan(native)
    assert rows(f, *native.columns) == rows(native, *native.columns)
