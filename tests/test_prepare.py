import math

import pytest
from pyspark.sql import functions as F

from kinweave.functions.similarity import Similarities
from kinweave.operators import commonness, prepare
from kinweave.spec import MatchSpec

LEFT = [("ALICE", None, 1), ("BOB", 22.0, 2), (None, 34.0, 3)]
RIGHT = [("Alice", "25", 1), ("Bob", "N/A", 2), ("Charlie", "30", 4)]
SPEC = {"name~Name": ["levenshtein"], "age~Age": ["notzero"]}


@pytest.fixture
def sides(spark):
    return spark.createDataFrame(LEFT, "name string, age double, id long"), spark.createDataFrame(RIGHT, "Name string, Age string, id long")


def test_all_flags(sides):
    l, r = prepare.prepare(*sides, SPEC, "id", "id", fill_numeric_na=True, to_numeric_cols=["age", "Age"], fill_string_na=True, capitalize=True)
    assert sorted((x["id"], x["name"], x["age"]) for x in l.collect()) == [(1, "ALICE", 0.0), (2, "BOB", 22.0), (3, "", 34.0)]
    assert sorted((x["id"], x["Name"], x["Age"]) for x in r.collect()) == [(1, "ALICE", 25.0), (2, "BOB", 0.0), (4, "CHARLIE", 30.0)]


def test_without_fill(sides):
    l, r = prepare.prepare(*sides, SPEC, "id", "id", to_numeric_cols=["age", "Age"])
    assert l.schema["age"].dataType == r.schema["Age"].dataType
    assert [x["name"] for x in l.orderBy("id").collect()][2] is None
    assert [x["Age"] for x in r.orderBy("id").collect()][1] is None


def test_types_are_aligned(sides):
    l, r = prepare.prepare(*sides, SPEC, "id", "id")
    assert dict(l.dtypes)["age"] == dict(r.dtypes)["Age"] == "string"


def test_to_numeric_edges(spark):
    d = spark.createDataFrame([("1.2.3",), ("",), (None,), ("-5",), ("a1b2",)], "x string")
    assert [r[0] for r in d.select(prepare.to_numeric(F.col("x"), True)).collect()] == [None, 0.0, 0.0, 5.0, 12.0]


def test_missing_column(sides):
    with pytest.raises(KeyError):
        prepare.prepare(*sides, {"nope": ["levenshtein"]}, "id", "id")


def test_stop_words(spark):
    d = spark.createDataFrame([("The bank of the Bank, 12 rivers bank",), (None,)], "x string")
    got = [r[0] for r in d.select(prepare.remove_stop_words(F.col("x"), ["the", "of"])).collect()]
    assert got == ["bank Bank rivers", None]


@pytest.mark.parametrize("scoring,expected", [("relative", {"a": 2 / 3, "b": 1 / 3}), ("minmax", {"a": 1.0, "b": 0.0}), ("log", {"a": 1.0, "b": math.log(2) / math.log(3)})])
def test_frequency(spark, scoring, expected):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    got = {r["value"]: r["score"] for r in commonness.frequency_scores(d, "v", scoring).collect()}
    assert got == pytest.approx(expected)


def test_commonness_fill_and_source(spark):
    l, r = spark.createDataFrame([("A ",), ("b",), (None,)], "v string"), spark.createDataFrame([("a",), ("x",)], "v string")
    a, b = commonness.commonness(l, r, ["v"], l, r, "both", scoring="relative", preprocess=True, fill_value=0.1)
    assert sorted(x["v_commonness"] for x in a.collect()) == pytest.approx([0.1, 0.25, 0.5])
    with pytest.raises(ValueError):
        commonness.commonness(l, r, ["v"], l, r, "neither")


def value(spark, name, a, b, kind="string"):
    d = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    return d.select(Similarities.default().column(name, F.col("a"), kind, F.col("b"), kind)).first()[0]


@pytest.mark.parametrize("name,a,b,kind,expected", [
    ("levenshtein", "kitten", "sitting", "string", 1 - 3 / 7), ("levenshtein", "", "", "string", 1.0), ("levenshtein", None, "a", "string", 0.0), ("notmissing", "x", "", "string", 0.0), ("notmissing", "0", "5", "string", 1.0),
    ("notzero", "0", "5", "string", 1.0), ("notzero", 0.0, 5.0, "double", 0.0), ("notmissing", 0.0, 5.0, "double", 1.0), ("notmissing", float("nan"), 5.0, "double", 0.0), ("within_km_lat", 54.0, 54.089, "double", 1.0),
    ("within_km_lat", 54.0, 54.090, "double", 0.0), ("within_km_lon", 10.0, 10.15, "double", 1.0), ("within_km_lon", 10.0, 10.16, "double", 0.0), ("commonness_score", 0.0, 0.0, "double", 1.0), ("commonness_score", 1.0, 1.0, "double", 0.0),
    ("commonness_score", 0.0, 1.0, "double", 0.0), ("commonness_score", 0.5, 0.5, "double", 0.5), ("pct_diff", 0.0, 0.0, "double", 0.0), ("pct_diff", 0.0, 2.0, "double", 1.0), ("pct_diff", 10.0, 12.0, "double", 0.2),
    ("jaro_winkler", "martha", "marhta", "string", 0.9611111), ("jaro_winkler", "", "", "string", 0.0), ("basic_ratio", "abcd", "abxd", "string", 0.75), ("token_sort_ratio", "b a", "a b", "string", 1.0), ("token_set_ratio", "a b c", "a b", "string", 1.0),
    ("partial_ratio", "bank", "the bank", "string", 1.0), ("partial_token_ratio", "x y", "y z", "string", 1.0), ("cosine", "abc", "abc", "string", 1.0),
])
def test_similarities(spark, name, a, b, kind, expected):
    assert value(spark, name, a, b, kind) == pytest.approx(expected, abs=1e-6)


def test_registry_is_extended_not_patched(spark):
    base = Similarities.default()
    more = base.adding_python("same", lambda a, b: float(a == b))
    assert "same" in more.builders and "same" not in base.builders
    d = spark.createDataFrame([("x", "x")], "a string, b string")
    assert d.select(more.column("same", F.col("a"), "string", F.col("b"), "string")).first()[0] == 1.0
    with pytest.raises(KeyError):
        base.check(["same"])


def test_spec():
    s = MatchSpec.of({"a": ["x", "y"], "b~c": ["z"]})
    assert list(s) == [("a", "a", "x"), ("a", "a", "y"), ("b", "c", "z")]
    assert s.association_sizes() == [2, 1] and s.to_dict() == {"a": ["x", "y"], "b~c": ["z"]}
    assert MatchSpec.of(list(s)) == s and s.features == ["col_a_a_x", "col_a_a_y", "col_b_c_z"]
