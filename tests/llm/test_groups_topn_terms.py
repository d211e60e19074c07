import datetime
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.llm import grouping, term_counts, top_n
from kinweave.runtime import Shelf
from tests.conftest import rows


def brute_top(items, n):
    best = {}
    for g, i, p in items:
        if g is None or i is None or p is None or p != p or not 0 <= p <= 1:
            continue
        best[(g, i)] = max(best.get((g, i), -1), p)
    by = defaultdict(list)
    for (g, i), p in best.items():
        by[g].append((-p, i))
    return sorted((g, i, k) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n], 1))


@pytest.mark.parametrize("n", [1, 5])
def test_top_n_against_brute_force(spark, n):
    rng = random.Random(7)
    items = [(1, rng.randrange(600), rng.choice([0.5, 0.25, rng.random()])) for _ in range(2000)]  # a third in one group, many ties
    items += [(rng.randrange(2, 60), rng.randrange(40), round(rng.random(), 1)) for _ in range(2500)]
    items += [(70, k, 0.5) for k in range(400)] + [(71, 10**15 + k, 1e-300 * k) for k in range(300)] + [(72, k, 0.3 + k * 1e-17) for k in range(50)] + [(73, -k, 0.9) for k in range(300)]
    items += [(80, 1, None), (80, 2, float("nan")), (80, 3, 1.5), (80, 4, -0.1), (None, 5, 0.5), (81, None, 0.5), (82, 6, 0.0), (82, 6, 1.0), (82, 7, -0.0)]
    d = spark.createDataFrame(items, "left long, right long, prediction double").withColumn("g", F.lit("clash")).withColumn("place", F.lit(9))
    assert rows(top_n.top_n(d, n), "left", "right", "place") == brute_top(items, n)


def test_top_n_empty(spark):
    assert top_n.top_n(spark.createDataFrame([], "left long, right long, prediction double"), 5).count() == 0


def test_consolidate(spark):
    d = spark.createDataFrame([(5, 3), (3, 5), (3, 2), (9, 9), (None, 4), (7, None), (8, 6), (8, 6)], "left long, right long").withColumn("id", F.lit("clash"))
    assert rows(grouping.consolidate(d), "group_id", "id") == [(2, 2), (2, 3), (2, 5), (6, 6), (6, 8), (9, 9)]
    assert grouping.consolidate(d.limit(0)).count() == 0


def panel(spark, n=3000):
    rng = random.Random(11)
    data = [(k, rng.choice([None, *range(400)]), rng.choice(["train", "test", "validation", None])) for k in range(n)]
    data = [(k, 999 if k < n // 3 else p, s) for k, p, s in data]
    return spark.createDataFrame(data + data[:50], "id long, pid long, old_split string"), [(rng.randrange(n), rng.randrange(n + 40)) for _ in range(120)] + [(1, None)]


def test_split_keeps_groups_together(spark):
    p, m = panel(spark)
    links = spark.createDataFrame(m, "left long, right long")
    out = {r["id"]: r["split"] for r in grouping.grouped_split(p, links, bins=20).collect()}
    assert len(out) == 3000
    shelf = Shelf(spark, "t")
    by = defaultdict(set)
    for r in grouping.related_groups(p, links, shelf).collect():
        if r["id"] in out:
            by[r["group_id"]].add(out[r["id"]])
    assert all(len(v) == 1 for v in by.values()) and len(by) > 100
    share = Counter(out.values())
    assert abs(share["train"] / 3000 - 0.7) < 0.05 and abs(share["test"] / 3000 - 0.2) < 0.05 and abs(share["validation"] / 3000 - 0.1) < 0.05
    assert grouping.grouped_split(p.limit(0), links.limit(0)).count() == 0


def test_bins_are_even(spark):
    rng = random.Random(3)
    w = [(k, rng.choice([1, 1, 1, 2, 5, 17, 60])) for k in range(2000)]
    placed, totals = grouping.balanced_bins(spark.createDataFrame(w, "key long, weight long"), Shelf(spark, "t"), bins=10, fan_in=4, task_keys=150)
    assert placed.count() == 2000 and sum(x for _, x in totals) == sum(x for _, x in w)
    got = Counter()
    weight = dict(w)
    for r in placed.collect():
        got[r["bin"]] += weight[r["key"]]
    assert got == Counter({b: x for b, x in totals if x}) and max(got.values()) - min(got.values()) <= 2


def test_torn_groups(spark):
    p = spark.createDataFrame([(1, None, "train"), (2, None, "test"), (3, 7, "train"), (4, 7, "train"), (5, 8, "train"), (6, 8, None), (9, None, "test"), (2, None, "test")], "id long, pid long, old_split string")
    m = spark.createDataFrame([(1, 100), (100, 2), (3, None), (9, 9)], "left long, right long")
    assert rows(grouping.torn_groups(p, m), "id") == [(1,), (2,)]
    assert grouping.torn_groups(p.limit(0), m).count() == 0


def brute_terms(records):
    occ, rec = Counter(), Counter()
    for t in records.values():
        w = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).lower()) if t is not None else []
        occ.update(w)
        rec.update(set(w))
    return {t: (occ[t], rec[t]) for t in occ}


def counts(tc):
    return {r["term"]: (r["occurrences"], r["records"]) for r in tc.counts.collect()}


def test_signed_deltas(spark):
    tc = term_counts.TermCounts(spark, buckets=4)
    state = {1: "Act. Ges. act", 2: "über Über", 3: None, 4: "", 5: "½ kg 12kg"}
    tc.apply(spark.createDataFrame(list(state.items()), "id long, name string"), "id", "name")
    assert counts(tc) == brute_terms(state)
    change = [(1, "Ges. neu", False), (2, "über Über", False), (3, "act", False), (5, None, True), (6, "act act", False), (6, "act act", False), (None, "lost", False)]
    tc.apply(spark.createDataFrame(change, "id long, name string, gone boolean"), "id", "name", deleted_col="gone")
    state = {1: "Ges. neu", 2: "über Über", 3: "act", 4: "", 6: "act act"}
    assert counts(tc) == brute_terms(state)
    marks = {r["term"]: r["mark"] for r in tc.marked(2, 0.3).collect()}
    assert marks == {"ges": "rare", "neu": "rare", "über": "rare", "act": "common"}


def test_counts_outlive_the_session(spark, tmp_path):
    path, cols = f"file://{tmp_path}/terms", "id long, name string, at timestamp, gone boolean"
    day = lambda d: datetime.datetime(1890, 1, d)
    first = term_counts.TermCounts(spark, path, buckets=16)
    first.apply(spark.createDataFrame([(1, "alt", day(5), False), (2, "neu neu", day(5), False), (3, "weg", day(5), False), (4, None, day(5), False)], cols), "id", "name", "at", "gone")
    again = term_counts.TermCounts(spark.newSession(), path)
    assert again.buckets == 16 and counts(again) == brute_terms({1: "alt", 2: "neu neu", 3: "weg"})
    # a late older version, a changed, a deleted, an unchanged and a new record
    late = [(1, "aelter", day(2), False), (2, "neuer", day(6), False), (3, None, day(7), True), (4, None, day(5), False), (5, "alt", None, False)]
    again.apply(spark.createDataFrame(late, cols), "id", "name", "at", "gone")
    want = brute_terms({1: "alt", 2: "neuer", 5: "alt"})
    third = term_counts.TermCounts(spark, path)
    assert counts(third) == want and third.state["named"] == 3
    third.apply(spark.createDataFrame([(3, "weg", day(6), False), (5, "alt", None, False)], cols), "id", "name", "at", "gone")  # older than its deletion
    assert counts(third) == want
    with pytest.raises(ValueError):
        third.apply(spark.createDataFrame([(1, "x", 3)], "id long, name string, at long"), "id", "name", "at")


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/terms"
    tc = term_counts.TermCounts(spark, path, buckets=64)
    tc.apply(spark.range(500).selectExpr("id", "concat('t', id) name"), "id", "name")
    before = dict(tc.state["records"]), dict(tc.state["counts"])
    tc.apply(spark.createDataFrame([(7, "t7 t8")], "id long, name string"), "id", "name")
    changed = lambda old, new: [b for b in new if old.get(b) != new[b]]
    assert len(changed(before[0], tc.state["records"])) == 1 and len(changed(before[1], tc.state["counts"])) == 1
    assert counts(tc)["t8"] == (2, 2) and len(counts(tc)) == 500
    for k in range(3):  # files that no kept manifest names are gone
        tc.apply(spark.createDataFrame([(7, f"t{k}")], "id long, name string"), "id", "name")
    assert counts(tc)["t2"] == (2, 2) and "t7" not in counts(tc) and len(list((tmp_path / "terms/manifest").glob("*.json"))) == 2


def test_batches_agree_with_one(spark):
    rng = random.Random(2)
    data = [(k % 90, rng.choice(["a b", "b c", None, ""]) if k < 90 else None, k) for k in range(90)]
    d = spark.createDataFrame(data, "id long, name string, at long").withColumn("term", F.lit("clash"))
    assert counts(term_counts.term_counts(d, "id", "name", "at", 3)) == counts(term_counts.term_counts(d, "id", "name", "at", 1))
    assert counts(term_counts.term_counts(d.limit(0), "id", "name", "at", 2)) == {}
