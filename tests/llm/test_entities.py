import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm import entity_match, name_variants
from kinweave.runtime import Shelf
from tests.conftest import rows

COLS = "id long, name string, lat double, lon double, city string, industry string, purpose string, capital_text string, found_date_modified string, found_year string, register_date_modified string, loaded_at long"


def company(i, name, lat, lon, city, trade, purpose, capital, found, registered=None):
    return (i, name, lat, lon, city, trade, purpose, capital, found, found[:4] if found else None, registered, 1)


def test_entities(spark):
    left = [
        company(1, "Brauerei Norkulf Aktiengesellschaft", 52.1, 13.1, "Halstedt", "Brauereien", "Betrieb", "M 1 000 000", "1890-02-03"),
        company(2, "Brauerei Norkulf Aktiengesellschaft", 48.1, 9.1, "Kenwalde", "Brauereien", "Betrieb", "M 2 000 000", "1899-07-13"),  # the branch elsewhere
        company(3, "Gerberei Salmaker & Wurting", 52.2, 13.2, "Halstedt", "Lederindustrie", "Ausbau", "M 500 000", "1880-01-01"),
        company(4, None, None, float("nan"), None, None, None, None, None),
        company(5, "Spinnerei Tulbrach A.-G.", 50.0, 8.0, "Orlefeld", "Textilindustrie", "Pacht", "M 700 000", "1901-11-30"),
        company(5, "Spinnerei Tulbrach A.-G.", 50.0, 8.0, "Orlefeld", "Textilindustrie", "Pacht", "M 700 000", "1901-11-30"),
    ]
    right = [
        company(1, "BRAUEREI NORKULF A.-G.", 52.1005, 13.1003, "Halstedt", "Brauereien.", "Betrieb", "Mk 1000000", "3./2. 1890"),
        company(11, "Norkluf Brauerei AG, Kenwalde", 48.1002, 9.1001, "Kenwalde", None, "Betrieb", "M 2 000 00O", "13.7.99"),
        company(12, "Lindenhort Gerberei", 52.2, 13.2, "Halstedt", "Lederindustrie", None, "M 500 000", "1880-01-01"),  # renamed
        company(13, "Tulbrach Spinn.", 50.0001, 8.0, None, "Textilindustrie", "Pacht", None, "1901-11-30"),
        company(14, "Spinnerei Tulbrach", 50.0001, 8.0, "Orlefeld", "Textilindustrie", "Pacht", "M 700 000", "1901-11-30"),  # the same firm again
        company(15, None, None, None, "", "", "", "", None),
        company(16, "x" * 50_000, 1.0, 1.0, "y", None, None, "M " + "9" * 400, "0000-99-99"),
    ]
    l, r = spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS).withColumn("grams", F.lit("clash"))
    got = entity_match.match_entities(l, r, ("id", "name", "lat", "lon"), ("id", "name", "lat", "lon"))
    assert rows(got, "left_id", "right_id") == [(1, 1), (2, 11), (3, 12), (5, 13), (5, 14)]
    assert got.filter("confidence < 6").count() == 0
    assert entity_match.match_entities(l.limit(0), r, ("id", "name", "lat", "lon"), ("id", "name", "lat", "lon")).count() == 0


def test_ids_of_any_size_and_short_names(spark):
    big = 2**63 - 1
    left = [company(big, "BMW AG", 52.1, 13.1, "Halstedt", None, None, None, None), company(-big, "AEG", 48.0, 9.0, "Kenwalde", None, None, None, None)]
    right = [company(big, "BMW A.-G.", 52.1, 13.1, "Halstedt", None, None, None, None), company(2**62 + 1, "AEG", 48.0, 9.0, "Kenwalde", None, None, None, None)]
    cols = ("id", "name", "lat", "lon")
    got = entity_match.match_entities(spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS), cols, cols)
    assert rows(got, "left_id", "right_id") == [(-big, 2**62 + 1), (big, big)]
    assert got.filter("confidence < 9").count() == 0  # place, city and name


def test_trades_that_tell_nothing(spark):
    data = [(k, "brauerei" if k < 30 else ("nachtrag" if k % 2 else "spinnerei"), 18800101 + k // 2, 5, 1.0, 2.0) for k in range(60)] + [(90, None, None, None, None, None)]
    d = spark.createDataFrame(data, "id long, trade string, found int, capital long, lat double, lon double")
    # every odd record of the second half bears the remark beside a spinnery, which stands beside itself as well
    more = [(100 + k, "spinnerei", 18900101 + k // 3, 7, 1.0, 2.0) for k in range(60)]
    got = entity_match.without_empty_trades(d.unionByName(spark.createDataFrame(more, d.schema)))
    assert {r["trade"] for r in got.collect()} == {"brauerei", "spinnerei", None} and got.count() == 121


def best_total(edges):
    lefts = sorted({a for a, _, _ in edges})
    score = {(a, b): c for a, b, c in edges}
    rights = sorted({b for _, b, _ in edges}) + [None] * len(lefts)
    return max(sum(score.get((a, b), 0) if b is not None else 0 for a, b in zip(lefts, p)) for p in itertools.permutations(rights, len(lefts)))


def test_assignment_is_best():
    rng = random.Random(6)
    for n in range(300):
        k = 2 + n % 4
        edges = [(a, b, rng.choice([rng.randrange(1, 50) / 2, 6.0])) for a in range(k) for b in range(10, 10 + rng.randrange(1, 5)) if rng.random() < 0.7]
        mine = entity_match.best_assignment(edges)
        score = {(a, b): c for a, b, c in edges}
        assert len(set(mine.values())) == len(mine) and sum(score[x] for x in mine.items()) == (best_total(edges) if edges else 0)


def test_assignment_of_a_large_component():
    rng = random.Random(5)
    edges = [(a, 10**6 + (a * 7 + rng.randrange(40)) % 4000, rng.randrange(12, 50) / 2) for a in range(5000) for _ in range(6)]
    mine = entity_match.best_assignment(edges)
    assert len(set(mine.values())) == len(mine) > 3900


def test_assignment_paths_agree(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(10 * g + a, 1000 + 10 * g + b, rng.randrange(12, 50) / 2) for g in range(4) for a in range(3) for b in range(3) if a == b or rng.random() < 0.5]
    d = spark.createDataFrame(edges + edges[:3], "e1 long, e2 long, score double")
    total = lambda df: df.agg(F.sum("score")).first()[0]
    a = entity_match.assign(d, Shelf(spark, "t"))
    put, rounds = Shelf.put, []
    monkeypatch.setattr(Shelf, "put", lambda self, df, name="t", *x: rounds.append(name) or put(self, df, name, *x))
    b = entity_match.bidding(d.distinct(), Shelf(spark, "t"), eps=0.5, rounds=3)
    assert total(a) == pytest.approx(total(b), abs=24 * 12) and total(b) >= total(a) / 2
    assert rounds.count("bids") <= 3 * (2 + 6) + 3
    assert b.groupBy("e1").count().filter("count > 1").isEmpty() and b.groupBy("e2").count().filter("count > 1").isEmpty()


def test_window_reaches_across_partitions(spark):
    sketch = {c: [0] * 40 for c in entity_match._SKETCH}
    sketch |= {"id": list(range(40)), "capital": [5] * 40, "found": [18900101] * 40, "lat": [1.0] * 40, "lon": [1.0] * 40}
    d = spark.createDataFrame(list(zip(*sketch.values())), ", ".join(f"{c} {'double' if c in ('lat', 'lon') else 'long'}" for c in sketch))
    kinds = ", ".join(f"{c} double" if c in ("rest", "lat", "lon") else f"{c} long" for c in (*entity_match._PAIR, *entity_match._SKETCH, "at", "part", "rows"))
    met = d.repartitionByRange(16, "id").sortWithinPartitions("id").mapInArrow(entity_match._slide(3, 1.0), f"kind int, {kinds}")
    got = rows(met.filter("kind = 0"), "id1", "id2") + rows(entity_match.across_ends(met.filter("kind = 1"), 3, 1.0), "id1", "id2")
    assert sorted(got) == [(a, a + k) for a in range(40) for k in (1, 2, 3) if a + k < 40]  # partitions of two or three rows, each pair once


NAMES = [
    (1, "Johann Norkulfer", None), (2, "Norkulfer, Hans", None), (3, "J. Norkulfer", ""), (4, "Dr. NORKULFER, JOHANN, ebenda *", None), (5, "Johann Norkulefr", None),
    (10, "Viktor Selmung d. Ältere", None), (11, "V. Selmung sen.", None), (12, "Viktor Selmung jun.", "Selmung der Jüngere, Viktor"),
    (20, "Anna Kimpending", "geb. Anna Surgakulf"), (21, "A. Surgakulf", None), (22, "Änne Kimpending", None),
    (30, "Sägewerk Rornirsen A.-G.", None), (31, "Rornirsen'sche Sägew.", None), (32, "Spinnerei Rornirsen", None), (33, "Fritz Rornirsen", None),
    (40, "H. Tolmander", None), (41, "Heinrich Tolmander", None), (42, "Henriette Tolmander", None), (50, None, None), (51, "  ", "..."), (52, "z" * 40_000, None), (1, "Johann Norkulfer", None),
]


def test_variants(spark):
    d = spark.createDataFrame([(*n, k) for k, n in enumerate(NAMES)], "name_id long, current_name string, alternative_name string, loaded_at long").withColumn("own", F.lit("clash"))
    linked = name_variants.link_variants(d)
    groups = {}
    for r in linked.collect():
        groups.setdefault(r["bearer"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5], [10, 11], [12], [20, 21, 22], [30, 31], [32], [33], [40], [41], [42], [50], [51], [52]]
    assert (1, 5) in rows(name_variants.variant_pairs(linked), "name_id_1", "name_id_2")
    assert name_variants.link_variants(d.limit(0)).count() == 0


ROLES = name_variants.Roles((("sagewerk", 10), ("portlandzementwerk", 9), ("baugesellschaft", 9), ("handelsbank", 9), ("elektrizitatswerk", 8), ("porzellanfabrik", 8), ("mobelfabrik", 8), ("brauerei", 5), ("braunkohlengrube", 9)), ("hausbesitzer",))


@pytest.mark.parametrize("text,parts", [
    ("Komm.-Rat Ludwig S0rbettow", ("P", "sorbetow", "ludwig", "", "", "")), ("SELMUNG D. ÄLTERE, JOSEF", ("P", "selmung", "josef", "", "S", "")), ("v. Grimlettulf, Lotte", ("P", "grimletulf", "charlotte", "", "", "")),
    ("Dr. jur. H. von Borruttau", ("P", "borutau", "", "h", "", "")), ("Portl.-Zem.-W. Stursurow AG", ("F", "stursurow", "", "", "", "portlandzementwerk")), ("Timbunbach'sche Bauges.", ("F", "timbunbach", "", "", "", "baugesellschaft")),
    ("Genmorter El.-W.", ("F", "genmorter", "", "", "", "elektrizitatswerk")), ("Brau. Genmorter", ("F", "genmorter", "", "", "", "brauerei")), ("HANDELSBK. Genmorter", ("F", "genmorter", "", "", "", "handelsbank")), ("Genmorter Sägev.", ("F", "genmorter", "", "", "", "sagewerk")),
    ("Salmaker & Wurting, Spinnerei", ("F", "salmaker wurting", "", "", "", "spinnerei")), ("Hausbesitzer Karl Wolf", ("P", "wolf", "karl", "", "", "")), ("Brauer, Karl", ("P", "brauer", "karl", "", "", "")),
    ("BMW A.-G.", ("W", "bmw", "", "", "", "")), ("Иван Петров", ("W", "иван петров", "", "", "", "")), ("李伟", ("W", "李伟", "", "", "", "")), ("Tolmander", ("P", "tolmander", "", "", "", "")), (None, None), ("12 %", None), ("", None),
])
def test_reader(text, parts):
    assert name_variants.NameReader(roles=ROLES).read(text) == parts


def test_slips_index():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    index = name_variants.Slips(words, 8)
    for _ in range(300):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) - 1)
            op = rng.randrange(4)
            w[k : k + 1] = [[], [w[k], "x"], ["e"], [w[k]]][op]
            if op == 3:
                w[k], w[k + 1] = w[k + 1], w[k]
        t = "".join(w)
        assert {x for _, _, x in index.near(t)} == {x for x in words if name_variants.near(t, x, index.most(x))}


def test_roles_of_a_column(spark):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice(["nor", "kul", "tam", "gis", "bel", "rup", "din"]) for _ in range(4))
    firms = [make() for _ in range(60)]
    people = [f"{rng.choice(['Ewald', 'Tassilo', 'Karl'])} {make()}" for _ in range(80)]
    texts = [f"Gondelbau {f.title()} {rng.choice(['AG', 'GmbH', 'KGaA'])}" for f in firms] + [f"{f.title()}, Gondelbau" for f in firms[:25]] + [f"{p}, Hausbesitzer" for p in people[:30]] + people + ["Spinnerei Tulbrach", "Spinnerei Tulbrach AG", "Spinnnerei Wurting"]
    roles = name_variants.column_roles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), Shelf(spark, "t"))
    assert [w for w, _ in roles.trades] == ["gondelbau", "spinnerei", "spinnnerei"] and roles.remarks == ("hausbesitzer",)
    reader = name_variants.NameReader(roles=roles)
    assert reader.read("Gondelbauu Tulbrach") == ("F", "tulbrach", "", "", "", "gondelbau") and reader.read("Tulbrach Gondelb. AG")[5] == "gondelbau"
    assert name_variants.column_roles(spark.createDataFrame([], "text string"), Shelf(spark, "t")) == name_variants.Roles()


def bearers(spark, texts):
    d = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "name_id long, current_name string, alternative_name string")
    groups = {}
    for r in name_variants.link_variants(d).collect():
        groups.setdefault(r["bearer"], []).append(texts[r["id"]])
    return sorted(sorted(g) for g in groups.values())


def test_names_of_any_kind(spark):
    one = ["Schokoladenfabrik Norkulfer AG", "Norkulfer Schokoladenfabrik A.-G.", "Schokoladenfabrik Norkulfer"]
    apart = [["Иван Петров", "Петров, Иван", "ИВАН ПЕТРОВ"], ["Пётр Иванов"], ["BMW AG", "BMW A.-G."], ["AEG AG"], ["李伟", "李伟"], ["Li Wei", "Li Wei"], ["Salmaker & Wurting AG", "AG Wurting & Salmaker"], ["Tolmander"], ["Tolmander"]]
    slips = ["Johann Norkulfer"] * 20 + ["Johann Norkulfex"] * 5
    assert bearers(spark, one + [t for g in apart for t in g] + slips) == sorted(sorted(g) for g in [one, *apart, slips])


def test_near():
    assert name_variants.near("abcd", "abdc", 1) and name_variants.near("abcd", "abc", 1) and not name_variants.near("abcd", "badc", 1) and name_variants.near("abcd", "badc", 2)


def test_given_names_by_company(spark):
    reader = name_variants.NameReader(frequent=("the", "ewald"))
    assert reader.read("The. Klimrangau") == ("P", "klimrangau", "", "the", "", "") and reader.read("Ewald Klimrangau")[1:3] == ("klimrangau", "ewald")
    assert reader.read("J. Ewald") == ("P", "ewald", "", "j", "", "")  # a surname where no other word is left
    surnames = ["Tolmander", "Kimpending", "Surgakulf", "Drenportow", "Flurroling", "Klurdunger", "Nalfermann", "Hurpurtow", "Genmorter", "Zimpindow", "Bolgarat"]
    texts = [f"Ewald {s}" for s in surnames] + [f"The. {s}" for s in surnames] + ["Johann Rustepol"] * 400 + [f"{g} Rustepol" for g in ("Ottokar", "Xanthippe", "Ottokra")] + ["J. Rustepol"] * 40
    assert name_variants.unlisted_given(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)) == ["ewald"]


def test_slips_in_a_large_table_learn_nothing(spark):
    surnames = ["Tolmander", "Kimpending", "Surgakulf", "Drenportow", "Flurroling", "Klurdunger", "Nalfermann", "Hurpurtow", "Genmorter", "Zimpindow", "Bolgarat"]
    given = [f"{g} {s}" for s in surnames for g in ["Bernd"] * 110 + ["Bemd", "Ewald"]]
    assert name_variants.unlisted_given(spark.createDataFrame([(t,) for t in given], "text string").repartition(3)) == ["ewald"]
    firms = [f"Ziegelwerke {s}{end}" for s in surnames for end in ("", " AG", " Acktien", " Hausbesitzer")] + [f"Zieglwerke Bolgarat {s} AG" for s in surnames]
    roles = name_variants.column_roles(spark.createDataFrame([(t,) for t in firms], "text string").repartition(3), Shelf(spark, "t"))
    assert roles.remarks == ("hausbesitzer",)
    assert name_variants.NameReader(roles=roles).read("Tolmander Acktien") == name_variants.NameReader(roles=roles).read("Tolmander Aktien") == ("W", "tolmander", "", "", "", "")


@pytest.mark.parametrize("text,parts", [
    ("Lurdenbach, öbelfabrik", ("F", "lurdenbach", "mobelfabrik")), ("Prurronulf, sorzellanfabrik", ("F", "pruronulf", "porzellanfabrik")), ("Krenbolow'sche andelsbank", ("F", "krenbolow", "handelsbank")), ("Weberei Flenambach", ("F", "flenambach", "weberei")),
    ("Flurroling tktiengesellschaft", ("W", "fluroling", "")),
])
def test_first_letter_slips_of_words(text, parts):
    got = name_variants.NameReader(roles=ROLES).read(text)
    assert (got[0], got[1], got[5]) == parts


def slip_edges(spark, forms):
    d = spark.createDataFrame([(c, own, "P|johann|", n, n, n) for c, own, n in forms], "c long, own string, tag string, rows long, whole long, top long")
    return rows(name_variants._slip_edges(d, 2), "a", "b")


def test_first_letter_slips_of_surnames(spark):
    assert slip_edges(spark, [(1, "tolmander", 5), (2, "polmander", 1), (3, "olmander", 1), (4, "polmunder", 1)]) == [(2, 1), (3, 1), (4, 2)]


def test_slips_grow_with_the_bearer(spark):
    assert slip_edges(spark, [(1, "tolmander", 900), (2, "tolmandre", 12), (3, "kimpending", 30), (4, "kimpendink", 20), (5, "kuhn", 9), (6, "kuhm", 3), (7, "wolf", 2), (8, "wolk", 1)]) == [(2, 1), (6, 5)]


def test_unfinished_merging_is_an_error(spark):
    d = spark.createDataFrame([(1, "Johann Tolmander", None), (2, "Tolmander, Hans", None)], "name_id long, current_name string, alternative_name string")
    with pytest.raises(RuntimeError):
        name_variants.link_variants(d, max_rounds=1)


def test_initials_of_unlisted_given_names(spark):
    profiles = spark.createDataFrame([(1, "P", "tolmander", "ewald", "", "", ""), (2, "P", "tolmander", "", "e", "", "")], "c long, kind string, own string, first string, pre string, gen string, trade string")
    begin = name_variants._beginnings(spark, ("ewald",))
    assert rows(name_variants._initial_edges(profiles, name_variants._full_keys(profiles, begin), begin), "a", "b") == [(2, 1)]


VARIANTS = "name_id long, current_name string, alternative_name string"


def test_few_names_take_few_jobs(spark):
    """The driver plans every job and keeps its figures; these were 219 jobs."""
    begun = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    d, before = spark.createDataFrame(NAMES, VARIANTS).coalesce(1), begun()
    assert name_variants.link_variants(d).count() == 21
    assert begun() - before < 190


def test_large_tables_are_linked_alike(spark, monkeypatch):
    from kinweave import runtime
    from kinweave.operators import components

    d = spark.createDataFrame([*NAMES, *((100 + i, f"{f}. Tolmander", None) for i, f in enumerate("EEFF")), (110, "Emil Kimpending", None), (111, "E. Kimpending", None)], VARIANTS)
    once = rows(name_variants.link_variants(d), "id", "bearer")
    for m in (runtime, components, name_variants):
        monkeypatch.setattr(m, "SMALL_ROWS", 0)
    monkeypatch.setattr(name_variants, "ONE_TASK_EDGES", 0)
    assert rows(name_variants.link_variants(d), "id", "bearer") == once
    assert {(101, 100), (103, 102), (111, 110)} <= set(once)


def test_slip_keys_are_never_broadcast(spark):
    forms = [(1, "tolmander", 5), (2, "polmander", 1), (3, "olmander", 1), (4, "polmunder", 1)]
    shelf = Shelf(spark, "t")
    d = shelf.put(spark.createDataFrame([(c, own, "P|johann|", n, n, n) for c, own, n in forms], "c long, own string, tag string, rows long, whole long, top long"))
    got = name_variants._slip_edges(d, 2, None, shelf)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "a", "b") == [(2, 1), (3, 1), (4, 2)]
