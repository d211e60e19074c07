"""Queries of the core operators over whole tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.functions.similarity import Similarities
from kinweave.operators import closure, commonness, dual_tree, matches as known, metrics, pairs, panel_ids, prepare, suggest, synthetic
from kinweave.plans import models, network, selection
from kinweave.runtime import read
from kinweave.spec import MatchSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


# --- pairs of customers and suppliers of one nation, the flagship ------------------------------------------------

def _rounded(c: Column, places: int) -> Column:
    """Half away from zero, as SQL rounds a double, without a decimal for each pair."""
    scale = float(10**places)
    x = F.abs(c * scale)
    whole = F.floor(x).cast("double")
    up = F.when(x < 2.0**52, whole + F.when(x - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(x) / scale
    return F.when(x < float("inf"), F.when(c < 0, -up).otherwise(up)).otherwise(c)


_NAMES = MatchSpec.of({"c_name~s_name": ["levenshtein", "notmissing"], "c_acctbal~s_acctbal": ["notzero", "pct_diff"]})
_BLOCK = [("c_nationkey", "s_nationkey")]
_LEV = "1.0 - levenshtein(c_name, s_name) / greatest(length(c_name), length(s_name))::DOUBLE"
_PAIRS = "customer JOIN supplier ON c_nationkey = s_nationkey"
_SCORED = f"""SELECT c_custkey, s_suppkey, 1.0 / (1.0 + exp(-(-2.0 + 3.0 * ({_LEV}) + 0.5 * 1.0))) AS prediction FROM {_PAIRS}"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("c_name", F.trim("c_name"))
    return pairs.similarity_features(c, read(spark, d, "supplier"), None, _NAMES, "c_custkey", "s_suppkey", block_on=_BLOCK)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = suggest.linear_score(-2.0, {"col_c_name_s_name_levenshtein": 3.0, "col_c_name_s_name_notmissing": 0.5})
    return _features(spark, d).select("c_custkey", "s_suppkey", score.alias("prediction"))


def _top(k: int) -> str:
    return f"SELECT c_custkey, s_suppkey, round(prediction, 9) AS prediction FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY prediction DESC, s_suppkey) <= {k}"


@query(_top(1))
def suggest_top1(spark: SparkSession, d: str) -> DataFrame:
    return suggest.top_k(_scored(spark, d), 1, "c_custkey", "s_suppkey").withColumn("prediction", F.round("prediction", 9))


@query(_top(3))
def suggest_topk(spark: SparkSession, d: str) -> DataFrame:
    return suggest.top_k(_scored(spark, d), 3, "c_custkey", "s_suppkey").withColumn("prediction", F.round("prediction", 9))


# --- points ------------------------------------------------------------------------------------------------------


def _located(table: str, lat: str, lon: str) -> str:
    return f"""SELECT DISTINCT id, {lat} AS lat, {lon} AS lon FROM {table} WHERE {lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180
      AND NOT isnan({lat}) AND NOT isnan({lon}) AND NOT ({lat} = 0 AND {lon} = 0)"""


@query(f"""
WITH l AS ({_located('companies_left', 'lat', 'lon')}), r AS ({_located('companies_right', 'lat_noise', 'lon_noise')}),
lb AS (SELECT *, CAST(floor(lat * 100) AS BIGINT) AS band FROM l),
rb AS (SELECT r.*, CAST(floor(lat * 100) AS BIGINT) + d AS band FROM r, (VALUES (-1), (0), (1)) v(d))
SELECT lb.id AS left_id, rb.id AS right_id FROM lb JOIN rb USING (band)
WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(rb.lat - lb.lat) / 2), 2)
      + cos(radians(lb.lat)) * cos(radians(rb.lat)) * pow(sin(radians(rb.lon - lb.lon) / 2), 2)))) <= 0.25""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dual_tree.near_pairs(read(spark, d, "companies_left"), read(spark, d, "companies_right"), 250.0, ("id", "lat", "lon"), ("id", "lat_noise", "lon_noise"), "loaded_at")


@query(f"""
WITH l AS ({_located('companies_left', 'lat', 'lon')}),
lb AS (SELECT *, CAST(floor(lat * 100) AS BIGINT) AS band FROM l),
rb AS (SELECT l.*, CAST(floor(lat * 100) AS BIGINT) + d AS band FROM l, (VALUES (-1), (0), (1)) v(d))
SELECT lb.id AS left_id, rb.id AS right_id FROM lb JOIN rb USING (band)
WHERE lb.id < rb.id AND 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(rb.lat - lb.lat) / 2), 2)
      + cos(radians(lb.lat)) * cos(radians(rb.lat)) * pow(sin(radians(rb.lon - lb.lon) / 2), 2)))) <= 0.1""")
def p1_near_within(spark: SparkSession, d: str) -> DataFrame:
    return dual_tree.near_within(read(spark, d, "companies_left"), 100.0, order_col="loaded_at")


@query(f"""
WITH l AS (SELECT city, lat, lon FROM companies_left JOIN ({_located('companies_left', 'lat', 'lon')}) USING (id, lat, lon) WHERE city IS NOT NULL),
region AS (SELECT city, median(lat) AS y, median(lon) AS x FROM l GROUP BY city)
SELECT DISTINCT r.id, region.city AS region_id FROM ({_located('companies_right', 'lat_noise', 'lon_noise')}) r JOIN region
  ON abs(r.lat - y) + abs(r.lon - x) <= 0.06""")
def p1_regions(spark: SparkSession, d: str) -> DataFrame:
    """The city districts, diamonds around the middle of a city's companies, that hold a company of the other source."""
    l = read(spark, d, "companies_left").filter(dual_tree.valid_location(F.col("lat"), F.col("lon")) & F.col("city").isNotNull())  # noqa: E741
    middle = l.groupBy("city").agg(F.median("lat").alias("y"), F.median("lon").alias("x"))
    corner = lambda dy, dx: F.struct((F.col("y") + dy).alias("lat"), (F.col("x") + dx).alias("lon"))
    regions = middle.select("city", F.array(corner(0.06, 0.0), corner(0.0, 0.06), corner(-0.06, 0.0), corner(0.0, -0.06)).alias("ring"))
    return dual_tree.containing_regions(read(spark, d, "companies_right"), regions, ("id", "lat_noise", "lon_noise"), ("city", "ring"), "loaded_at")


# --- cleaning ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, try_cast(regexp_replace(o_orderpriority, '[^0-9.]', '', 'g') AS DOUBLE) AS priority FROM orders")
def prepare_to_numeric(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", prepare.to_numeric(F.col("o_orderpriority")).alias("priority"))


@query("SELECT name_id, upper(coalesce(board_role, '')) AS board_role FROM board_names")
def prepare_fill_upper(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "board_names")
    return prepare.prepare(b, b, {"board_role": ["levenshtein"]}, "name_id", "name_id", fill_string_na=True, capitalize=True)[0]


@query("SELECT p_partkey, lower(p_type) AS p_type, lower(p_brand) AS p_brand FROM part")
def prepare_lower(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return prepare.prepare(p, p, {"p_type": ["levenshtein"], "p_brand": ["levenshtein"]}, "p_partkey", "p_partkey", capitalize=True, lower_case=True)[0]


@query("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(c_custkey AS VARCHAR) AS c_key FROM customer")
def prepare_align_types(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("c_key", F.col("c_custkey"))
    return prepare.prepare(c, read(spark, d, "part"), {"c_nationkey~p_retailprice": ["notzero"], "c_key~p_brand": ["levenshtein"]}, "c_custkey", "p_partkey")[0]


_STOP = sorted("a about after against all an and any are as at be before but by for from had has have he her his if in into is it its of on or that the their they this to under up was we were while will with not ready".split())
_STOP_SQL = ", ".join(f"'{w}'" for w in _STOP)


@query(f"""WITH t AS (SELECT item_id, list_filter(regexp_extract_all(passage, '[\\pL\\pN]+'), lambda x: regexp_full_match(x, '\\pL+') AND NOT list_contains([{_STOP_SQL}], lower(x))) AS w FROM eval_items)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM t""")
def stop_words_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").select("item_id", prepare.remove_stop_words(F.col("passage"), _STOP).alias("words"))


# --- frequencies -------------------------------------------------------------------------------------------------

_FREQ = {"relative": "n / sum(n) OVER ()", "minmax": "CASE WHEN max(n) OVER () = min(n) OVER () THEN 1.0 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END", "log": "ln(1 + n) / ln(1 + max(n) OVER ())"}


def _freq(scoring: str) -> None:
    @query(f"SELECT p_name AS value, round(({_FREQ[scoring]})::DOUBLE, 9) AS score FROM (SELECT p_name, count(*)::DOUBLE AS n FROM part GROUP BY p_name)", f"freq_{scoring}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return commonness.frequency_scores(read(spark, d, "part"), "p_name", scoring).withColumn("score", F.round("score", 9))


for _s in commonness.SCORINGS:
    _freq(_s)

_CORPUS = {"left": "SELECT c_nationkey AS nation FROM customer", "right": "SELECT s_nationkey AS nation FROM supplier", "both": "SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier"}


def _common(source: str) -> None:
    sql = f"""WITH c AS (SELECT nation, count(*)::DOUBLE AS n FROM ({_CORPUS[source]}) WHERE nation IS NOT NULL GROUP BY nation),
s AS (SELECT nation, CASE WHEN max(n) OVER () = min(n) OVER () THEN 1.0 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END AS score FROM c)
SELECT c_custkey, round(coalesce(score, 0.0)::DOUBLE, 9) AS nation_commonness FROM customer LEFT JOIN s ON c_nationkey = s.nation"""

    @query(sql, f"commonness_{source}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, s = read(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), read(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")
        out, _ = commonness.commonness(c, s, ["nation"], c, s, source)
        return out.select("c_custkey", F.round("nation_commonness", 9).alias("nation_commonness"))


for _s in _CORPUS:
    _common(_s)

# --- similarities ------------------------------------------------------------------------------------------------


def _sim(name: str, sql_value: str, spec: dict, feature: str) -> None:
    @query(f"SELECT c_custkey, s_suppkey, round(({sql_value})::DOUBLE, 9) AS score FROM {_PAIRS}", name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = pairs.similarity_features(read(spark, d, "customer"), read(spark, d, "supplier"), None, spec, "c_custkey", "s_suppkey", block_on=_BLOCK)
        return f.select("c_custkey", "s_suppkey", _rounded(F.col(feature), 9).alias("score"))


_sim("sim_levenshtein", _LEV, {"c_name~s_name": ["levenshtein"]}, "col_c_name_s_name_levenshtein")
_sim("sim_notmissing", "CASE WHEN c_name IS NOT NULL AND c_name <> '' AND s_name IS NOT NULL AND s_name <> '' THEN 1.0 ELSE 0.0 END", {"c_name~s_name": ["notmissing"]}, "col_c_name_s_name_notmissing")
_sim("sim_notzero", "CASE WHEN c_nationkey <> 0 AND s_nationkey <> 0 THEN 1.0 ELSE 0.0 END", {"c_nationkey~s_nationkey": ["notzero"]}, "col_c_nationkey_s_nationkey_notzero")
_sim("sim_pct_diff", "CASE WHEN c_acctbal = 0 THEN (CASE WHEN s_acctbal = 0 THEN 0.0 ELSE 1.0 END) ELSE abs(c_acctbal - s_acctbal) / abs(c_acctbal) END", {"c_acctbal~s_acctbal": ["pct_diff"]}, "col_c_acctbal_s_acctbal_pct_diff")
_sim("sim_jaro_winkler", "jaro_winkler_similarity(c_name, s_name)", {"c_name~s_name": ["jaro_winkler"]}, "col_c_name_s_name_jaro_winkler")


@query(f"SELECT c_custkey, s_suppkey, round((1 - abs(c_acctbal / 10000 - s_acctbal / 10000)) * (1 - (c_acctbal / 10000 + s_acctbal / 10000) / 2), 6) AS score FROM {_PAIRS}")
def sim_commonness(spark: SparkSession, d: str) -> DataFrame:
    c, s = read(spark, d, "customer").withColumn("x", F.col("c_acctbal") / 10000), read(spark, d, "supplier").withColumn("x", F.col("s_acctbal") / 10000)
    f = pairs.similarity_features(c, s, None, {"x": ["commonness_score"]}, "c_custkey", "s_suppkey", block_on=_BLOCK)
    return f.select("c_custkey", "s_suppkey", _rounded(F.col("col_x_x_commonness_score"), 6).alias("score"))


def _within(a: str, b: str, limit: str) -> str:
    return f"CAST(CASE WHEN {a} IS NULL OR isnan({a}) OR {b} IS NULL OR isnan({b}) THEN 0.0 WHEN abs({a} - {b}) <= {limit} THEN 1.0 ELSE 0.0 END AS DOUBLE)"


@query(f"""WITH l AS (SELECT id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(industry) AS industry FROM companies_left GROUP BY id), r AS (SELECT id, any_value(lat_noise) AS lat, any_value(lon_noise) AS lon, any_value(industry) AS industry FROM companies_right GROUP BY id)
SELECT l.id AS id_left, r.id AS id_right, {_within('l.lat', 'r.lat', '10 / 111.32')} AS lat, {_within('l.lon', 'r.lon', '10 / (111.32 * cos(radians(54.0)))')} AS lon FROM l JOIN r USING (industry)""")
def sim_within_km(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "companies_left").select("id", "lat", "lon", "industry").dropDuplicates(["id"])  # noqa: E741
    r = read(spark, d, "companies_right").select("id", F.col("lat_noise").alias("lat"), F.col("lon_noise").alias("lon"), "industry").dropDuplicates(["id"])
    f = pairs.similarity_features(l, r, None, {"lat": ["within_km_lat"], "lon": ["within_km_lon"]}, "id", "id", block_on=[("industry", "industry")], unique=False)
    return f.select("id_left", "id_right", F.col("col_lat_lat_within_km_lat").alias("lat"), F.col("col_lon_lon_within_km_lon").alias("lon"))


@query()
def sim_token_ratios(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    names = ["cosine", "basic_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "token_ratio", "partial_token_sort_ratio", "partial_token_set_ratio", "partial_token_ratio"]
    s = read(spark, d, "part").select(F.col("p_partkey").alias("q_partkey"), F.col("p_type").alias("q_type"), F.col("p_brand").alias("q_brand"))
    f = pairs.similarity_features(p, s, None, {"p_name~q_type": names}, "p_partkey", "q_partkey", block_on=[("p_brand", "q_brand")])
    return f.drop("match")


# --- pairs and labels --------------------------------------------------------------------------------------------

_SN = {"s_name~n_name": ["levenshtein"]}
_SN_LEV = "round(1.0 - levenshtein(s_name, n_name) / greatest(length(s_name), length(n_name))::DOUBLE, 9) AS score"


@query(f"SELECT s_suppkey, n_nationkey, {_SN_LEV} FROM supplier CROSS JOIN nation")
def pairs_cross(spark: SparkSession, d: str) -> DataFrame:
    f = pairs.similarity_features(read(spark, d, "supplier"), read(spark, d, "nation"), None, _SN, "s_suppkey", "n_nationkey")
    return f.select("s_suppkey", "n_nationkey", F.round("col_s_name_n_name_levenshtein", 9).alias("score"))


@query("SELECT a.p_partkey AS p_partkey_left, b.p_partkey AS p_partkey_right, CASE WHEN a.p_name = b.p_name THEN 1 ELSE 0 END AS same FROM part a JOIN part b USING (p_brand)")
def pairs_blocked(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    c = pairs.candidate_pairs(p, p, {"p_name": ["levenshtein"]}, "p_partkey", "p_partkey", [("p_brand", "p_brand")])
    return c.select("p_partkey_left", "p_partkey_right", (F.col("l_p_name") == F.col("r_p_name")).cast("int").alias("same"))


@query(f"SELECT c_custkey, s_suppkey, CASE WHEN c_custkey = s_suppkey THEN 1 ELSE 0 END AS match FROM {_PAIRS}")
def pairs_labelled_ids(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "supplier").select(F.col("s_suppkey").alias("left"), F.col("s_suppkey").alias("right"))
    f = pairs.similarity_features(read(spark, d, "customer"), read(spark, d, "supplier"), m, {"c_name~s_name": ["notmissing"]}, "c_custkey", "s_suppkey", block_on=_BLOCK)
    return f.select("c_custkey", "s_suppkey", "match")


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier), n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS q FROM nation),
m AS (SELECT DISTINCT s_suppkey AS p, s_nationkey AS q FROM supplier)
SELECT s.s_suppkey, n.n_nationkey, CASE WHEN m.p IS NULL THEN 0 ELSE 1 END AS match FROM s CROSS JOIN n LEFT JOIN m ON m.p = s.p AND m.q = n.q""")
def pairs_labelled_positions(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    m = s.select(F.col("s_suppkey").alias("left"), F.col("s_nationkey").alias("right"))
    return pairs.similarity_features(s, read(spark, d, "nation"), m, _SN, "s_suppkey", "n_nationkey", matches_are_positions=True).select("s_suppkey", "n_nationkey", "match")


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer), n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS q FROM nation)
SELECT c.p AS "left", n.q AS "right" FROM supplier LEFT JOIN c ON s_suppkey = c_custkey LEFT JOIN n ON s_nationkey = n_nationkey""")
def matches_reorder(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return known.matches_reorder(read(spark, d, "customer"), read(spark, d, "nation"), m, "c_custkey", "n_nationkey", "s_suppkey", "s_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)")
def anti_filter(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(s, "c_custkey", "left_anti")


_SPLIT = """WITH r AS (SELECT o_orderkey AS "left", o_custkey AS "right", row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, '42')), o_orderkey, o_custkey) - 1 AS k FROM orders), n AS (SELECT count(*) AS n FROM orders),
s AS (SELECT "left", "right", CASE WHEN k < round_even(0.3 * n, 0) THEN 'test' WHEN k < round_even(0.3 * n, 0) + round_even(0.1 * n, 0) THEN 'validation' ELSE 'train' END AS split FROM r, n)"""


@query(_SPLIT + ' SELECT "left", "right", split FROM s')
def split_matches(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("left"), F.col("o_custkey").alias("right"))
    return known.split_ranks(m)


def _split_part(k: int, name: str) -> None:
    @query(_SPLIT + f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS index_original FROM (SELECT DISTINCT "right" AS c_custkey FROM s WHERE split = '{name}')""", f"split_{name}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = read(spark, d, "orders")
        left, right = o.select(F.col("o_orderkey").alias("_pos")), read(spark, d, "customer").select(F.col("c_custkey").alias("_pos"))
        m = o.select(F.col("o_orderkey").alias("left"), F.col("o_custkey").alias("right"))
        return known.split_test_train(left, right, m)[k].right.select(F.col("_pos").alias("pos"), "index_original")


for _k, _s in enumerate(("train", "validation", "test")):
    _split_part(_k, _s)


@query("""WITH d AS (SELECT * FROM pair_labels), g AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', company_id_left, company_id_right, '42')), company_id_left, company_id_right) AS k FROM d WHERE is_match = 0)
SELECT company_id_left, company_id_right, is_match FROM d WHERE is_match = 1 UNION ALL
SELECT company_id_left, company_id_right, is_match FROM g WHERE k <= (SELECT round_even(0.5 * count(*), 0) FROM g)""")
def subsample_negatives(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pair_labels").select("company_id_left", "company_id_right", "is_match")
    return pairs.subsample_non_matches(p, ["company_id_left", "company_id_right"], 0.5, 42, "is_match")


# --- relations and closure ---------------------------------------------------------------------------------------

_BEST = """WITH b AS (SELECT "left", "right", max(prediction) AS prediction FROM suggestions WHERE prediction BETWEEN 0 AND 1 AND NOT isnan(prediction) GROUP BY ALL)"""


def _relation(kind: str, name: str) -> None:
    steps = {"1:m": ['"left"'], "m:1": ['"right"'], "1:1": ['"left"', '"right"']}[kind]
    sql = _BEST
    last = "b"
    for k, by in enumerate(steps):
        sql += f""", s{k} AS (SELECT * FROM {last} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY prediction DESC, "left", "right") = 1)"""
        last = f"s{k}"

    @query(sql + f' SELECT "left", "right", prediction FROM {last}', name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = read(spark, d, "suggestions").filter(F.col("prediction").between(0, 1) & ~F.isnan("prediction"))
        return suggest.relation(s.groupBy("left", "right").agg(F.max("prediction").alias("prediction")), kind)


for _k, _s in (("1:m", "relation_1m"), ("m:1", "relation_m1"), ("1:1", "relation_11")):
    _relation(_k, _s)

_LINKS = 'l AS (SELECT "left" AS x, "right" AS y FROM matches WHERE "left" IS NOT NULL AND "right" IS NOT NULL)'
_REACH = "r(id, seen) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.seen = e.x)"


@query('SELECT min(("left", "right"))[1] AS "left", min(("left", "right"))[2] AS "right" FROM matches WHERE "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY least("left", "right"), greatest("left", "right")')
def drop_repetitions(spark: SparkSession, d: str) -> DataFrame:
    return closure.drop_repetitions(read(spark, d, "matches").filter("left IS NOT NULL AND right IS NOT NULL"))


@query(f'WITH RECURSIVE {_LINKS}, e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), {_REACH} SELECT id AS "left", seen AS "right" FROM r WHERE id < seen')
def closure_pairs(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure_pairs(read(spark, d, "matches"))


@query(f'WITH RECURSIVE {_LINKS}, e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), {_REACH} SELECT "left", "right" FROM matches UNION ALL SELECT id, seen FROM r WHERE id <> seen')
def closure_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The matches as given, followed by every ordered pair of different linked ids."""
    return closure.all_ordered_pairs(read(spark, d, "matches"))


@query(f"""WITH RECURSIVE {_LINKS}, own AS (SELECT DISTINCT id, pid FROM panel WHERE pid IS NOT NULL),
pe AS (SELECT a.pid AS x, b.pid AS y FROM l JOIN own a ON l.x = a.id JOIN own b ON l.y = b.id),
e AS (SELECT x, y FROM pe UNION SELECT y, x FROM pe UNION SELECT pid, pid FROM own), {_REACH},
g AS (SELECT id AS pid, min(seen) AS group_id FROM r GROUP BY id) SELECT group_id, own.id FROM own JOIN g USING (pid)""")
def panel_groups(spark: SparkSession, d: str) -> DataFrame:
    """Panels whose records matches link, directly or indirectly; each record with the least panel."""
    own = read(spark, d, "panel").select("id", "pid").distinct()
    return closure.connected_panels(own, read(spark, d, "matches").filter("left IS NOT NULL AND right IS NOT NULL"), "id", "pid")


_PANEL = f"""WITH RECURSIVE {_LINKS}, star AS (SELECT id AS x, min(id) OVER (PARTITION BY pid) AS y FROM panel WHERE pid IS NOT NULL),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT x, y FROM star UNION SELECT y, x FROM star), {_REACH},
p AS (SELECT id, seen FROM r WHERE id IN (SELECT id FROM panel) AND seen IN (SELECT id FROM panel))"""


@query(_PANEL + """ SELECT id AS "left", seen AS "right" FROM p WHERE id < seen UNION ALL
SELECT id, id FROM p GROUP BY id HAVING min(seen) < id AND max(seen) > id""")
def panel_closure(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "panel").select("id", "pid", "col")
    return closure.data_preparation_panel(p, read(spark, d, "matches").select("left", "right"), "id", "pid").matches


@query(_PANEL + """ SELECT DISTINCT p.id, panel.col FROM p JOIN panel USING (id) WHERE p.id < p.seen""")
def panel_left(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "panel").select("id", "pid", "col")
    return closure.data_preparation_panel(p, read(spark, d, "matches").select("left", "right"), "id", "pid").left


@query(_PANEL + """, m AS (SELECT DISTINCT pid, id FROM panel WHERE pid IS NOT NULL) SELECT min(p.seen) AS first_id, m.id FROM m JOIN p USING (id) WHERE p.seen IN (SELECT id FROM m) GROUP BY m.id""")
def connected_panels(spark: SparkSession, d: str) -> DataFrame:
    """Panels linked by matches between their records or by sharing them; each record with the least linked record."""
    own = read(spark, d, "panel").select("id", "pid").filter("pid IS NOT NULL").distinct()
    star = own.groupBy("pid").agg(F.min("id").alias("left")).join(own, "pid").select("left", F.col("id").alias("right"))
    links = read(spark, d, "matches").select("left", "right").unionByName(star)
    data = closure.connected_components(links).select("group_id", "id").join(own.select("id").distinct(), "id", "left_semi")
    first = data.groupBy("group_id").agg(F.min("id").alias("first_id"))
    return data.join(first, "group_id").select("first_id", "id")


# --- panel identifiers -------------------------------------------------------------------------------------------

_EVENTS = """p AS (SELECT event_id AS idx, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type FROM events),
k AS (SELECT user_id, day, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS rk FROM (SELECT DISTINCT user_id, day FROM p)),
q AS (SELECT p.*, rk FROM p JOIN k USING (user_id, day)),
s AS (SELECT a.idx AS l, b.idx AS r, a.day AS dl, b.day AS dr, 1.0 - levenshtein(a.event_type, b.event_type) / greatest(length(a.event_type), length(b.event_type))::DOUBLE AS prediction
      FROM q a JOIN q b ON a.user_id = b.user_id AND b.rk = a.rk + 1),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l ORDER BY prediction DESC, r) = 1), u AS (SELECT * FROM t WHERE prediction >= 0.5)"""
_EVENT_SPEC = {"event_type": ["levenshtein"]}


def _event_panel(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("idx"), F.to_date("ts").cast("string").alias("day"), "user_id", "event_type")


def _event_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return panel_ids.period_suggestions(_event_panel(spark, d), _EVENT_SPEC, F.col("col_event_type_event_type_levenshtein"), "idx", "day", ["user_id"], 0.5)


@query(f"""WITH {_EVENTS} SELECT l AS "left", r AS "right", round(prediction, 9) AS prediction, dl || '-' || dr AS periods_compared FROM u""")
def panel_suggest(spark: SparkSession, d: str) -> DataFrame:
    return _event_suggestions(spark, d).select("left", "right", F.round("prediction", 9).alias("prediction"), "periods_compared")


@query(f"""WITH RECURSIVE {_EVENTS}, par AS (SELECT r, max(l) AS l FROM u GROUP BY r),
w(idx, root) AS (SELECT idx, idx FROM p WHERE idx NOT IN (SELECT r FROM par) UNION ALL SELECT par.r, w.root FROM par JOIN w ON par.l = w.idx) SELECT idx, root AS index_harm FROM w""")
def panel_roots(spark: SparkSession, d: str) -> DataFrame:
    return panel_ids.harmonize_ids(_event_suggestions(spark, d), _event_panel(spark, d), "idx")


@query()
def panel_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return panel_ids.generate_ids(_event_panel(spark, d), "panel_id", "day", F.col("col_event_type_event_type_levenshtein"), _EVENT_SPEC, "idx", 0.5, ["user_id"])


# --- measures ----------------------------------------------------------------------------------------------------

_LABELLED = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS match, l_quantity / 50.0 AS prediction FROM lineitem"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("match"), (F.col("l_quantity") / 50.0).alias("prediction"))


_MEASURES = """(tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""
_CURVE = f"""WITH s AS ({_LABELLED}), g AS (SELECT i / 100.0 AS threshold FROM range(1, 100) t(i)),
c AS (SELECT threshold, sum(CASE WHEN match = 1 AND prediction >= threshold THEN n ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN match = 0 AND prediction >= threshold THEN n ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN match = 0 AND prediction < threshold THEN n ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN match = 1 AND prediction < threshold THEN n ELSE 0 END)::DOUBLE AS fn
  FROM g CROSS JOIN (SELECT match, prediction, count(*) AS n FROM s GROUP BY ALL) GROUP BY threshold), m AS (SELECT threshold, {_MEASURES} FROM c)"""


@query(f"""WITH s AS ({_LABELLED}), c AS (SELECT count(*) FILTER (match = 1 AND prediction >= 0.5) AS tp, count(*) FILTER (match = 0 AND prediction >= 0.5) AS fp,
count(*) FILTER (match = 0 AND prediction < 0.5) AS tn, count(*) FILTER (match = 1 AND prediction < 0.5) AS fn FROM s), d AS (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn FROM c), m AS (SELECT {_MEASURES} FROM d)
SELECT tp, fp, tn, fn, round(accuracy, 9) AS accuracy, round(recall, 9) AS recall, round(precision, 9) AS precision, round(f1, 9) AS f1, round(mcc, 9) AS mcc FROM c, m""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.confusion(_labelled(spark, d))
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "recall", "precision", "f1", "mcc")])


def _best(metric: str) -> None:
    @query(_CURVE + f" SELECT threshold, round({metric}, 9) AS score FROM m ORDER BY round({metric}, 12) DESC, threshold LIMIT 1", f"best_threshold_{metric}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return metrics.best_threshold(_labelled(spark, d), metric).select("threshold", F.round("score", 9).alias("score"))


for _s in ("mcc", "f1"):
    _best(_s)


@query(f"WITH s AS ({_LABELLED}) SELECT round(count(*) FILTER (match = 0) / count(*)::DOUBLE, 9) AS w_pos, round(count(*) FILTER (match = 1) / count(*)::DOUBLE, 9) AS w_neg FROM s")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_weights(_labelled(spark, d)).select(F.round("w_pos", 9).alias("w_pos"), F.round("w_neg", 9).alias("w_neg"))


@query("WITH n AS (SELECT (SELECT count(*) FROM customer) AS l, (SELECT count(*) FROM supplier) AS r, (SELECT count(*) FROM supplier)::DOUBLE AS m) SELECT round(least(0.1 * (l * r - m) / (0.1 * (l * r - m) + m), 0.95), 9) AS alpha FROM n")
def alpha_balanced(spark: SparkSession, d: str) -> DataFrame:
    n, m = read(spark, d, "customer").count(), read(spark, d, "supplier").count()
    return spark.createDataFrame([(round(metrics.alpha_balanced(n, m, m, 0.1), 9),)], "alpha double")


@query(f"""WITH s AS ({_LABELLED}), b AS (SELECT prediction, sum(match) AS pos, count(*) AS n FROM s GROUP BY prediction),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS total FROM b WINDOW w AS (ORDER BY prediction DESC))
SELECT round(sum(pos / total::DOUBLE * tp / seen), 9) AS average_precision FROM c""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_labelled(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


_FOCAL = "avg((CASE WHEN match = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - pt, 2.0) * -ln(pt))"
_PT = f"(SELECT match, prediction, CASE WHEN match = 1 THEN least(greatest(prediction, 1e-7), 1 - 1e-7) ELSE 1 - least(greatest(prediction, 1e-7), 1 - 1e-7) END AS pt FROM ({_LABELLED}))"
_SOFT = "1 - (2 * sum(match * prediction) + 1e-7) / (2 * sum(match * prediction) + sum((1 - match) * prediction) + sum(match * (1 - prediction)) + 1e-7)"


@query(f"SELECT round({_FOCAL}, 8) AS loss FROM {_PT}")
def focal_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.focal_loss(_labelled(spark, d), 0.25, 2.0).select(F.round("loss", 8).alias("loss"))


@query(f"SELECT round({_SOFT}, 8) AS loss FROM {_PT}")
def soft_f1_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.soft_f1_loss(_labelled(spark, d)).select(F.round("loss", 8).alias("loss"))


@query(f"SELECT round(0.5 * ({_SOFT}) + 0.5 * {_FOCAL}, 8) AS loss FROM {_PT}")
def combined_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.combined_loss(_labelled(spark, d), 0.5, 1e-7, 0.25, 2.0).select(F.round("loss", 8).alias("loss"))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_PAIRS = [(a, b) for k, a in enumerate(_LINE) for b in _LINE[k + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 7) AS r FROM lineitem" for a, b in _LINE_PAIRS))
def feature_corr(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.correlations(read(spark, d, "lineitem"), _LINE)
    return spark.createDataFrame([(a, b, round(abs(v), 7)) for (a, b), v in r.items()], "a string, b string, r double")


@query("WITH s AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, y)), 7) AS r FROM s" for c in _LINE))
def target_corr(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    r = metrics.correlations(df, [*_LINE, "y"])
    return spark.createDataFrame([(a, round(abs(v), 7)) for (a, b), v in r.items() if b == "y"], "feature string, r double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature FROM lineitem HAVING min({c}) < max({c})" for c in _LINE))
def varying_columns(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in metrics.varying_columns(df, [*_LINE, "one"])], "feature string")


# --- set operators -----------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return union_all(spark, d).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def intersect_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("SELECT p_name, p_brand FROM part GROUP BY p_name, p_brand HAVING count(*) = 1")
def unique_only(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy("p_name", "p_brand").count().filter("count = 1").drop("count")


# --- models ------------------------------------------------------------------------------------------------------

_COMPANY = MatchSpec.of({"current_name~alternative_name": ["levenshtein", "jaro_winkler", "token_sort_ratio"], "city": ["levenshtein", "notmissing"], "industry": ["levenshtein"], "lat~lat_noise": ["within_km_lat"]})


def labelled_companies(spark: SparkSession, d: str) -> DataFrame:
    """The hand-checked company pairs with their features."""
    l = read(spark, d, "companies_left").select("company_id", "current_name", "city", "industry", "lat").dropDuplicates(["company_id"])  # noqa: E741
    r = read(spark, d, "companies_right").select("company_id", "alternative_name", "city", "industry", "lat_noise").dropDuplicates(["company_id"])
    y = read(spark, d, "pair_labels").select("company_id_left", "company_id_right", F.col("is_match").alias("match")).distinct()
    a = l.select(F.col("company_id").alias("company_id_left"), *[F.col(c).alias(f"l_{c}") for c in _COMPANY.left_columns])
    b = r.select(F.col("company_id").alias("company_id_right"), *[F.col(c).alias(f"r_{c}") for c in _COMPANY.right_columns])
    return pairs.score_pairs(y.join(a, "company_id_left").join(b, "company_id_right"), _COMPANY, Similarities.default())


def _predictions(model: models.MatchingModel, spark: SparkSession, d: str) -> DataFrame:
    data = labelled_companies(spark, d)
    return model.fit(data).predict(data).select("company_id_left", "company_id_right", "match", "prediction")


@query()
def logit_fit(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(models.LogitModel(), spark, d)


@query()
def probit_fit(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(models.ProbitModel(), spark, d)


@query()
def gb_fit(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(models.BoostedModel(trees=20), spark, d)


@query()
def network_fit(spark: SparkSession, d: str) -> DataFrame:
    data = labelled_companies(spark, d)
    m = network.NetworkModel(_COMPANY, width_scale=4, record_scale=4, depth=1, record_depth=1).fit(data, epochs=5)
    return m.predict(data).select("company_id_left", "company_id_right", "match", "prediction")


@query()
def feature_select(spark: SparkSession, d: str) -> DataFrame:
    r = selection.select_features(labelled_companies(spark, d), _COMPANY, ["company_id_left", "company_id_right"], cv=3, l1_ratios=(1.0,), cs=(0.1, 10.0), max_correlation=0.98)
    return spark.createDataFrame([(c, float(w), c in r.features) for c, w in r.coefficients.items()], "feature string, coefficient double, kept boolean")


@query()
def synth_rows(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return synthetic.synth_mismatches(p, "p_partkey", ["p_brand"], ["p_name", "p_size", "p_retailprice"], n_cols=2, n_mismatches=1)
