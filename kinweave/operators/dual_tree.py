"""Points near other points, and regions that contain points, by dual-tree joins.

Both point sets hang in one implicit octree over the unit sphere's cube (3-D, so
neither the poles nor the date line are special).  Pairs of nodes are refined
from the root downwards, two levels a round, with the *tight* box of the points
below each node:

* the boxes are farther apart than the radius: the pair is dropped;
* all corners are within the radius: the pair is accepted wholesale;
* few point pairs are left, or the deepest level is reached: the pair becomes a
  leaf, whose points are compared one by one;
* otherwise its children meet in the next round.

Every step is a DataFrame join on node keys, so node pairs and leaf pairs
spread over all tasks; node tables are written between rounds.  At the end only
levels where pairs were decided are joined with the points: a level with few
decided nodes keeps the points below these nodes alone, before any shuffle.
Points on the same spot are one location until the very end, so a crowded spot
costs one comparison; it is expanded only in the output, dealt over several keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.runtime import BROADCAST_ROWS, HOT_SHARE, Shelf, rows_of

EARTH_KM = 6371.0088
_BITS = 20
_STEP = 2
_LEAF_PRODUCT = 256
#: Ids of one spot that one key of the output join holds.
SPOT_IDS = 50_000


def valid_location(lat: Column, lon: Column) -> Column:
    """Null, NaN, out-of-range and (0, 0) coordinates are no location."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return ok & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~((lat == 0) & (lon == 0))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _one_per_id(df: DataFrame, id_col: str, lat: str, lon: str, order_col: str | None) -> DataFrame:
    """One row per id: of repeated ids the row with the greatest order column (then coordinates)."""
    order = F.col(order_col) if order_col else F.lit(0)
    d = df.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), order.alias("o"))
    d = d.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("o", "lat", "lon")).alias("m"))
    # adding 0.0 turns -0.0 into 0.0, so equal spots are equal keys
    d = d.select("id", (F.col("m.lat") + F.lit(0.0)).alias("lat"), (F.col("m.lon") + F.lit(0.0)).alias("lon"))
    return d.filter(valid_location(F.col("lat"), F.col("lon")))


def _locations(points: DataFrame) -> DataFrame:
    rad = lambda c: F.radians(F.col(c))
    xyz = points.select("lat", "lon").distinct().withColumns({"x": F.cos(rad("lat")) * F.cos(rad("lon")), "y": F.cos(rad("lat")) * F.sin(rad("lon")), "z": F.sin(rad("lat"))})
    cell = lambda c: F.least(F.lit((1 << _BITS) - 1), F.floor((F.col(c) + 1.0) * float(1 << (_BITS - 1)))).cast("long")
    return xyz.withColumns({"ix": cell("x"), "iy": cell("y"), "iz": cell("z")})


def _node(level: Column) -> Column:
    s = (F.lit(_BITS) - level).cast("int")
    at = lambda c: F.call_function("shiftright", F.col(c), s)
    return F.shiftleft(at("ix"), 40).bitwiseOR(F.shiftleft(at("iy"), 20)).bitwiseOR(at("iz"))


def _by_level(locations: DataFrame, levels: list[int]) -> DataFrame:
    return locations.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("node", _node(F.col("level")))


def _below(locations: DataFrame, decided: list[tuple[int, int, DataFrame]], node: str) -> DataFrame:
    """The locations under decided nodes, with (level, node); ``decided`` lists (level, decided pairs, table of these).

    No other level is looked at.  The levels with the fewest decided pairs, as all coarse ones are, have their locations
    filtered by the decided nodes (broadcast, their number counted before) ahead of the shuffle.
    """
    few, total = [], 0
    for level, n, table in sorted(decided, key=lambda x: x[1]):
        if total + n > BROADCAST_ROWS:
            break
        few.append((level, table))
        total += n
    many = [level for level, _, _ in decided if level not in {x for x, _ in few}]
    parts = [_by_level(locations, many)] if many else []
    if few:
        nodes = few[0][1].select("level", F.col(node).alias("node"))
        for _, table in few[1:]:
            nodes = nodes.unionByName(table.select("level", F.col(node).alias("node")))
        parts.append(_by_level(locations, [x for x, _ in few]).join(F.broadcast(nodes), ["level", "node"], "left_semi"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _with_ids(spots: DataFrame, points: DataFrame, shelf: Shelf, lat: str, lon: str, name: str, spot_ids: int) -> DataFrame:
    """``spots`` with the ids that lie on each; a spot with more than ``spot_ids`` ids (and a thousandth of all, so
    that there are fewer than a thousand such spots) is dealt over several keys."""
    total = rows_of(points)
    p = points.select(F.col("id").alias(name), F.col("lat").alias(lat), F.col("lon").alias(lon))
    if total <= spot_ids:
        return spots.join(p, [lat, lon])
    n = p.groupBy(lat, lon).count().filter((F.col("count") > spot_ids) & (F.col("count") > total / HOT_SHARE))
    crowded = shelf.put(n.select(lat, lon, F.ceil(F.col("count") / spot_ids).cast("int").alias("deals")), "crowded")
    if crowded.isEmpty():
        return spots.join(p, [lat, lon])
    deals = F.coalesce("deals", F.lit(1))
    p = p.join(F.broadcast(crowded), [lat, lon], "left").withColumn("deal", F.pmod(F.xxhash64(name), deals).cast("int")).drop("deals")
    s = spots.join(F.broadcast(crowded), [lat, lon], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return s.join(p, [lat, lon, "deal"]).drop("deal")


def _nodes(tagged: DataFrame) -> DataFrame:
    """(level, node, parent, n, tight box) of every node that holds a location."""
    box = [f(F.col(c)).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))]
    up = F.greatest(F.col("level") - _STEP, F.lit(0))
    return tagged.withColumn("parent", _node(up)).groupBy("level", "node", "parent").agg(F.count(F.lit(1)).alias("n"), *box)


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float = 250.0, left_cols=("id", "lat", "lon"), right_cols=("id", "lat", "lon"), order_col: str | None = None, spot_ids: int = SPOT_IDS) -> DataFrame:
    """(left_id, right_id) of all points at most ``radius_m`` apart along the great circle.

    Null ids and invalid coordinates have no location and no pair; an id given
    more than once counts once; an empty side gives an empty result; other
    columns, whatever their names, are ignored.  A pair is listed once.
    """
    spark = left.sparkSession
    shelf = Shelf(spark, "dualtree")
    pl = shelf.put(_one_per_id(left, *left_cols, order_col), "left")
    pr = shelf.put(_one_per_id(right, *right_cols, order_col), "right")
    chord = 2 * math.sin(min(math.pi / 2, radius_m / 2000.0 / EARTH_KM))
    deepest = max(_STEP, min(_BITS, int(math.ceil(math.log2(2 / max(chord, 1e-9)))) + 3))
    deepest += deepest % _STEP
    levels = list(range(0, min(deepest, _BITS) + 1, _STEP))
    ll, lr = _locations(pl), _locations(pr)
    nl = shelf.put(_nodes(_by_level(ll, levels)), "nodes-l")
    nr = shelf.put(_nodes(_by_level(lr, levels)), "nodes-r")

    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}"), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"))
    far = lambda c: F.greatest(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}"), F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"))
    squares = lambda f: sum((f(c) * f(c) for c in "xyz"), F.lit(0.0))
    low, high = (chord * (1 - 1e-6)) ** 2, (chord * (1 + 1e-6)) ** 2

    def side(nodes: DataFrame, level: int, p: str) -> DataFrame:
        return nodes.filter(F.col("level") == level).drop("level").select(*(F.col(c).alias(f"{p}_{c}") for c in nodes.columns if c != "level"))

    decided, open_pairs = [], None
    for level in levels:
        a, b = side(nl, level, "a"), side(nr, level, "b")
        if open_pairs is None:  # one root on each side
            met = a.join(b, F.col("a_parent") == F.col("b_parent"))
        else:
            met = open_pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(a, F.col("pa") == F.col("a_parent")).join(b, F.col("pb") == F.col("b_parent"))
        last = level == levels[-1]
        status = F.when(squares(far) <= low, F.lit("accept")).when((F.col("a_n") * F.col("b_n") <= _LEAF_PRODUCT) | F.lit(last), F.lit("leaf")).otherwise(F.lit("refine"))
        step = met.filter(squares(gap) <= high).select(F.lit(level).alias("level"), F.col("a_node").alias("a"), F.col("b_node").alias("b"), status.alias("status"))
        step = shelf.put(step, f"pairs-{level}")
        n = {r[0]: r[1] for r in step.groupBy("status").count().collect()}  # three rows
        done = sum(c for s, c in n.items() if s != "refine")
        if done:
            decided.append((level, done, step.filter(F.col("status") != "refine")))
        open_pairs = step.filter(F.col("status") == "refine")
        if last or not n.get("refine"):
            break

    ids = lambda spots: _with_ids(_with_ids(spots, pl, shelf, "lat_l", "lon_l", "left_id", spot_ids), pr, shelf, "lat_r", "lon_r", "right_id", spot_ids).select("left_id", "right_id")
    if not decided:
        return ids(pl.limit(0).select(*(F.col(c).alias(f"{c}_{x}") for x in "lr" for c in ("lat", "lon"))))
    pairs = decided[0][2]
    for _, _, d in decided[1:]:
        pairs = pairs.unionByName(d)
    at_l = _below(ll, decided, "a").select("level", F.col("node").alias("a"), F.col("lat").alias("lat_l"), F.col("lon").alias("lon_l"))
    at_r = _below(lr, decided, "b").select("level", F.col("node").alias("b"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"))
    spots = pairs.join(at_l, ["level", "a"]).join(at_r, ["level", "b"])
    exact = great_circle_km(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r")) <= F.lit(radius_m / 1000.0)
    return ids(spots.filter((F.col("status") == "accept") | exact).select("lat_l", "lon_l", "lat_r", "lon_r"))


def near_within(points: DataFrame, radius_m: float, cols=("id", "lat", "lon"), order_col: str | None = None) -> DataFrame:
    """Pairs (a < b) of one table's own points within the radius."""
    p = near_pairs(points, points, radius_m, cols, cols, order_col)
    return p.filter(F.col("left_id") < F.col("right_id"))


# --- regions -----------------------------------------------------------------------------------------------------


def _edges(ring: Column) -> Column:
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("p"), nxt.alias("q"))


def inside(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies in the ring of these edges, or on it (ray casting in the plane of lat and lon)."""
    y1, x1, y2, x2 = (lambda e: e["p"]["lat"]), (lambda e: e["p"]["lon"]), (lambda e: e["q"]["lat"]), (lambda e: e["q"]["lon"])
    span = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    on = F.exists(edges, lambda e: ((x2(e) - x1(e)) * (lat - y1(e)) == (y2(e) - y1(e)) * (lon - x1(e))) & span(lat, y1(e), y2(e)) & span(lon, x1(e), x2(e)))
    crosses = lambda e: ((y1(e) > lat) != (y2(e) > lat)) & (lon < F.try_divide((x2(e) - x1(e)) * (lat - y1(e)), y2(e) - y1(e)) + x1(e))
    return on | (F.size(F.filter(edges, crosses)) % 2 == 1)


def containing_regions(points: DataFrame, regions: DataFrame, point_cols=("id", "lat", "lon"), region_cols=("id", "ring"), order_col: str | None = None, leaf: int = 32, spot_ids: int = SPOT_IDS) -> DataFrame:
    """(id, region_id): every region that contains a point, for every point.

    A region is a ring, an array of (lat, lon) structs without repeating the
    first; its edges are straight in the plane of lat and lon, so a region over
    the date line is to be given as two.  Points on an edge are contained.
    Points are tight boxes in a quadtree; a region first meets the few nodes of
    the level where cells are as large as it is, so that no node is met by all
    regions.  A node outside the region's box is dropped; one that no edge
    comes near is accepted or dropped whole by one of its corners; one of at most
    ``leaf`` places is compared exactly; the others are refined.

    Null ids, invalid locations, and rings with null ids, null coordinates or
    under three corners give no row; repeated rows count once; other columns are
    ignored; an empty side gives an empty result.
    """
    shelf = Shelf(points.sparkSession, "regions")
    pp = shelf.put(_one_per_id(points, *point_cols, order_col), "points")
    unit = lambda c, low, span: F.least(F.lit((1 << _BITS) - 1), F.floor((c - low) / span * float(1 << _BITS))).cast("long")
    spots = pp.select("lat", "lon").distinct().withColumns({"x": F.col("lat"), "y": F.col("lon"), "z": F.lit(0.0), "ix": unit(F.col("lat"), -90.0, 180.0), "iy": unit(F.col("lon"), -180.0, 360.0), "iz": F.lit(0).cast("long")})
    levels = list(range(0, _BITS + 1, _STEP))
    nodes = shelf.put(_nodes(_by_level(spots, levels)), "nodes")

    ring = F.transform(F.col(region_cols[1]), lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lon"].cast("double").alias("lon")))
    known = regions.select(F.col(region_cols[0]).alias("rid"), ring.alias("ring")).filter(F.col("rid").isNotNull() & (F.size("ring") >= 3))
    known = known.filter(~F.exists("ring", lambda p: p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"]))).distinct()
    box = {f"{f}_{c}": g(F.col(f"ring.{c}")) for c in ("lat", "lon") for f, g in (("lo", F.array_min), ("hi", F.array_max))}
    known = known.withColumns(box).withColumn("edges", _edges(F.col("ring"))).drop("ring")
    size = F.greatest((F.col("hi_lat") - F.col("lo_lat")) / 180.0, (F.col("hi_lon") - F.col("lo_lon")) / 360.0)
    level = F.when(size <= 2.0**-_BITS, _BITS).when(size >= 1.0, 0).otherwise(F.floor(-F.log2(size)))
    known = shelf.put(known.withColumn("level", (level - level % _STEP).cast("int")).withColumn("rno", F.monotonically_increasing_id()), "regions")
    count = rows_of(known)
    small = lambda d: F.broadcast(d) if count <= BROADCAST_ROWS // 10 else d  # noqa: E731  # rings are wider than a lookup's rows

    def cells(c: str, low: float, span: float) -> Column:
        at = lambda v: F.shiftright(unit(F.greatest(F.lit(low), F.least(F.lit(low + span), F.col(v))), low, span), 0)
        cut = lambda v: F.call_function("shiftright", at(v), F.lit(_BITS) - F.col("level"))
        return F.sequence(cut(f"lo_{c}"), cut(f"hi_{c}"))

    first = known.select("rno", "level", F.explode(cells("lat", -90.0, 180.0)).alias("cx"), F.col("lo_lon"), F.col("hi_lon")).select("rno", "level", "cx", F.explode(cells("lon", -180.0, 360.0)).alias("cy"))
    first = shelf.put(first.select("rno", "level", F.shiftleft("cx", 40).bitwiseOR(F.shiftleft("cy", 20)).alias("node")), "first")  # a few cells a region

    decided, open_pairs = [], None
    for level in levels:
        here = nodes.filter(F.col("level") == level).drop("level")
        met = first.filter(F.col("level") == level).select("rno", "node").join(here, "node").select("rno", *here.columns)
        if open_pairs is not None:
            met = met.unionByName(open_pairs.select("rno", F.col("node").alias("up")).join(here, F.col("up") == F.col("parent")).select("rno", *here.columns))
        met = met.join(small(known.drop("level", "rid")), "rno")
        apart = (F.col("hi_x") < F.col("lo_lat")) | (F.col("lo_x") > F.col("hi_lat")) | (F.col("hi_y") < F.col("lo_lon")) | (F.col("lo_y") > F.col("hi_lon"))
        beside = lambda e: (F.greatest(e["p"]["lat"], e["q"]["lat"]) >= F.col("lo_x")) & (F.least(e["p"]["lat"], e["q"]["lat"]) <= F.col("hi_x")) & (F.greatest(e["p"]["lon"], e["q"]["lon"]) >= F.col("lo_y")) & (F.least(e["p"]["lon"], e["q"]["lon"]) <= F.col("hi_y"))
        clear = ~F.exists("edges", beside)
        last = level == levels[-1]
        status = F.when(clear & inside(F.col("edges"), F.col("lo_x"), F.col("lo_y")), F.lit("accept")).when(clear, F.lit("drop")).when((F.col("n") <= leaf) | F.lit(last), F.lit("leaf")).otherwise(F.lit("refine"))
        step = met.filter(~apart).select(F.lit(level).alias("level"), "rno", "node", status.alias("status")).filter(F.col("status") != "drop")
        step = shelf.put(step, f"pairs-{level}")
        n = {r[0]: r[1] for r in step.groupBy("status").count().collect()}  # three rows
        done = sum(c for s, c in n.items() if s != "refine")
        if done:
            decided.append((level, done, step.filter(F.col("status") != "refine")))
        open_pairs = step.filter(F.col("status") == "refine") if n.get("refine") else None

    out = None
    for level, n, table in decided:  # few pairs are sent to the points, however many points lie below one; many meet by the node
        at = spots.select("lat", "lon", _node(F.lit(level)).alias("node"))
        met = at.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, "node").select("lat", "lon", "rno", "status")
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = pp.limit(0).select("lat", "lon", F.lit(0).cast("long").alias("rno"), F.lit("").alias("status"))
    sure = out.filter(F.col("status") == "accept").join(small(known.select("rno", "rid")), "rno")
    open_ = out.filter(F.col("status") == "leaf").join(small(known.select("rno", "rid", "edges")), "rno").filter(inside(F.col("edges"), F.col("lat"), F.col("lon")))
    found = sure.select("lat", "lon", "rid").unionByName(open_.select("lat", "lon", "rid"))
    return _with_ids(found, pp, shelf, "lat", "lon", "id", spot_ids).select("id", F.col("rid").alias("region_id")).distinct()
