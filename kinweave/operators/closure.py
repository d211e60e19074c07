"""Transitive closure of matches, and match data from panels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.components import connected_components
from kinweave.runtime import Shelf, rows_of, skew_lookup

#: Ids of a component that one task pairs with all others of it.
PAIR_BLOCK = 5_000


class PanelData(NamedTuple):
    left: DataFrame
    right: DataFrame
    matches: DataFrame


def drop_repetitions(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """One row per unordered pair: the smallest (left, right)."""
    least, most = F.least(left, right), F.greatest(left, right)
    return pairs.groupBy(least.alias("__a"), most.alias("__b")).agg(F.min(F.struct(left, right)).alias("m")).select(f"m.{left}", f"m.{right}")


def _members(groups: DataFrame, limit: int | None) -> None:
    if limit is None:
        return
    big = groups.groupBy("group_id").count().filter(F.col("count") > limit).take(1)
    if big:
        raise ValueError(f"component {big[0][0]} has {big[0][1]} ids; its pairs are refused beyond {limit}")


def linked_pairs(groups: DataFrame, left: str, right: str, block: int = PAIR_BLOCK) -> DataFrame:
    """Every two ids of a component, the smaller one left; a component of many ids is dealt over tasks in blocks."""
    sizes = groups.groupBy(F.col("group_id").alias("g")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = skew_lookup(groups, "group_id", sizes, "g", rows_of(groups))
    a = dealt.select("group_id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias(left))
    b = dealt.select("group_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias(right))
    return a.join(b, ["group_id", "block"]).filter(F.col(left) < F.col(right)).select(left, right)


def closure_pairs(matches: DataFrame, left: str = "left", right: str = "right", max_component: int | None = None) -> DataFrame:
    """(left, right) with left < right for every two ids linked directly or indirectly.

    A component of k ids gives k(k-1)/2 pairs; ``max_component`` refuses larger ones, by default none.
    """
    shelf = Shelf(matches.sparkSession, "closure")
    groups = shelf.put(connected_components(matches, left, right, None, shelf), "groups")
    _members(groups, max_component)
    return linked_pairs(groups, left, right)


def all_ordered_pairs(matches: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """The matches as given, then all ordered pairs of different linked ids."""
    closed = closure_pairs(matches, left, right)
    turned = closed.select(F.col(right).alias(left), F.col(left).alias(right))
    return matches.select(left, right).unionByName(closed).unionByName(turned)


def connected_panels(panel_of: DataFrame, matches: DataFrame, member: str, panel: str, left: str = "left", right: str = "right") -> DataFrame:
    """(group_id, member): members of panels that matches between members link, panel value 0 and '' included."""
    own = panel_of.select(F.col(member).alias("__m"), F.col(panel).alias("__p")).filter(F.col("__p").isNotNull())
    a = matches.join(own.select(F.col("__m").alias(left), F.col("__p").alias("pa")), left)
    ab = a.join(own.select(F.col("__m").alias(right), F.col("__p").alias("pb")), right).select("pa", "pb")
    groups = connected_components(ab, "pa", "pb", own.select("__p"))
    return own.join(groups, F.col("__p") == F.col("id")).select("group_id", F.col("__m").alias(member))


def stable_ids(panel: DataFrame, matches: DataFrame | None, unique_id: str) -> str:
    """bigint if all ids, in the panel and the matches, are whole numbers; else string."""
    kinds = [dict(panel.dtypes)[unique_id]] + ([t for _, t in matches.select(matches.columns[:2]).dtypes] if matches is not None else [])
    if all(k in ("bigint", "int", "smallint", "tinyint") for k in kinds):
        return "bigint"
    ids = [panel.select(F.col(unique_id).cast("string").alias("v"))] + ([matches.select(F.col(c).cast("string").alias("v")) for c in matches.columns[:2]] if matches is not None else [])
    odd = [d.filter(F.col("v").isNotNull() & F.col("v").try_cast("bigint").isNull()).isEmpty() for d in ids]
    return "bigint" if all(odd) else "string"


def data_preparation_panel(panel: DataFrame, matches: DataFrame | None, unique_id: str, panel_id: str | None = None, max_component: int | None = None) -> PanelData:
    """Left and right entities and closed matches of a panel.

    Every two ids of a component are a match, the smaller one left; an id that
    occurs on both sides also matches itself, once.  Ids of the panel with one
    ``panel_id`` count as linked.  Only ids in the panel are kept.  The left and
    right entities need no pairs; these are computed only where matches are read.
    """
    spark = panel.sparkSession
    shelf = Shelf(spark, "panel")
    kind = stable_ids(panel, matches, unique_id)
    panel = panel.withColumn(unique_id, F.col(unique_id).cast(kind))
    ids = panel.select(F.col(unique_id).alias("id")).distinct()
    edges = spark.createDataFrame([], f"left {kind}, right {kind}")
    if matches is not None:
        l, r = matches.columns[:2]  # noqa: E741
        edges = edges.unionByName(matches.select(F.col(l).cast(kind).alias("left"), F.col(r).cast(kind).alias("right")))
    if panel_id:
        own = panel.select(unique_id, panel_id).filter(F.col(panel_id).isNotNull())
        first = own.groupBy(panel_id).agg(F.min(unique_id).alias("left"))
        edges = edges.unionByName(own.join(first, panel_id).select("left", F.col(unique_id).alias("right")))
    groups = shelf.put(connected_components(edges, shelf=shelf).join(ids, "id", "left_semi"), "groups")
    _members(groups, max_component)
    ends = groups.groupBy("group_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    placed = groups.join(ends, "group_id")
    inner = placed.filter((F.col("id") > F.col("lo")) & (F.col("id") < F.col("hi"))).select(F.col("id").alias("left"), F.col("id").alias("right"))
    given = edges.filter(F.col("left") == F.col("right")) if matches is not None and not panel_id else spark.createDataFrame([], f"left {kind}, right {kind}")
    given = given.join(ids.select(F.col("id").alias("left")), "left", "left_semi").select("left", "right")
    closed = linked_pairs(groups, "left", "right").unionByName(inner.unionByName(given).distinct())
    sides = {"left": placed.filter(F.col("id") < F.col("hi")), "right": placed.filter(F.col("id") > F.col("lo"))}
    frame = panel.drop(panel_id) if panel_id else panel
    on = lambda side: frame.join(sides[side].select(F.col("id").alias(unique_id)).unionByName(given.select(F.col("left").alias(unique_id))), unique_id, "left_semi").select(frame.columns).distinct().orderBy(unique_id)
    return PanelData(on("left"), on("right"), closed.orderBy("left", "right"))


def data_preparation_cs(left: DataFrame, right: DataFrame, matches: DataFrame | None, unique_id: str) -> PanelData:
    """The same from two tables with ids of one kind."""
    return data_preparation_panel(left.unionByName(right, allowMissingColumns=True), matches, unique_id)
