"""Known matches: coercion, positions, exact splits."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.operators.ordering import global_positions
from kinweave.operators.pairs import order_hash, with_positions
from kinweave.runtime import Shelf


def coerce_matches(spark: SparkSession, matches, id_type: str = "bigint") -> DataFrame:
    """(left, right) from a DataFrame, a list of pairs, or None for none."""
    if matches is None:
        return spark.createDataFrame([], f"left {id_type}, right {id_type}")
    if isinstance(matches, DataFrame):
        return matches
    if isinstance(matches, (list, tuple)):
        return spark.createDataFrame([tuple(m) for m in matches], f"left {id_type}, right {id_type}")
    raise TypeError(f"matches are a DataFrame, a list of pairs or None, not {type(matches).__name__}")


def matches_reorder(left: DataFrame, right: DataFrame, matches: DataFrame, left_id: str, right_id: str, matches_left: str, matches_right: str, order_left: str | None = None, order_right: str | None = None) -> DataFrame:
    """(left, right) positions of id matches, sorted by left; ids that a table lacks give null."""
    for df, i, side in ((left, left_id, "left"), (right, right_id, "right")):
        if not df.groupBy(i).count().filter("count > 1").isEmpty():
            raise ValueError(f"{side} ids must be unique")
    shelf = Shelf(left.sparkSession, "reorder")
    pl = with_positions(left, order_left or left_id, "__p", shelf).select(F.col(left_id).alias("__l"), "__p")
    pr = with_positions(right, order_right or right_id, "__q", shelf).select(F.col(right_id).alias("__r"), "__q")
    out = matches.join(pl, F.col(matches_left) == F.col("__l"), "left").join(pr, F.col(matches_right) == F.col("__r"), "left")
    return out.select(F.col("__p").alias("left"), F.col("__q").alias("right")).orderBy("left", "right")


class SplitError(ValueError):
    """The ratios of a split do not fit together."""


class MatchSplit(NamedTuple):
    left: DataFrame
    right: DataFrame
    matches: DataFrame


def unpack_split(split) -> MatchSplit:
    """A split from a tuple or a dict with left, right and matches."""
    if isinstance(split, dict):
        return MatchSplit(split["left"], split["right"], split["matches"])
    return MatchSplit(*split)


def split_ranks(matches: DataFrame, test_ratio: float = 0.3, validation_ratio: float = 0.1, seed: int = 42, left: str = "left", right: str = "right") -> DataFrame:
    """``matches`` with ``split``: exactly round-half-even(ratio x n) test and validation matches, the rest train.

    The order is a hash of the pair and the seed; ranks come from a range
    partitioning, so no task sorts all matches.
    """
    if test_ratio < 0 or validation_ratio < 0 or test_ratio + validation_ratio > 1:
        raise SplitError("ratios must not be negative nor exceed 1 together")
    shelf = Shelf(matches.sparkSession, "split")
    ranked = global_positions(matches.withColumn("__h", order_hash(seed, left, right)), [F.col("__h"), F.col(left), F.col(right)], shelf, pos="__rank")
    n = ranked.count()
    test = round(test_ratio * n)
    validation = round(validation_ratio * n)
    name = F.when(F.col("__rank") < test, "test").when(F.col("__rank") < test + validation, "validation").otherwise("train")
    return ranked.withColumn("split", name).drop("__h", "__rank")


def split_test_train(left: DataFrame, right: DataFrame, matches: DataFrame, left_pos: str = "_pos", right_pos: str = "_pos", test_ratio: float = 0.3, validation_ratio: float = 0.1, seed: int = 42) -> tuple[MatchSplit, MatchSplit, MatchSplit]:
    """(train, validation, test), each with its entities and matches.

    ``matches`` holds positions.  Each split has the entities its matches name,
    renumbered 0..m-1 with the old position in ``index_original``, and its
    matches in the new positions, sorted by left.  With m:n matches an entity
    may be in several splits.
    """
    shelf = Shelf(left.sparkSession, "split")
    parts = shelf.put(split_ranks(matches.select("left", "right"), test_ratio, validation_ratio, seed), "parts")
    out = []
    for name in ("train", "validation", "test"):
        m = parts.filter(F.col("split") == name).select("left", "right")

        def side(df: DataFrame, pos: str, col: str) -> DataFrame:
            kept = df.join(m.select(F.col(col).alias("__k")).distinct(), F.col(pos) == F.col("__k"), "left_semi").withColumnRenamed(pos, "index_original")
            return global_positions(kept, [F.col("index_original")], shelf, f"{name}-{col}", pos)

        sl, sr = side(left, left_pos, "left"), side(right, right_pos, "right")
        a = sl.select(F.col("index_original").alias("left"), F.col(left_pos).alias("__l"))
        b = sr.select(F.col("index_original").alias("right"), F.col(right_pos).alias("__r"))
        moved = m.join(a, "left").join(b, "right").select(F.col("__l").alias("left"), F.col("__r").alias("right")).orderBy("left", "right")
        out.append(MatchSplit(sl, sr, moved))
    return tuple(out)
