"""Synthetic non-matches: altered copies of records for training."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, NumericType

from kinweave.functions.similarity import Similarities, missing, pct_diff
from kinweave.operators.pairs import sample_exact
from kinweave.operators.panel_ids import hash_uuid
from kinweave.runtime import Shelf


def _check(str_range, pct_range, n_cols: int, n_mismatches: int, shares: Iterable[float], columns_change: list[str]) -> None:
    if not 0 <= str_range[0] <= str_range[1] <= 1:
        raise ValueError("the string similarity range must lie in [0, 1]")
    if not 0 <= pct_range[0] <= pct_range[1] <= 1:
        raise ValueError("the percentage range must lie in [0, 1]")
    if n_mismatches < 1:
        raise ValueError("n_mismatches must be at least 1")
    if not 1 <= n_cols <= max(1, len(columns_change)):
        raise ValueError("n_cols must be between 1 and the number of changeable columns")
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie in [0, 1]")


def synth_mismatches(
    right: DataFrame, id_right: str, columns_fix: list[str], columns_change: list[str], str_metric: str = "levenshtein", str_similarity_range: tuple[float, float] = (0.0, 0.3), pct_diff_range: tuple[float, float] = (0.1, 0.2),
    n_cols: int = 1, n_mismatches: int = 1, keep_missing: bool = True, nan_share: float = 0.0, empty_share: float = 0.0, sample_share: float = 1.0, seed: int = 42, sims: Similarities | None = None,
) -> DataFrame:
    """``right`` followed by altered copies with new ids, marked by ``synthetic``.

    floor(sample_share x n) rows get ``n_mismatches`` copies each; in every copy
    exactly ``n_cols`` of ``columns_change`` take another value of that column
    whose similarity (text) or percentage difference (numbers) to the original
    lies in the range, chosen by hash; where the column has none, a number is
    moved into the range and a text is built from other letters.  Copies equal
    to an original or to each other are dropped; missing and empty cells are
    then strewn among the changed cells.
    """
    _check(str_similarity_range, pct_diff_range, n_cols, n_mismatches, (nan_share, empty_share, sample_share), columns_change)
    sims = sims or Similarities.default()
    sims.check([str_metric])
    shelf = Shelf(right.sparkSession, "synthetic")
    data = [id_right, *columns_fix, *columns_change]
    kinds = {f.name: f.dataType for f in right.schema}
    base = sample_exact(right.select(*data), math.floor(sample_share * right.count()), seed, id_right)
    draw = lambda *what: F.xxhash64(F.col("__row"), F.col("__k"), *[F.lit(w) for w in what], F.lit(seed))
    unit = lambda *what: F.pmod(draw(*what), F.lit(1_000_003)) / 1_000_003.0
    copies = base.withColumn("__row", F.col(id_right).cast("string")).withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n_mismatches))))
    turn = F.array_sort(F.array(*[F.struct(draw("turn", c).alias("h"), F.lit(c).alias("c")) for c in columns_change]))
    copies = shelf.put(copies.withColumn("__chosen", F.transform(F.slice(turn, 1, n_cols), lambda x: x["c"])), "copies")
    for c in columns_change:
        number = isinstance(kinds[c], NumericType)
        gone = missing(F.col(c), kinds[c].typeName())
        pool = right.select(F.col(c).alias("__v")).filter(~missing(F.col("__v"), kinds[c].typeName())).distinct()
        origins = copies.filter(~gone).select(F.col(c).alias("__o")).distinct()
        lo, hi = pct_diff_range if number else str_similarity_range
        if number:  # the range is a pair of intervals of the candidate, so the join is no comparison of all pairs
            o, v = F.col("__o").cast("double"), F.col("__v").cast("double")
            near = origins.join(pool, (v.between(o - F.abs(o) * hi - 1e-9, o + F.abs(o) * hi + 1e-9)) & pct_diff(o, v).between(lo, hi) & (v != o))
        else:
            similarity = sims.column(str_metric, F.col("__o"), "string", F.col("__v"), "string")
            near = origins.crossJoin(pool).filter((F.col("__o") != F.col("__v")) & similarity.between(lo, hi))
        options = near.groupBy("__o").agg(F.sort_array(F.collect_set("__v")).alias("__options"))
        copies = copies.join(options, F.col(c) == F.col("__o"), "left").drop("__o")
        any_option = F.get(F.col("__options"), F.pmod(draw("pick", c), F.greatest(F.size("__options"), F.lit(1))).cast("int"))
        if number:
            share = lo + (hi - lo) * unit("size", c)
            moved = F.col(c) * (1 + F.when(unit("sign", c) < 0.5, -1).otherwise(1) * share)
            if isinstance(kinds[c], IntegralType):
                moved = F.round(moved)
            other = F.when(F.col(c) == 0, F.lit(1)).otherwise(moved).cast(kinds[c])
        else:
            other = F.substring(F.translate(F.upper(F.md5(draw("text", c).cast("string"))), "0123456789ABCDEF", "qxzjkvwyqxzjkvwy"), F.lit(1), F.greatest(F.length(c), F.lit(3)))
        changed = F.coalesce(any_option, other)
        value = F.when(gone, F.lit(None) if keep_missing else any_option).otherwise(changed)
        copies = copies.withColumn(c, F.when(F.array_contains("__chosen", c), value).otherwise(F.col(c))).drop("__options")
    same = [c for c in data if c != id_right]
    fresh = copies.join(right.select(*[F.col(c).alias(f"__{c}") for c in same]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same], "left_anti")
    fresh = fresh.withColumn("__twins", F.count(F.lit(1)).over(Window.partitionBy(*same))).filter(F.col("__twins") == 1)
    for c in columns_change:
        hit, u = F.array_contains("__chosen", c), unit("blank", c)
        blanked = F.when(hit & (u < nan_share), F.lit(None).cast(kinds[c])).otherwise(F.col(c))
        if not isinstance(kinds[c], NumericType):
            blanked = F.when(hit & (u >= nan_share) & (u < nan_share + empty_share), F.lit("")).otherwise(blanked)
        fresh = fresh.withColumn(c, blanked)
    new_id = hash_uuid(F.concat_ws("|", "__row", F.col("__k").cast("string")), str(seed))
    if isinstance(kinds[id_right], IntegralType):
        new_id = F.abs(F.xxhash64("__row", "__k", F.lit(seed))).cast(kinds[id_right]) if kinds[id_right].typeName() == "long" else F.abs(F.hash("__row", "__k", F.lit(seed)))
    synthetic = fresh.withColumn(id_right, new_id.cast(kinds[id_right])).select(*data, F.lit(True).alias("synthetic"))
    return right.select(*data, F.lit(False).alias("synthetic")).unionByName(synthetic)
