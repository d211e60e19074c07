"""Top N items within every group, by simultaneous per-group bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.runtime import Shelf, rows_of, skew_lookup

#: Parts of a group's open interval between whose midpoints rows are counted in one round.
FAN = 128
_ANY = (1 << 63) - 1


def _part() -> Column:
    """Which of FAN parts of its group's open interval a row lies in; 0 is the best.

    The interval's two ends always fall in different parts, so every round
    leaves fewer distinct codes in the open part.
    """
    at = lambda v, lo, hi: F.least(F.lit(FAN - 1), F.floor((v - lo) / F.greatest(hi - lo, F.lit(5e-324)) * FAN)).cast("int")
    d = lambda c: F.col(c).cast("double")
    by_score = F.lit(FAN - 1) - at(F.col("p"), F.col("lo_s"), F.col("hi_s"))
    by_item = F.when(F.col("i") == F.col("hi_i"), F.lit(FAN - 1)).otherwise(at(d("i"), d("lo_i"), d("hi_i")))
    return F.when(F.col("lo_s") < F.col("hi_s"), by_score).when(F.col("lo_i") < F.col("hi_i"), by_item).otherwise(F.lit(0))


def _inside() -> Column:
    tie = F.col("lo_s") == F.col("hi_s")
    return F.col("p").between(F.col("lo_s"), F.col("hi_s")) & (~tie | F.col("i").between(F.col("lo_i"), F.col("hi_i")))


def top_n(items: DataFrame, n: int = 5, group: str = "left", item: str = "right", score: str = "prediction", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(group, item, place): the ``n`` items of highest score in every group, place 1..n.

    A score that is null, NaN or outside [low, high] is none; an item scored
    several times counts once, with its highest score; of equal scores the
    smaller item comes first.  Null groups or items are ignored; a group with
    fewer items gives fewer rows; an empty table gives an empty result; other
    columns are ignored.

    Score (descending) and item (ascending) form one order-preserving code.  All
    groups with more than n items are bisected together: rows are counted above
    evenly spaced midpoints of each group's open interval, the part that holds
    the n-th row becomes the next interval, first over scores and, within one
    score, over items, until exactly n rows lie at or above the cutoff.  Rows
    outside the open interval leave at once.  A round shuffles counts (at most
    FAN a group and task); no group is ever sorted or gathered.
    """
    shelf = Shelf(items.sparkSession, "topn")
    s = F.col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & s.between(low, high) & F.col(group).isNotNull() & F.col(item).isNotNull()
    rows = items.filter(ok).select(F.col(group).alias("g"), F.col(item).cast("long").alias("i"), (s + F.lit(0.0)).alias("p"))
    rows = shelf.put(rows.groupBy("g", "i").agg(F.max("p").alias("p")), "rows")
    total = rows_of(rows)

    spans = [F.min("p").alias("lo_s"), F.max("p").alias("hi_s"), F.min("i").alias("lo_i"), F.max("i").alias("hi_i")]
    state = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), *spans)
    state = state.select("g", (F.col("c") > n).alias("open"), F.lit(n).cast("long").alias("need"), "lo_s", "hi_s", "lo_i", "hi_i", F.col("lo_s").alias("cut_s"), F.lit(_ANY).alias("cut_i"))
    state = shelf.put(state, "state")
    cutoffs, active = state.filter(~F.col("open")).select("g", "cut_s", "cut_i"), rows
    while True:
        todo = state.filter("open").select("g", "need", "lo_s", "hi_s", "lo_i", "hi_i")
        left = rows_of(todo)
        if not left:
            break
        seen = shelf.put(skew_lookup(active, "g", todo, "g", total, table_rows=left).filter(_inside()), "active")
        counts = seen.withColumn("b", _part()).groupBy("g", "b", "need").agg(F.count(F.lit(1)).alias("c"), F.max("lo_s").alias("was_lo"), F.max("hi_s").alias("was_hi"), *spans)
        above = F.sum("c").over(Window.partitionBy("g").orderBy("b"))  # at most FAN rows a group
        pivot = counts.withColumn("upto", above).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        needed = F.col("need") - (F.col("upto") - F.col("c"))
        nxt = pivot.select(
            "g", (F.col("c") > needed).alias("open"), needed.alias("need"), "lo_s", "hi_s", "lo_i", "hi_i",
            F.col("lo_s").alias("cut_s"), F.when(F.col("was_lo") < F.col("was_hi"), F.lit(_ANY)).otherwise(F.col("hi_i")).alias("cut_i"),
        )
        state = shelf.put(nxt, "state")
        cutoffs = cutoffs.unionByName(state.filter(~F.col("open")).select("g", "cut_s", "cut_i"))
        if active is not rows:
            shelf.drop(active)
        active = seen.select("g", "i", "p")
        active._kinweave_path = seen._kinweave_path
    kept = skew_lookup(rows, "g", cutoffs, "g", total).filter((F.col("p") > F.col("cut_s")) | ((F.col("p") == F.col("cut_s")) & (F.col("i") <= F.col("cut_i"))))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), F.asc("i")))  # n rows a group
    return kept.select(F.col("g").alias(group), F.col("i").alias(item), place.cast("long").alias("place"))
