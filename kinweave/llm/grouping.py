"""Consolidating pairwise matches into groups, and splits that keep groups together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.ordering import global_positions
from kinweave.runtime import Shelf, rows_of, ship, skew_lookup


def consolidate(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(group_id, id): every id of a pair with both sides, with the smallest id of its group.

    Minimum labels run along the pairs and pointers are jumped until no label
    changes, each round written to the shared folder.  Pairs with a null side
    are ignored; repeated, reversed and self pairs change nothing (an id linked
    only to itself is a group of one); other columns are ignored; an empty table
    gives an empty result.
    """
    return connected_components(pairs, left, right).select("group_id", "id")


def related_groups(panel: DataFrame, pairs: DataFrame, shelf: Shelf, key: str = "pid") -> DataFrame:
    """(group_id, id) over panel ids and pair ids, linked by pairs or an equal non-null ``key``.

    Records of one key value are linked to its smallest id (a star, not all
    pairs), so a key held by a third of all rows adds one edge per row.
    """
    p = panel.select("id", F.col(key).alias("k")).filter(F.col("id").isNotNull())
    keyed = shelf.put(p.filter(F.col("k").isNotNull()).distinct(), "keyed")
    first = keyed.groupBy("k").agg(F.min("id").alias("first")).withColumnRenamed("k", "fk")
    star = skew_lookup(keyed, "k", first, "fk", rows_of(keyed)).select(F.col("id").alias("a"), F.col("first").alias("b"))
    links = pairs.select(F.col("left").cast("long").alias("a"), F.col("right").cast("long").alias("b"))
    edges = links.unionByName(star.select(F.col("a").cast("long"), F.col("b").cast("long")))
    return connected_components(edges, "a", "b", panel.select(F.col("id").cast("long")), shelf).select("group_id", "id")


def torn_groups(panel: DataFrame, pairs: DataFrame, split: str = "old_split", key: str = "pid") -> DataFrame:
    """(id): panel ids whose group has records in two or more different non-null splits."""
    shelf = Shelf(panel.sparkSession, "torn")
    groups = shelf.put(related_groups(panel, pairs, shelf, key), "groups")
    rows = panel.select(F.col("id").cast("long").alias("id"), F.col(split).alias("s")).distinct()
    placed = shelf.put(rows.join(groups, "id"), "placed")
    torn = placed.groupBy("group_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter(F.col("lo") != F.col("hi")).select(F.col("group_id").alias("g"))
    return skew_lookup(placed, "group_id", torn, "g", rows_of(placed)).select("id").distinct()


def differenced(rows: list) -> list:
    """Largest differencing over rows of slot weights: where each slot of each row ends.

    The two rows of widest spread are joined, heavy slots of one with light
    slots of the other, until one row is left; the places are then read off the
    tree of joins from its root.
    """
    import numpy as np

    width = len(rows[0])
    heap = [(-int(w.max() - w.min()), n, w, n) for n, w in enumerate(rows)]
    heapq.heapify(heap)
    joins, n = {}, len(rows)
    while len(heap) > 1:
        _, _, wa, a = heapq.heappop(heap)
        _, _, wb, b = heapq.heappop(heap)
        oa, ob = np.argsort(-wa, kind="stable"), np.argsort(wb, kind="stable")
        ra, rb = np.empty(width, np.int64), np.empty(width, np.int64)
        ra[oa], rb[ob] = np.arange(width), np.arange(width)
        w = wa[oa] + wb[ob]
        joins[n] = ((a, ra), (b, rb))
        heapq.heappush(heap, (-int(w.max() - w.min()), n, w, n))
        n += 1
    ends, todo = [None] * len(rows), [(heap[0][3], np.arange(width))]
    while todo:
        k, at = todo.pop()
        if k < len(rows):
            ends[k] = at
        else:
            todo += [(c, at[r]) for c, r in joins[k]]
    return ends


def _join_items(bins: int):
    """(task, key, weight) rows of one task to their slots; every key starts as a row of its own."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        rows = np.zeros((len(pdf), bins), np.int64)
        rows[:, 0] = pdf["weight"].to_numpy()
        ends = differenced(list(rows))
        return pd.DataFrame({"task": pdf["task"], "key": pdf["key"], "weight": pdf["weight"], "slot": [int(e[0]) for e in ends]})

    return run


def _join_rows(bins: int):
    """(tuple, slot, weight, next) rows of one task to the slots they get in the joined tuple."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        names = sorted(pdf["tuple"].unique())
        at = {t: k for k, t in enumerate(names)}
        rows = np.zeros((len(names), bins), np.int64)
        rows[pdf["tuple"].map(at).to_numpy(), pdf["slot"].to_numpy()] = pdf["weight"].to_numpy()
        ends = np.concatenate(differenced(list(rows)))
        out = pd.DataFrame({"tuple": np.repeat(names, bins), "slot": np.tile(np.arange(bins), len(names)), "weight": rows.ravel(), "new_slot": ends})
        out["next"] = int(pdf["next"].iloc[0])
        return out[["tuple", "slot", "weight", "next", "new_slot"]]

    return run


def balanced_bins(weights: DataFrame, shelf: Shelf, bins: int = 400, fan_in: int = 32, task_keys: int = 4_000) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(key, bin) for rows (key, weight), and the (bin, weight) list of at most ``bins`` bins.

    Keys in descending weight are dealt over tasks of at most ``task_keys``
    keys, so that each has heavy keys and light ones to even them out with; a
    task joins its keys into one row of ``bins`` slots by largest differencing.
    The rows of ``fan_in`` tasks meet again in the same way, until one is left.
    """
    ship(weights.sparkSession)
    ordered = global_positions(weights.select("key", F.col("weight").cast("long").alias("weight")), [F.col("weight").desc(), F.col("key")], shelf, "weights")
    n = rows_of(ordered)
    tuples = max(1, (n + task_keys - 1) // task_keys)
    dealt = ordered.select((F.col("pos") % tuples).alias("task"), "key", "weight")
    kind = weights.schema["key"].dataType.simpleString()
    ordered = shelf.put(dealt.groupBy("task").applyInPandas(_join_items(bins), f"task long, key {kind}, weight long, slot long"), "slots")
    state, steps = ordered.groupBy(F.col("task").alias("tuple"), "slot").agg(F.sum("weight").alias("weight")), []
    while tuples > 1:
        tuples = (tuples + fan_in - 1) // fan_in
        wide = state.withColumn("next", F.col("tuple") % F.lit(tuples))
        step = shelf.put(wide.groupBy("next").applyInPandas(_join_rows(bins), "tuple long, slot long, weight long, next long, new_slot long"), "step")
        steps.append(step)
        state = step.groupBy(F.col("next").alias("tuple"), F.col("new_slot").alias("slot")).agg(F.sum("weight").alias("weight"))
    totals = [(int(r[0]), int(r[1])) for r in state.groupBy("slot").agg(F.sum("weight")).collect()]  # at most `bins` rows
    where = None
    for step in reversed(steps):
        here = step.select("tuple", "slot", "next", "new_slot")
        if where is None:
            where = here.select("tuple", "slot", F.col("new_slot").alias("bin"))
        else:
            up = where.select(F.col("tuple").alias("next"), F.col("slot").alias("new_slot"), "bin")
            where = here.join(up, ["next", "new_slot"]).select("tuple", "slot", "bin")
    if where is None:
        return ordered.select("key", F.col("slot").alias("bin")), totals
    return ordered.join(where, (F.col("task") == F.col("tuple")) & (ordered["slot"] == where["slot"])).select("key", "bin"), totals


def share_out(totals: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: heaviest bin first, to the split that lacks most of its target."""
    whole = sum(w for _, w in totals)
    lacks = {s: f * whole for s, f in shares.items()}
    out = {}
    for b, w in sorted(totals, key=lambda x: (-x[1], x[0])):
        s = max(lacks, key=lambda k: (lacks[k], shares[k]))
        out[b] = s
        lacks[s] -= w
    return out


def grouped_split(panel: DataFrame, pairs: DataFrame, shares: dict[str, float] | None = None, key: str = "pid", bins: int = 400) -> DataFrame:
    """(id, split): one split per related group, in the given proportions.

    Components of pairs and equal keys; component sizes balanced into many
    equal bins by largest differencing; whole bins dealt to the splits.  Every
    non-null panel id appears once, whatever is null beside it; repeated rows
    count once; pair ids that the panel lacks link but are not listed; an empty
    panel gives an empty result.  A group heavier than a split's share goes,
    whole, to the split that lacks most.
    """
    shares = shares or {"train": 0.7, "validation": 0.1, "test": 0.2}
    shelf = Shelf(panel.sparkSession, "split")
    ids = panel.select(F.col("id").cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct()
    groups = shelf.put(related_groups(panel, pairs, shelf, key).join(ids, "id", "left_semi"), "groups")
    weights = groups.groupBy(F.col("group_id").alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    placed, totals = balanced_bins(weights, shelf, bins)
    if not totals:
        return ids.withColumn("split", F.lit(None).cast("string")).limit(0)
    to = share_out(totals, shares)
    name = F.create_map(*[x for b, s in to.items() for x in (F.lit(b).cast("long"), F.lit(s))])
    table = placed.select("key", name[F.col("bin")].alias("split"))
    return skew_lookup(groups, "group_id", table, "key", rows_of(groups)).select("id", "split")
