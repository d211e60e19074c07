"""Candidate pairs of two tables with their similarity features and labels."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, isqrt

from pyspark.sql import DataFrame, functions as F

from kinweave.functions.similarity import Similarities, missing
from kinweave.operators.ordering import global_positions
from kinweave.runtime import BROADCAST_ROWS, Shelf
from kinweave.spec import MatchSpec, feature_name

#: Pairs without blocking beyond this are refused.
MAX_UNBLOCKED_PAIRS = 200_000_000
#: So many pairs a task makes where there are more; tasks are at most MAX_TASKS and then larger.
PAIRS_A_TASK, MAX_TASKS = 1_000_000, 2_000
#: A block with more pairs than a task is cut into tiles, at most so many in all.
MAX_TILES = 10_000


def with_positions(df: DataFrame, order_col: str, pos: str = "_pos", shelf: Shelf | None = None) -> DataFrame:
    """0-based positions in the order of a unique column, without a single-task window."""
    return global_positions(df, [F.col(order_col)], shelf or Shelf(df.sparkSession, "positions"), pos=pos)


def require_unique(df: DataFrame, id_col: str, what: str) -> None:
    twice = df.groupBy(id_col).count().filter("count > 1").select(id_col).take(3)
    if twice:
        raise ValueError(f"{what} ids must be unique; repeated: {[r[0] for r in twice]}")


def id_names(left_id: str, right_id: str) -> tuple[str, str]:
    """Equal id names get a side each; different ones stay."""
    return (f"{left_id}_left", f"{right_id}_right") if left_id == right_id else (left_id, right_id)


def _blocked(a: DataFrame, b: DataFrame, li: str, ri: str, on: list[tuple[str, str]]) -> DataFrame:
    """All pairs of rows with equal block values, dealt evenly over the tasks.

    The blocks are counted first.  If one side is counted small, it is broadcast
    and the other dealt; else blocks with many pairs are cut into tiles of some
    lefts by some rights, each a key of its own.  No pair is shuffled.
    """
    ka, kb = [x for x, _ in on], [y for _, y in on]
    equal = [F.col(x) == F.col(y) for x, y in on]
    if any(a.schema[x].dataType != b.schema[y].dataType for x, y in on):  # cast values may meet several
        return a.join(b, equal)
    rows = F.count(F.lit(1))
    sizes = a.groupBy(*ka).agg(rows.alias("__n")).join(b.groupBy(*kb).agg(rows.alias("__m")), equal, "full").withColumn("__p", F.col("__n").cast("double") * F.col("__m"))
    n, m, total = (x or 0 for x in sizes.agg(F.sum("__n"), F.sum("__m"), F.sum("__p")).first())
    if total <= PAIRS_A_TASK:
        return a.join(b, equal)
    tasks = min(MAX_TASKS, ceil(total / PAIRS_A_TASK))
    if min(n, m) <= BROADCAST_ROWS:
        (big, keys), small = ((a, ka), b) if m <= n else ((b, kb), a)
        return big.dropna(subset=keys).repartition(tasks).sortWithinPartitions(*keys).join(F.broadcast(small), equal).select(*a.columns, *b.columns)
    tile = max(PAIRS_A_TASK, ceil(total / MAX_TILES))
    cuts = []
    for r in sizes.filter(F.col("__p") > tile).collect():  # fewer than MAX_TILES
        lefts = ceil(r["__n"] / isqrt(tile))
        cuts.append((*r[: len(on)], *(r[y] for y in kb), lefts, ceil(r["__m"] * ceil(r["__n"] / lefts) / tile)))
    names = ", ".join(f"__c{k} {t.dataType.simpleString()}" for k, t in enumerate(a.schema[x] for x in ka))

    def tiled(df: DataFrame, keys: list[str], i: str, own: str, other: str) -> DataFrame:
        hot = df.sparkSession.createDataFrame([(*c[: len(on)], *c[-2:]) for c in cuts], f"{names}, __lefts int, __rights int")
        parts = lambda c: F.coalesce(F.col(f"__{c}s"), F.lit(1))
        df = df.dropna(subset=keys).join(F.broadcast(hot), [F.col(x) == F.col(f"__c{k}") for k, x in enumerate(keys)], "left")
        df = df.withColumn(f"__{own}_{own}", F.pmod(F.xxhash64(i), parts(own)).cast("int")).withColumn(f"__{own}_{other}", F.explode(F.sequence(F.lit(0), parts(other) - 1)))
        df = df.drop(*[f"__c{k}" for k in range(len(on))], "__lefts", "__rights")
        return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, f"__{own}_left", f"__{own}_right")

    x, y = tiled(a, ka, li, "left", "right"), tiled(b, kb, ri, "right", "left")
    return x.join(y, [*equal, *(F.col(f"__left_{s}") == F.col(f"__right_{s}") for s in ("left", "right"))]).select(*a.columns, *b.columns)


def few_value_pairs(left: DataFrame, right: DataFrame, x: str, y: str, block_on: list[tuple[str, str]] | None = None) -> DataFrame | None:
    """At least the value pairs (``l_<x>``, ``r_<y>``) that meet in a pair, told from the sides alone; None if they may be more than BROADCAST_ROWS."""
    la, rb, blocks = f"l_{x}", f"r_{y}", block_on or []
    a, b = left.select(F.col(x).alias(la)).distinct(), right.select(F.col(y).alias(rb)).distinct()
    if a.count() * b.count() <= BROADCAST_ROWS:
        return a.crossJoin(b)
    if not blocks:
        return None
    a = left.select(F.col(x).alias(la), *[F.col(p).alias(f"__a{k}") for k, (p, _) in enumerate(blocks)]).distinct()
    b = right.select(F.col(y).alias(rb), *[F.col(q).alias(f"__b{k}") for k, (_, q) in enumerate(blocks)]).distinct()
    on = [F.col(f"__a{k}") == F.col(f"__b{k}") for k in range(len(blocks))]
    n = a.groupBy(*[f"__a{k}" for k in range(len(blocks))]).agg(F.count(F.lit(1)).alias("__n"))
    m = b.groupBy(*[f"__b{k}" for k in range(len(blocks))]).agg(F.count(F.lit(1)).alias("__m"))
    if (n.join(m, on).agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0) > BROADCAST_ROWS:
        return None
    return a.join(b, on).select(la, rb).distinct()


def candidate_pairs(left: DataFrame, right: DataFrame, spec, left_id: str, right_id: str, block_on: list[tuple[str, str]] | None = None, unique: bool = True) -> DataFrame:
    """All pairs of the two tables, or with ``block_on`` those with equal block values.

    Columns: the ids, then ``l_<column>`` and ``r_<column>``.  Rows with a null
    block value are in no pair.  Without blocks the smaller side is broadcast
    only if it is counted small, and more than MAX_UNBLOCKED_PAIRS are refused.
    """
    spec = MatchSpec.of(spec)
    for df, cols, i in ((left, spec.left_columns, left_id), (right, spec.right_columns, right_id)):
        lacking = [c for c in (i, *cols) if c not in df.columns]
        if lacking:
            raise KeyError(f"columns not in the table: {lacking}")
    if unique:
        require_unique(left, left_id, "left")
        require_unique(right, right_id, "right")
    li, ri = id_names(left_id, right_id)
    blocks = block_on or []
    a = left.select(F.col(left_id).alias(li), *[F.col(c).alias(f"l_{c}") for c in spec.left_columns], *[F.col(x).alias(f"__a{k}") for k, (x, _) in enumerate(blocks)])
    b = right.select(F.col(right_id).alias(ri), *[F.col(c).alias(f"r_{c}") for c in spec.right_columns], *[F.col(y).alias(f"__b{k}") for k, (_, y) in enumerate(blocks)])
    if blocks:
        return _blocked(a, b, li, ri, [(f"__a{k}", f"__b{k}") for k in range(len(blocks))]).drop(*[f"__{s}{k}" for s in "ab" for k in range(len(blocks))])
    n, m = left.count(), right.count()
    if n * m > MAX_UNBLOCKED_PAIRS:
        raise ValueError(f"{n} x {m} pairs without blocking; give block_on")
    if min(n, m) <= BROADCAST_ROWS:
        return a.crossJoin(F.broadcast(b)) if m <= n else F.broadcast(a).crossJoin(b)
    return a.crossJoin(b)


def score_pairs(pairs: DataFrame, spec, sims: Similarities | None = None, distinct_values: bool = True, few_values: Callable[[str, str], DataFrame | None] | None = None) -> DataFrame:
    """The id columns of ``pairs`` with one ``col_<left>_<right>_<similarity>`` DOUBLE per triple; 0 where a side is missing.

    Similarities that Spark expresses are one projection.  Those that need
    Python are computed once per distinct value pair and joined back.  Where
    ``few_values`` tells the value pairs of two columns, all comparisons of their
    texts are looked up in a broadcast; where it tells that they are many, pairs are scored in place, once
    per value pair of a batch.
    """
    spec, sims = MatchSpec.of(spec), sims or Similarities.default()
    sims.check(s for _, _, s in spec)
    kinds = {c: t.dataType.typeName() for c, t in zip(pairs.columns, pairs.schema)}
    ids = [c for c in pairs.columns if not c.startswith(("l_", "r_"))]
    cols = {}
    by_value: dict[tuple[str, str], list[str]] = {}
    dear = sims.python | sims.text | set(sims.batched)
    known = {c: few_values(*c) for c in spec.column_pairs if any(t[:2] == c and t[2] in dear for t in spec)} if few_values and distinct_values else {}
    for a, b, s in spec:
        if s in (dear if (a, b) in known else sims.python) and distinct_values and known.get((a, b), pairs) is not None:
            by_value.setdefault((a, b), []).append(s)
        else:
            many = known.get((a, b), pairs) is None
            cols[feature_name(a, b, s)] = sims.column(s, F.col(f"l_{a}"), kinds[f"l_{a}"], F.col(f"r_{b}"), kinds[f"r_{b}"], batched=many)
    out = pairs.withColumns(cols) if cols else pairs
    for k, ((a, b), names) in enumerate(by_value.items()):
        la, rb = f"l_{a}", f"r_{b}"
        values = known.get((a, b), pairs).filter(~missing(F.col(la), kinds[la]) & ~missing(F.col(rb), kinds[rb])).select(la, rb).distinct()
        scored = values.select(F.col(la).alias(f"__x{k}"), F.col(rb).alias(f"__y{k}"), *[sims.column(s, F.col(la), kinds[la], F.col(rb), kinds[rb]).alias(feature_name(a, b, s)) for s in names])
        out = out.join(F.broadcast(scored) if (a, b) in known else scored, (F.col(la) == F.col(f"__x{k}")) & (F.col(rb) == F.col(f"__y{k}")), "left").drop(f"__x{k}", f"__y{k}")
        out = out.fillna(0.0, [feature_name(a, b, s) for s in names])
    return out.select(*ids, *spec.features)


def label_pairs(pairs: DataFrame, matches: DataFrame, left_col: str, right_col: str, matches_left: str = "left", matches_right: str = "right", match_col: str = "match") -> DataFrame:
    """Adds ``match``: 1 where the pair is among the matches (repeated matches count once), else 0; matches counted few are broadcast, so that no pair is shuffled."""
    kl, kr = pairs.schema[left_col].dataType, pairs.schema[right_col].dataType
    m = matches.select(F.col(matches_left).cast(kl).alias("__ml"), F.col(matches_right).cast(kr).alias("__mr")).distinct().withColumn("__m", F.lit(1))
    if m.count() <= BROADCAST_ROWS:
        m = F.broadcast(m)
    out = pairs.join(m, (F.col(left_col) == F.col("__ml")) & (F.col(right_col) == F.col("__mr")), "left")
    return out.withColumn(match_col, F.coalesce("__m", F.lit(0)).cast("int")).drop("__ml", "__mr", "__m")


def similarity_features(
    left: DataFrame, right: DataFrame, matches: DataFrame | None, spec, left_id: str, right_id: str, *, block_on: list[tuple[str, str]] | None = None, sims: Similarities | None = None, match_col: str = "match",
    matches_left: str = "left", matches_right: str = "right", matches_are_positions: bool = False, order_left: str | None = None, order_right: str | None = None, unique: bool = True,
) -> DataFrame:
    """Pairs, features and labels in one lazy plan.

    Matches are ids, or positions in the order of ``order_left`` and
    ``order_right`` (the ids, unless given).  An empty side gives an empty table
    of the full schema.
    """
    spec = MatchSpec.of(spec)
    pairs = score_pairs(candidate_pairs(left, right, spec, left_id, right_id, block_on, unique), spec, sims, few_values=lambda x, y: few_value_pairs(left, right, x, y, block_on))
    li, ri = id_names(left_id, right_id)
    if matches is None:
        return pairs.withColumn(match_col, F.lit(0).cast("int"))
    if matches_are_positions:
        shelf = Shelf(left.sparkSession, "positions")
        pl = with_positions(left, order_left or left_id, "__p", shelf).select(F.col("__p"), F.col(left_id).alias("__l"))
        pr = with_positions(right, order_right or right_id, "__q", shelf).select(F.col("__q"), F.col(right_id).alias("__r"))
        matches = matches.join(pl, F.col(matches_left) == F.col("__p")).join(pr, F.col(matches_right) == F.col("__q")).select(F.col("__l").alias("left"), F.col("__r").alias("right"))
        matches_left, matches_right = "left", "right"
    return label_pairs(pairs, matches, li, ri, matches_left, matches_right, match_col)


def order_hash(seed: int, *cols: str):
    """A reproducible pseudo-random order that other engines can compute as well."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def sample_exact(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), by hash order of the keys; the kept rows stay spread over the tasks."""
    shelf = Shelf(df.sparkSession, "sample")
    ranked = global_positions(df.withColumn("__h", order_hash(seed, *keys)), [F.col("__h"), *[F.col(k) for k in keys]], shelf, "sample", "__pos")
    return ranked.filter(F.col("__pos") < n).drop("__h", "__pos")


def subsample_non_matches(pairs: DataFrame, keys: list[str], mismatch_share: float = 1.0, seed: int = 42, match_col: str = "match") -> DataFrame:
    """All positives and round-half-even(share x negatives) negatives; a missing label is a negative."""
    if not 0 < mismatch_share <= 1:
        raise ValueError("mismatch_share must be in (0, 1]")
    positive = F.coalesce(F.col(match_col) == 1, F.lit(False))
    negatives = pairs.filter(~positive)
    if mismatch_share == 1:
        return pairs
    keep = round(mismatch_share * negatives.count())
    return pairs.filter(positive).unionByName(sample_exact(negatives, keep, seed, *keys))
