"""Connected components by minimum-label propagation with pointer jumping.

Each round, every node takes the smallest label among itself and its
neighbours; pointer jumping (label of my label) flattens these chains to their
roots in logarithmically many steps; the edges are then rewritten between roots
and the next round runs on that smaller graph.  All tables of a round are
written to the shared folder, so lineage stays short and a lost executor costs
one round.  Hub nodes (a third of all edges) are aggregated map-side and looked
up through ``skew_lookup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from kinweave.runtime import SMALL_ROWS, Shelf, rows_of, skew_lookup

MAX_ROUNDS = 200


def _jump(m: DataFrame, shelf: Shelf, total: int) -> DataFrame:
    """(u, p): p replaced by its root; chains must end.  ``total`` bounds the rows."""
    for _ in range(MAX_ROUNDS):
        up = m.select(F.col("u").alias("pu"), F.col("p").alias("pp"))
        hop = skew_lookup(m.select("u", "p"), "p", up, "pu", total, "left").select("u", F.coalesce("pp", "p").alias("q"), "p")
        if total <= SMALL_ROWS:  # a second hop in the same job
            hop = skew_lookup(hop.select("u", F.col("q").alias("p")), "p", up, "pu", total, "left").select("u", F.coalesce("pp", "p").alias("q"), "p")
        nxt = shelf.put(hop.select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "jump")
        shelf.drop(m)
        m, moved = nxt.select("u", "p"), not nxt.filter("moved").isEmpty()
        m._kinweave_path = nxt._kinweave_path
        if not moved:
            return m
    raise RuntimeError("pointer jumping did not end")


def connected_components(edges: DataFrame, a: str = "left", b: str = "right", nodes: DataFrame | None = None, shelf: Shelf | None = None) -> DataFrame:
    """(id, group_id): every id with the smallest id it is linked to, directly or indirectly.

    Edges with a null side link nothing.  Self pairs, repeated and reversed
    pairs are harmless; a self pair alone gives a group of one.  ``nodes`` (one
    column) adds ids that may have no edge.  No edges and no nodes: empty.
    """
    shelf = shelf or Shelf(edges.sparkSession, "components")
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    clean = shelf.put(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ids = clean.select(F.explode(F.array("a", "b")).alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.toDF("id").filter(F.col("id").isNotNull()))
    ids = ids.distinct()

    maps: list[DataFrame] = []
    bound = 0
    e = clean.filter(F.col("a") != F.col("b"))
    for _ in range(MAX_ROUNDS):
        total = rows_of(e)
        bound = max(bound, 2 * total)
        if not total:
            break
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")
        hook = shelf.put(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hook")
        m = _jump(hook, shelf, 2 * total)  # an edge has two ends
        maps.append(m)
        ra = m.select(F.col("u").alias("ka"), F.col("p").alias("pa"))
        rb = m.select(F.col("u").alias("kb"), F.col("p").alias("pb"))
        moved = skew_lookup(skew_lookup(e, "a", ra, "ka", total), "b", rb, "kb", total)
        moved = moved.filter(F.col("pa") != F.col("pb")).select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        nxt = shelf.put(moved, "edges")
        if e is not clean:
            shelf.drop(e)
        e = nxt
    else:
        raise RuntimeError("label propagation did not end")

    root = None
    for m in reversed(maps):  # the later maps are the smaller ones
        if root is None:
            root = m
        else:
            up = root.select(F.col("u").alias("pu"), F.col("p").alias("pp"))
            root = skew_lookup(m, "p", up, "pu", bound, "left").select("u", F.coalesce("pp", "p").alias("p"))
    if root is None:
        return ids.select("id", F.col("id").alias("group_id"))
    return ids.join(root, ids["id"] == root["u"], "left").select("id", F.coalesce("p", "id").alias("group_id"))


def components_in_one_task(edges: DataFrame, a: str = "left", b: str = "right") -> DataFrame:
    """``connected_components`` of edges that the caller has counted and found few: one job of one task instead of several a round."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # of one type
    kind = both.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [x for x in batches if x.num_rows]
        if not met:
            return
        t = pa.Table.from_batches(met)
        ends = pa.chunked_array(t.column("a").chunks + t.column("b").chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        ids = ends.dictionary.take(order)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        ends = rank[ends.indices.to_numpy()]
        u, v, root = ends[: t.num_rows], ends[t.num_rows :], np.arange(len(ids))
        while True:
            u, v = root[u], root[v]
            apart = u != v
            u, v = u[apart], v[apart]
            if not len(u):
                break
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root[root] != root).any():
                root = root[root]
        yield from pa.table({"id": ids, "group_id": ids.take(pa.array(root))}).to_batches(max_chunksize=100_000)

    return both.coalesce(1).mapInArrow(run, StructType([StructField("id", kind), StructField("group_id", kind)]))
