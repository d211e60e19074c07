"""A total order over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.runtime import Shelf


def global_positions(df: DataFrame, order: list[Column], shelf: Shelf, name: str = "ordered", pos: str = "pos") -> DataFrame:
    """``df`` with its 0-based position in the given order (give a total order).

    The table is range-partitioned and sorted once and written; each partition
    numbers its own rows and the (few) partition sizes are added up on the
    driver, so no task sees more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    written = shelf.put(tagged, name)
    part = F.shiftright("__mid", 33)
    sizes = sorted((r[0], r[1]) for r in written.groupBy(part.alias("p")).count().collect())
    at, offsets = 0, []
    for p, c in sizes:
        offsets.append((int(p), at))
        at += c
    if not offsets:
        return written.drop("__mid").withColumn(pos, F.lit(0).cast("long"))
    table = F.create_map(*[F.lit(x).cast("long") for po in offsets for x in po])
    return written.withColumn(pos, table[part.cast("long")] + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("__mid")
