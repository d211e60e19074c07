"""Session helpers: the shared work folder, written tables, and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Below this many rows even one key holding all of them is an ordinary task.
SMALL_ROWS = 2_000_000
#: A lookup table of at most this many (narrow) rows, counted before, is broadcast.
BROADCAST_ROWS = 100_000
#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1_000


def active_session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a local one on one machine (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="kinweave-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Shelf:
    """Written intermediate tables of one operator call.

    ``put`` writes a DataFrame as Parquet into the shared folder and reads it
    back: lineage ends there, every executor can read it again after a loss,
    and later readers prune columns.  ``drop`` removes what an iteration no
    longer needs; the rest goes when the application ends, because results are
    lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/kinweave/{label}-{uuid.uuid4().hex[:12]}"
        path = self._path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self._n = 0

    def _path(self, s: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s)

    def put(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        self._n += 1
        where = f"{self.root}/{self._n:03d}-{name}"
        w = df.write
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._kinweave_path = where
        return out

    def drop(self, df: DataFrame | None) -> None:
        where = getattr(df, "_kinweave_path", None)
        if where:
            self.fs.delete(self._path(where), True)


def rows_of(df: DataFrame) -> int:
    """Row count; of a written table this reads file footers only."""
    return df.count()


def skew_lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, total: int, how: str = "inner", table_rows: int | None = None) -> DataFrame:
    """Join ``rows`` with ``table`` (unique on ``table_key``) where one key may hold a third of the rows.

    Keys with more than total/HOT_SHARE rows (fewer than HOT_SHARE of them, so
    a bounded list) are looked up through a broadcast and never shuffled; the
    others meet in an ordinary shuffled join.  ``table_rows`` is the counted size
    of ``table`` where the caller knows it; a small table is broadcast whole.
    """
    t = table if table_key == key else table.withColumnRenamed(table_key, "__tk")
    tk = key if table_key == key else "__tk"
    if table_rows is not None and table_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(t), rows[key] == t[tk], how).drop(t[tk])
    if total <= SMALL_ROWS:
        joined = rows.join(t, rows[key] == t[tk], how)
        return joined.drop(t[tk])
    hot = rows.groupBy(key).count().filter(F.col("count") > total / HOT_SHARE).select(F.col(key).alias("__hot"))
    hot_table = t.join(F.broadcast(hot), t[tk] == F.col("__hot"), "left_semi")
    tagged = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    a = tagged.filter(F.col("__hot").isNotNull()).drop("__hot")
    b = tagged.filter(F.col("__hot").isNull()).drop("__hot")
    left = a.join(F.broadcast(hot_table), a[key] == hot_table[tk], how).drop(hot_table[tk])
    right = b.join(t, b[key] == t[tk], how).drop(t[tk])
    return left.unionByName(right)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import shutil
    from pathlib import Path

    here = Path(__file__).resolve().parent
    base = tempfile.mkdtemp(prefix="kinweave-ship-")
    shutil.copytree(here, f"{base}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{base}/{here.name}", "zip", f"{base}/src"))
    _shipped.add(sc.applicationId)
