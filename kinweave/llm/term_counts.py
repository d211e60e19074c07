"""Frequency of every distinct term, kept up to date by signed deltas in a folder that outlives the session."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.functions.text import words
from kinweave.runtime import Shelf

_COUNTS = "term string, occurrences long, records long"
_KEPT = 12  #: digits of a manifest's number


class TermCounts:
    """Persistent term counts of a collection of records.

    A folder holds two bucketed tables: the last version of every record (its
    order value, its text, whether it was deleted) and the counts by term.  A
    manifest names, for every bucket, the folder of its newest files.  ``apply``
    takes added, changed and deleted records, compares them with the stored
    records of the same buckets, turns the difference into signed per-term
    changes (+ for terms that came, - for terms that went), aggregates these and
    merges them into the buckets they touch; other buckets are neither read nor
    written.  A record delivered again unchanged changes nothing, and a version
    older than the stored one (by the order column) is ignored whenever it arrives.

    The manifest is written last, under a new number: a batch that fails leaves
    the old state and can be repeated.  ``TermCounts(spark, path)`` opens what an
    earlier session left in ``path``; without a path the folder belongs to this application.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{Shelf(spark, 'terms').root}/store"
        at = self._path(self.path)
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._last() or {"version": 0, "buckets": buckets, "order": None, "named": 0, "records": {}, "counts": {}}
        self.buckets = self.state["buckets"]

    # -- the folder ---------------------------------------------------------------------------------------------

    def _path(self, s: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s)

    def _manifests(self) -> list[str]:
        where = self._path(f"{self.path}/manifest")
        if not self.fs.exists(where):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where) if f.getPath().getName().endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.path}/manifest/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self) -> dict | None:
        names = self._manifests()
        return self._load(names[-1]) if names else None

    def _commit(self, state: dict) -> None:
        name = f"{state['version']:0{_KEPT}d}.json"
        draft = self._path(f"{self.path}/manifest/{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(draft, self._path(f"{self.path}/manifest/{name}")):
            raise RuntimeError(f"another writer has committed version {state['version']} of {self.path}")
        self.state = state
        for old in self._manifests()[:-2]:  # readers of the version before still find their files
            gone, kept = self._load(old), [self._load(n) for n in self._manifests()[-2:]]
            for table in ("records", "counts"):
                used = {(b, v) for k in kept for b, v in k[table].items()}
                for b, v in gone[table].items():
                    if (b, v) not in used:
                        self.fs.delete(self._path(f"{self.path}/{table}/v{v}/bucket={b}"), True)
            self.fs.delete(self._path(f"{self.path}/manifest/{old}"), False)

    def _schema(self, table: str, order: str | None = None) -> str:
        return _COUNTS if table == "counts" else f"id long, at {order or self.state['order'] or 'long'}, gone boolean, text string"

    def _stored(self, table: str, only: set[int] | None = None, order: str | None = None) -> DataFrame:
        """The newest files of a table, of some buckets or of all, a scan for each version that still holds some."""
        by_version: dict[int, list[int]] = {}
        for b, v in self.state[table].items():
            if only is None or int(b) in only:
                by_version.setdefault(v, []).append(int(b))
        schema = self._schema(table, order)
        out = None
        for v, held in sorted(by_version.items()):
            part = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{table}/v{v}").filter(F.col("bucket").isin(sorted(held))).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _write(self, df: DataFrame, table: str, version: int, touched: set[int]) -> dict:
        """New files of the touched buckets; where each bucket's newest files are now."""
        df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/v{version}")
        made = f"{self.path}/{table}/v{version}"
        wrote = {f.getPath().getName().split("=")[1] for f in self.fs.listStatus(self._path(made)) if "=" in f.getPath().getName()}
        kept = {b: v for b, v in self.state[table].items() if int(b) not in touched}
        return kept | {b: version for b in wrote}

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int").alias("bucket")

    # -- changes ------------------------------------------------------------------------------------------------

    def apply(self, batch: DataFrame, id_col: str, text_col: str, order_col: str | None = None, deleted_col: str | None = None) -> None:
        """Take a batch in.

        Null ids are ignored; of several versions of an id, in this batch or an
        earlier one, that with the greatest order column counts (of equal ones a
        deletion, then the greater text; a null order is oldest); without an
        order column a later batch is newer.  A null text holds no term and is no
        named record; an empty text is named.  Other columns are ignored; an
        empty batch changes nothing.
        """
        version = self.state["version"] + 1
        kind = batch.schema[order_col].dataType.simpleString() if order_col else "bigint"
        if self.state["order"] not in (None, kind):
            raise ValueError(f"the stored order column is {self.state['order']}, not {kind}")
        order = F.col(order_col) if order_col else F.lit(version).cast("long")
        gone = F.coalesce(F.col(deleted_col), F.lit(False)) if deleted_col else F.lit(False)
        text = F.when(~gone, F.col(text_col).cast("string"))
        shelf = Shelf(self.spark, "terms-batch")
        rows = batch.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(order.alias("at"), gone.alias("gone"), text.alias("text")).alias("m"))
        new = shelf.put(rows.groupBy("id").agg(F.max("m").alias("m")).withColumn("bucket", self._bucket("id")), "batch")
        ids_in = {r[0] for r in new.select("bucket").distinct().collect()}  # at most one number a bucket
        if not ids_in:
            return
        old = self._stored("records", ids_in, kind).select("id", F.struct("at", "gone", "text").alias("old"))
        met = new.join(old, "id", "left").filter(F.col("old").isNull() | (F.col("m") > F.col("old")))
        met = shelf.put(met.select("bucket", "id", "m", F.col("old.text").alias("was"), F.col("m.text").alias("now")), "changed")
        ids_in = {r[0] for r in met.select("bucket").distinct().collect()}
        if not ids_in:
            return
        moved = met.filter(~F.col("was").eqNullSafe(F.col("now")))
        side = lambda c, sign: moved.filter(F.col(c).isNotNull()).select(F.explode(words(F.col(c))).alias("term"), "id", F.lit(sign).cast("long").alias("sign"))
        per = side("now", 1).unionByName(side("was", -1)).groupBy("term", "id", "sign").agg(F.sum("sign").alias("n"))
        delta = per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("sign").alias("records"))
        delta = shelf.put(delta.filter((F.col("occurrences") != 0) | (F.col("records") != 0)).withColumn("bucket", self._bucket("term")), "delta")
        named = met.agg(F.coalesce(F.sum(F.col("now").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")), F.lit(0))).first()[0]
        terms_in = {r[0] for r in delta.select("bucket").distinct().collect()}

        state = dict(self.state, version=version, order=kind, named=self.state["named"] + named)
        if terms_in:
            before = self._stored("counts", terms_in).withColumn("bucket", self._bucket("term"))
            merged = before.unionByName(delta).groupBy("bucket", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            state["counts"] = self._write(merged.filter(F.col("records") > 0), "counts", version, terms_in)
        kept = self._stored("records", ids_in, kind).join(met.select("id"), "id", "left_anti").withColumn("bucket", self._bucket("id"))
        state["records"] = self._write(kept.unionByName(met.select("id", "m.at", "m.gone", "m.text", "bucket")), "records", version, ids_in)
        self._commit(state)
        for t in (new, met, delta):
            shelf.drop(t)

    @property
    def counts(self) -> DataFrame:
        """(term, occurrences, records) of the last complete version."""
        return self._stored("counts")

    def marked(self, rare_below: int = 3, common_above: float = 0.04) -> DataFrame:
        """(term, mark, occurrences, records) of the terms too rare or too common to be of use."""
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * F.lit(self.state["named"]), "common")
        return self.counts.withColumn("mark", mark).filter(F.col("mark").isNotNull()).select("term", "mark", "occurrences", "records")


def term_counts(records: DataFrame, id_col: str, text_col: str, order_col: str | None = None, batches: int = 2, path: str | None = None) -> TermCounts:
    """Counts of a whole table, taken in as ``batches`` deliveries by its order column."""
    tc = TermCounts(records.sparkSession, path)
    if batches < 2 or order_col is None:
        tc.apply(records, id_col, text_col, order_col)
        return tc
    timed = dict(records.dtypes)[order_col].startswith(("timestamp", "date"))
    o = (F.col(order_col).cast("timestamp") if timed else F.col(order_col)).cast("double")
    at = records.select(o.alias("o")).agg(F.percentile_approx("o", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(at))
    for k in range(len(cuts) + 1):
        part = records
        if k:
            part = part.filter(o > cuts[k - 1])
        if k < len(cuts):
            part = part.filter((o <= cuts[k]) | o.isNull() if not k else o <= cuts[k])
        tc.apply(part, id_col, text_col, order_col)
    return tc
