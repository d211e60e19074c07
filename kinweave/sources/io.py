"""Reading tables and writing results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.spec import MatchSpec


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV (with a header) by the path's ending; CSV types are inferred without a schema."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=not schema)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path)
    if kind == "orc":
        return reader.orc(path)
    return reader.parquet(path)


def evaluation_table(spark: SparkSession, test: dict, train: dict) -> DataFrame:
    """Two rows, test then train, of all measures, with the time of the run."""
    names = list(test)
    rows = [("test", *[float(test[n]) for n in names]), ("train", *[float(train[n]) for n in names])]
    df = spark.createDataFrame(rows, ", ".join(["data string", *[f"`{n}` double" for n in names]]))
    return df.withColumn("timestamp", F.current_timestamp())


def export_statistics(spark: SparkSession, target: str, model_name: str, spec, evaluation_train: dict | None = None, evaluation_test: dict | None = None) -> str:
    """Writes the similarity map, and performance.csv if both evaluations are given, below target/model_name."""
    base = f"{target}/{model_name}"
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/similarity_map.json", "w") as f:
        json.dump(MatchSpec.of(spec).to_dict(), f, indent=1)
    if evaluation_train and evaluation_test:
        evaluation_table(spark, evaluation_test, evaluation_train).coalesce(1).write.mode("overwrite").csv(f"{base}/performance.csv", header=True)
    return base


def load_spec(path: str) -> MatchSpec:
    with open(path) as f:
        return MatchSpec.of(json.load(f))


def write_epochs(spark: SparkSession, epochs: list[dict], path: str) -> None:
    """The measures of every epoch, numbered from 1."""
    names = list(epochs[0]) if epochs else []
    rows = [(k, *[float(e[n]) for n in names]) for k, e in enumerate(epochs, 1)]
    spark.createDataFrame(rows, ", ".join(["epoch int", *[f"`{n}` double" for n in names]])).coalesce(1).write.mode("overwrite").csv(path, header=True)
