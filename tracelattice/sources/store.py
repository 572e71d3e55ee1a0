"""Stored graphs, splits, scores, curves, results and models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.operators.graphs import GROUP, GraphSet
from tracelattice.operators.splits import SPLITS, split_audit
from tracelattice.sources.logs import CSV

GRAPH_TABLES = ("nodes", "edges", "graphs")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_graphs(graphs: GraphSet, path: str, extra: dict[str, DataFrame] | None = None) -> None:
    """Nodes, edges and sizes of all graphs, and ``extra`` tables such as the normalised adjacency."""
    tables = {name: getattr(graphs, name) for name in GRAPH_TABLES}
    for name, df in {**tables, **(extra or {})}.items():
        write_table(df, f"{path}/{name}")


def read_graphs(spark: SparkSession, path: str, *extra: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*GRAPH_TABLES, *extra)}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quotes are doubled, as the readers of this package expect; line breaks stay inside quotes."""
    df.write.mode(mode).options(**CSV).csv(path)


def write_splits(splits: DataFrame, folder: str) -> None:
    """Manifest, one id list per split and the audit table."""
    named = splits.select(F.col(GROUP).alias("node"), "split", F.col("label").alias("graph_label"))
    write_csv(named, f"{folder}/manifest")
    for split in SPLITS:
        write_csv(named.where(F.col("split") == split).select("node", "graph_label"), f"{folder}/{split}_graph_ids")
    write_csv(split_audit(splits), f"{folder}/audit")


def write_predictions(scores: DataFrame, path: str) -> None:
    """graph_id, label, anomaly_score; label is null where it is unknown."""
    label = F.col("label") if "label" in scores.columns else F.lit(None).cast("int").alias("label")
    write_csv(scores.select(F.col(GROUP).alias("graph_id"), label, F.col("score").alias("anomaly_score")), path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("graph_id string, label int, anomaly_score double").option("header", True).csv(path)
    return df.select(F.col("graph_id").alias(GROUP), "label", F.col("anomaly_score").alias("score"))


# Column names of stored curves.
CURVE_COLUMNS = {
    "roc": (("fpr", "false_positive_rate"), ("tpr", "true_positive_rate")),
    "pr": (("recall", "recall"), ("precision", "precision")),
}


def write_curves(roc: DataFrame, pr: DataFrame, folder: str) -> None:
    """Curve points with their order."""
    for name, df in (("roc", roc), ("pr", pr)):
        write_csv(df.select("step", *[F.col(a).alias(b) for a, b in CURVE_COLUMNS[name]]), f"{folder}/{name}_curve")


def read_curve(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns = CURVE_COLUMNS[name]
    schema = "step bigint, " + ", ".join(f"{b} double" for _, b in columns)
    df = spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}_curve")
    return df.select("step", *[F.col(b).alias(a) for a, b in columns])


def write_results(results: DataFrame, path: str, append: bool = False) -> None:
    write_csv(results, path, "append" if append else "overwrite")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "config string, seed int, val_roc double, val_prc double, test_roc double, test_prc double"
    return spark.read.schema(schema).option("header", True).csv(path)


@dataclass
class Model:
    """Weights, centre and settings of a one-class model; its size depends on widths alone."""

    weights: dict[str, np.ndarray]
    centre: list[float]
    layers: int = 2
    alpha: float = 0.0
    meta: dict = field(default_factory=dict)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """One row per weight array, and one row for centre and settings."""
    rows = [(n, list(w.shape), [float(v) for v in w.ravel()], None) for n, w in model.weights.items()]
    settings = json.dumps({"layers": model.layers, "alpha": model.alpha, "meta": model.meta})
    rows.append(("__centre", [len(model.centre)], [float(v) for v in model.centre], settings))
    schema = "name string, shape array<int>, entries array<double>, settings string"
    write_table(spark.createDataFrame(rows, schema).coalesce(1), path)


def load_model(spark: SparkSession, path: str) -> Model:
    rows = {row["name"]: row for row in spark.read.parquet(path).collect()}
    last = rows.pop("__centre")
    settings = json.loads(last["settings"])
    weights = {n: np.array(r["entries"]).reshape(r["shape"]) for n, r in rows.items()}
    return Model(weights, list(last["entries"]), settings["layers"], settings["alpha"], settings["meta"])
