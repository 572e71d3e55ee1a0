"""Structured logs, labels, vectors and split lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.functions.scalars import event_or_message, event_time, label_to_int, time_or_index
from tracelattice.operators.checks import require_columns, resolve_columns
from tracelattice.operators.ordered import ordered
from tracelattice.presets import PRESETS, Preset

CSV = {"header": True, "quote": '"', "escape": '"'}

# Accepted column names of free-schema logs, in order of preference.
FREE_COLUMNS = {
    "group_id": ("node", "groupid", "group_id"),
    "label": ("binary_label", "label", "anomaly_label"),
    "template": ("event_template", "eventtemplate", "event_template_text", "event_id"),
    "message": ("message", "content", "raw_message"),
    "level": ("level", "severity", "log_level"),
    "component": ("component", "module", "subsystem"),
    "subsystem": ("subsystem", "module"),
    "timestamp": ("timestamp", "absolute_timestamp_epoch", "datetime"),
}
FREE_OPTIONAL = ("message", "level", "component", "subsystem", "timestamp")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = True) -> DataFrame:
    """A CSV with header, every column as text, so that no extra pass infers types and keys keep their
    spelling. Fields may hold quoted line breaks, so each file is read in one task;
    ``multiline=False`` splits large files where no field holds a line break."""
    df = spark.read.options(**CSV, multiLine=multiline, inferSchema=False).csv(path)
    return require_columns(df, columns).select(*columns) if columns else df


def read_log(
    spark: SparkSession,
    path: str,
    preset: str | Preset,
    columns: Sequence[str] = (),
    timed: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """Structured log of a preset as group_id, seq, event_id, event, ts_s and the extra ``columns``.
    ``seq`` is the line number and gives the order inside a group."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    df = read_csv(spark, path, multiline=multiline)
    require_columns(df, ["LineId", "EventTemplate", preset.key_column, *columns])
    time = [event_time(df.columns).alias("ts_s")] if timed else []
    event_id = [F.col("EventId").alias("event_id")] if "EventId" in df.columns else []
    return df.select(
        preset.key().alias("group_id"),
        F.col("LineId").cast("bigint").alias("seq"),
        *event_id,
        F.col("EventTemplate").alias("event"),
        *time,
        *columns,
    )


def read_free_log(spark: SparkSession, path: str, order: str, multiline: bool = True) -> DataFrame:
    """A log with free column names as group_id, seq, event, label, message, level, component, subsystem,
    ts_s. ``order`` names the column that holds the line number."""
    df = read_csv(spark, path, multiline=multiline)
    named = resolve_columns(
        df.withColumn("__order", F.col(order).cast("bigint")), {**FREE_COLUMNS, "seq": ("__order",)}, FREE_OPTIONAL
    )
    rows = named.where(F.col("group_id").isNotNull())
    rows = ordered(rows, ["group_id"], ["seq"]).scan(position="__pos")
    return rows.select(
        "group_id",
        "seq",
        event_or_message(F.col("template"), F.col("message")).alias("event"),
        "label",
        "message",
        "level",
        "component",
        "subsystem",
        time_or_index(F.col("timestamp"), F.col("__pos")).alias("ts_s"),
    )


def read_raw_log(spark: SparkSession, path: str, order: str, multiline: bool = True) -> DataFrame:
    """A log of node, message and timestamp, with the raw message as event."""
    df = read_csv(spark, path, ["node", "message", "timestamp", order], multiline)
    return df.select(
        F.col("node").alias("group_id"),
        F.col(order).cast("bigint").alias("seq"),
        F.col("message").alias("event"),
        F.col("timestamp").cast("double").alias("ts_s"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Group labels from ``BlockId`` and ``Label``."""
    df = read_csv(spark, path, ["BlockId", "Label"])
    return df.select(F.col("BlockId").alias("group_id"), label_to_int(F.col("Label")).alias("label"))


def read_embeddings(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """Event vectors as event, vec.

    ``object``: one JSON object, template to list or template to ``{"0": v, ...}``. Such a file cannot
    be split and passes through one task as one string (2 GB at most). ``lines``: one ``{"event": ..., "vec": [...]}`` per line,
    for any size.
    """
    if layout == "lines":
        return spark.read.schema("event string, vec array<double>").json(path)
    if layout != "object":
        raise ValueError("layout must be 'object' or 'lines'")
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("event", "body"))
    as_list = F.from_json("body", "array<double>")
    as_map = F.from_json("body", "map<string,double>")
    from_map = F.transform(
        F.sequence(F.lit(0), F.size(as_map) - 1), lambda i: F.element_at(as_map, i.cast("string"))
    )
    return entries.select("event", F.when(F.col("body").startswith("["), as_list).otherwise(from_map).alias("vec"))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split manifest of a folder of split files."""
    return read_manifest(spark, f"{folder}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One manifest file with node, split and graph_label."""
    df = read_csv(spark, path, ["node", "graph_label", "split"])
    return df.select(F.col("node").alias("group_id"), F.col("graph_label").cast("int").alias("label"), "split")


def read_split_ids(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per-split id files (``{split: path}``) as group_id, label, split."""
    parts = [
        read_csv(spark, path, ["node", "graph_label"]).select(
            F.col("node").alias("group_id"), F.col("graph_label").cast("int").alias("label"), F.lit(split).alias("split")
        )
        for split, path in paths.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
