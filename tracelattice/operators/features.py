"""Node features: severity, component, position and parameter statistics, and their scaling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.functions import scalars
from tracelattice.operators.graphs import GROUP, Steps

SEVERITY_SLOTS = len(scalars.SEVERITIES)
EPSILON = 2.0**-52


# Accepted names of a row's fields in order of preference, whatever their case.
ROW_FIELDS = {
    "message": ("content", "message"),
    "level": ("level", "severity", "loglevel", "log_level"),
    "component": ("component", "module", "subsystem", "service"),
    "subsystem": ("subsystem",),
    "params": ("parameterlist", "parameter_list", "parameters", "params"),
}


def row_field(log: DataFrame, name: str) -> Column:
    """The first field among the accepted names of ``name`` that is neither null nor blank, as text."""
    have = {c.lower(): c for c in log.columns}
    given = [F.col(have[n]).cast("string") for n in ROW_FIELDS[name] if n in have]
    return scalars.first_nonblank(*given) if given else F.lit(None).cast("string")


def given_params(log: DataFrame) -> Column | None:
    """The first list or map of parameters that is not null, as texts. A plain text is no list of parameters: the message counts."""
    have, types, lists = {c.lower(): c for c in log.columns}, dict(log.dtypes), []
    for column in (have[n] for n in ROW_FIELDS["params"] if n in have):
        if types[column].startswith(("map<", "array<")):
            values = F.map_values(column) if types[column].startswith("map<") else F.col(column)
            lists.append(values.cast("array<string>"))
    return F.coalesce(*lists) if lists else None


def parsed_fields(log: DataFrame) -> DataFrame:
    """Add ``severity``, ``component`` and ``params`` from message, level, component, subsystem and parameters, each under any of
    its accepted names (``ROW_FIELDS``), row by row the first that is given. Missing columns count as null."""
    message = F.coalesce(row_field(log, "message"), F.col("event").cast("string"))
    return log.withColumns(
        {
            "severity": scalars.severity(row_field(log, "level"), message),
            "component": scalars.component(row_field(log, "component"), row_field(log, "subsystem"), message),
            "params": scalars.numeric_params(given_params(log), message),
        }
    )


def node_positions(step: Steps) -> DataFrame:
    """Share of the group's rows, first and last relative position of every event."""
    rows = step.df.groupBy(GROUP, "event").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    # Counted from the rows, not from the positions, so that this side needs no sort.
    total = step.df.groupBy(GROUP).agg(F.count(F.lit(1)).alias("total"))
    return rows.join(total, GROUP).select(
        GROUP,
        "event",
        (F.col("n") / F.col("total")).alias("frequency"),
        (F.col("first_pos") / F.col("total")).alias("first_rel"),
        (F.col("last_pos") / F.col("total")).alias("last_rel"),
    )


def node_modes(rows: DataFrame) -> DataFrame:
    """Most frequent severity and component per event; ties go to the smaller string.

    Values are counted before the choice, so no task holds a group's values.
    """
    counts = rows.groupBy(GROUP, "event", "severity", "component").agg(F.count(F.lit(1)).alias("n"))
    per_component = counts.groupBy(GROUP, "event", "component").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in scalars.SEVERITIES],
    )
    # The seven severity counts become one small array; its smallest (-count, name) is the mode.
    severities = F.array(*[F.struct((-F.sum(f"n_{s}")).alias("n"), F.lit(s).alias("name")) for s in scalars.SEVERITIES])
    return per_component.groupBy(GROUP, "event").agg(
        F.array_min(severities)["name"].alias("severity"),
        F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"),
    )


def param_stats(rows: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of an event's numbers; zeros without numbers."""
    values = rows.select(GROUP, "event", F.explode_outer("params").alias("v"))
    stats = {"mean": F.avg("v"), "std": F.stddev_pop("v"), "min": F.min("v"), "max": F.max("v")}
    return values.groupBy(GROUP, "event").agg(
        *[F.coalesce(value, F.lit(0.0)).alias(f"param_{name}") for name, value in stats.items()]
    )


def node_cells(step: Steps) -> DataFrame:
    """Rows of a log folded to one row per group, event and component: rows ``n``, rows of each severity, first and last position,
    and the moments of the parameters (count, mean, squared deviations, smallest, largest), which can be merged further."""
    values = step.df.select(GROUP, "event", "severity", "component", "pos", F.posexplode_outer("params").alias("k", "v"))
    row = F.coalesce(F.col("k"), F.lit(0)) == 0  # a row counts at its first parameter
    return values.groupBy(GROUP, "event", "component").agg(
        F.count_if(row).alias("n"),
        *[F.count_if(row & (F.col("severity") == s)).alias(f"n_{s}") for s in scalars.SEVERITIES],
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count("v").alias("count"),
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("squares"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    )


def node_statistics(step: Steps, bins: int = scalars.COMPONENT_BINS) -> DataFrame:
    """``stats`` per node: 7 severity slots, ``bins`` component slots, three positions and four
    signed-log parameter statistics. ``step`` carries severity, component and params.

    Cells of group, event and component are merged to nodes where they lie: the log is read and moved by its group once. Ties of
    severities and components go to the smaller string.
    """
    node, group = Window.partitionBy(GROUP, "event"), Window.partitionBy(GROUP)
    weight = F.col("count")
    cells = node_cells(step).withColumn("m", F.sum(F.col("mean") * weight).over(node) / F.greatest(F.sum(weight).over(node), F.lit(1)))
    severities = F.array(*[F.struct((-F.sum(f"n_{s}")).alias("n"), F.lit(s).alias("name")) for s in scalars.SEVERITIES])
    away = F.col("mean") - F.col("m")
    nodes = cells.groupBy(GROUP, "event").agg(
        F.sum("n").alias("n"),
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        F.array_min(severities)["name"].alias("severity"),
        F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"),
        F.max("m").alias("param_mean"),
        F.sqrt(F.sum(F.col("squares") + weight * away * away) / F.greatest(F.sum(weight), F.lit(1))).alias("param_std"),
        F.coalesce(F.min("low"), F.lit(0.0)).alias("param_min"),
        F.coalesce(F.max("high"), F.lit(0.0)).alias("param_max"),
    )
    total = F.sum("n").over(group)
    params = [scalars.signed_log(F.col(f"param_{name}")) for name in ("mean", "std", "min", "max")]
    return nodes.withColumn("total", total).select(
        GROUP,
        "event",
        F.concat(
            scalars.severity_onehot(F.col("severity")),
            scalars.component_onehot(F.col("component"), bins),
            F.array(*[F.col(c) / F.col("total") for c in ("n", "first_pos", "last_pos")]),
            F.array(*params),
        ).alias("stats"),
    )


def with_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes with their event's vector ``vec``; the job fails on an event without one."""
    missing = F.raise_error(F.concat(F.lit("no vector for event "), F.col("event"))).cast("array<double>")
    return nodes.join(vectors.select("event", "vec"), "event", "left").withColumn("vec", F.coalesce("vec", missing))


def standardised(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of graphs laid side by side (``starts``: the first row of each), every dimension standardised within its graph."""
    n = np.diff(starts)[:, None].astype(float)
    mean = np.add.reduceat(x, starts[:-1], axis=0) / n
    away = x - np.repeat(mean, np.diff(starts), axis=0)
    variance = np.add.reduceat(away * away, starts[:-1], axis=0) / n
    noise = n * EPSILON * variance + (n * mean * EPSILON) ** 2
    spread = np.where(variance <= noise, np.inf, np.sqrt(variance))
    out = away / np.repeat(spread, np.diff(starts), axis=0)
    alone = np.repeat(n[:, 0] == 1, np.diff(starts))
    out[alone] = x[alone]
    return out


def standardise_within(nodes: DataFrame, vector: str = "x", any_size: bool = False) -> DataFrame:
    """Each dimension standardised over the nodes of its graph. A graph of one node is left alone, a
    dimension whose spread is only rounding becomes zero.

    The nodes of a graph are put side by side in a row and worked on many graphs at a time, without another exchange if they are
    placed by their group. ``any_size`` takes windows instead, slower, where a graph may be too large for a task's memory.
    """
    if any_size:
        return _standardise_by_window(nodes, vector)
    names = [c for c in nodes.columns if c != GROUP]
    packs, order = nodes.groupBy(GROUP).agg(F.collect_list(F.struct(*names)).alias("rows")), nodes.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("rows")
            starts = lists.offsets.to_numpy().astype(np.int64)
            starts, inside = starts - starts[0], lists.flatten()
            x = inside.field(vector)
            width = len(x.flatten()) // len(x)
            scaled = standardised(x.flatten().to_numpy().reshape(len(x), width), starts)
            cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            columns = {GROUP: batch.column(GROUP).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(starts))))}
            columns.update({c: inside.field(c) for c in names})
            columns[vector] = pa.ListArray.from_arrays(cuts, pa.array(scaled.ravel()))
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    return packs.mapInArrow(run, nodes.schema)


def _standardise_by_window(nodes: DataFrame, vector: str) -> DataFrame:
    graph = Window.partitionBy(GROUP)
    moments = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col(vector))).over(graph)
    n = F.col("__n")

    def z(x: Column, moments: Column) -> Column:
        mean = moments["__mean"]
        variance = moments["__var"] * (n - 1) / n
        noise = n * EPSILON * variance + F.pow(n * mean * EPSILON, F.lit(2.0))
        return F.when(variance <= noise, 0.0).otherwise((x - mean) / F.sqrt(variance))

    rows = nodes.withColumns({"__n": F.count(F.lit(1)).over(graph), "__m": moments})
    rows = rows.withColumns({"__mean": vector_to_array("__m.mean"), "__var": vector_to_array("__m.variance")})
    scaled = F.zip_with(F.col(vector), F.arrays_zip("__mean", "__var"), z)
    return rows.withColumn(vector, F.when(n > 1, scaled).otherwise(F.col(vector))).drop("__n", "__m", "__mean", "__var")


def node_features(
    step: Steps, vectors: DataFrame, standardise: bool = True, bins: int = scalars.COMPONENT_BINS
) -> DataFrame:
    """Event vector and node statistics side by side, standardised per graph."""
    rows = with_vectors(node_statistics(step, bins), vectors).select(
        GROUP, "event", scalars.concat_features(F.col("vec"), F.col("stats")).alias("x")
    )
    return standardise_within(rows, any_size=step.sequence.is_hot) if standardise else rows


def encode_distinct(events: DataFrame, encoder: Callable[[Column], Column], column: str = "event") -> DataFrame:
    """Vectors of the distinct events. ``encoder`` maps a text column to an array column, usually a
    ``pandas_udf``; each text is encoded once however often it occurs."""
    return events.select(F.col(column).alias("event")).distinct().select("event", encoder(F.col("event")).alias("vec"))
