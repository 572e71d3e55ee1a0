"""Event sequences to attributed transition graphs.

A log has one row per event: ``group_id``, the order columns, ``event`` and, for timed graphs,
``ts_s`` in seconds. Every function works on all groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.functions.scalars import clamped_gap, finite_or
from tracelattice.operators.ordered import Ordered, ordered, plain
from tracelattice.session import cut_lineage, spread_tasks

GROUP = "group_id"


@dataclass(frozen=True)
class Steps:
    """Each log row with its position, next event and gap; ``sequence`` knows about large groups."""

    df: DataFrame
    sequence: Ordered


@dataclass(frozen=True)
class GraphSet:
    """The graphs of all groups: three lazily planned tables over one table of transitions."""

    transitions: DataFrame  # group_id, src_event, dst_event, has_next, n, mean_dt, var_dt, first_pos, last_pos
    nodes: DataFrame  # group_id, node_id, event, n, first_pos, last_pos
    edges: DataFrame  # group_id, src, dst, src_event, dst_event, n, mean_dt, var_dt
    graphs: DataFrame  # group_id, n_events, n_nodes, n_edges
    steps: Steps


def project_log(df: DataFrame) -> DataFrame:
    """The working columns of a structured log."""
    return df.select("LineId", "EventId", "GroupId", "EventTemplate")


def steps(
    log: DataFrame,
    order: Sequence[str] = ("seq",),
    event: str = "event",
    ts: str | None = "ts_s",
    carry: Sequence[str] = (),
    hot_rows: int | None = None,
) -> Steps:
    """Position, next event and clamped gap of every row, from one sort per group.

    Rows without a group are left out. ``carry`` names further columns to keep.
    """
    time = F.col(ts).cast("double") if ts else F.lit(None).cast("double")
    rows = log.where(F.col(GROUP).isNotNull()).select(
        GROUP,
        F.coalesce(F.col(event).cast("string"), F.lit("nan")).alias("event"),
        time.alias("ts_s"),
        *dict.fromkeys([*order, *carry]),
    )
    sequence = ordered(rows, [GROUP], order, hot_rows)
    scanned = sequence.scan(
        lead={"next_event": "event", "next_ts": "ts_s"}, position="pos", has_next="has_next"
    )
    df = scanned.withColumn("dt", F.when(F.col("has_next"), clamped_gap(F.col("ts_s"), F.col("next_ts"))))
    return Steps(df, sequence)


def transitions(step: Steps) -> DataFrame:
    """Rows counted per (group, event, next event), with gap statistics and positions.

    A group's last row has no next event and stays as a row with ``has_next`` false, so nodes, edges and
    sizes all follow from this table and the log is read and sorted once.
    """
    return step.df.groupBy(
        GROUP, F.col("event").alias("src_event"), F.col("next_event").alias("dst_event"), "has_next"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dt").alias("mean_dt"),
        F.var_pop("dt").alias("var_dt"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


def transition_edges(trans: DataFrame, singletons: str = "skip") -> DataFrame:
    """Counted, timed edges between events. ``singletons="self_loop"`` gives a one-row group one
    transition to itself with gap 0; ``"skip"`` gives it none."""
    if singletons == "skip":
        return trans.where("has_next").drop("has_next")
    if singletons != "self_loop":
        raise ValueError("singletons must be 'skip' or 'self_loop'")
    looped = trans.where(F.col("has_next") | (F.col("first_pos") == 0))
    return looped.withColumns(
        {
            "dst_event": F.when(F.col("has_next"), F.col("dst_event")).otherwise(F.col("src_event")),
            "mean_dt": F.when(F.col("has_next"), F.col("mean_dt")).otherwise(0.0),
            "var_dt": F.when(F.col("has_next"), F.col("var_dt")).otherwise(0.0),
        }
    ).drop("has_next")


def distinct_events(trans: DataFrame) -> DataFrame:
    """Distinct events per group with count, first and last position."""
    return trans.groupBy(GROUP, F.col("src_event").alias("event")).agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")
    )


def node_ids(events: DataFrame, hot: bool = True, hot_rows: int | None = None) -> DataFrame:
    """0-based node numbers in order of first occurrence. A group has no more nodes than rows, so
    ``hot=False`` skips measuring the groups when the log had no large one."""
    rows = ordered(events, [GROUP], ["first_pos"], hot_rows) if hot else plain(events, [GROUP], ["first_pos"])
    return rows.scan(position="node_id").select(
        GROUP, F.col("node_id").cast("int").alias("node_id"), "event", "n", "first_pos", "last_pos"
    )


def _edges_by_join(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(GROUP, "node_id", "event")
    return edges.join(
        ids.select(GROUP, F.col("node_id").alias("src"), F.col("event").alias("src_event")), [GROUP, "src_event"]
    ).join(
        ids.select(GROUP, F.col("node_id").alias("dst"), F.col("event").alias("dst_event")), [GROUP, "dst_event"]
    )


def _edges_in_group(trans: DataFrame, singletons: str) -> DataFrame:
    """Number both ends of every edge inside the group's partition: no further exchange, no second
    read of the log. Each transition is split into its two ends, ends are ranked by the first
    position of their event, and the two ends are put together again."""
    start = F.struct(F.lit("src").alias("role"), F.col("src_event").alias("event"), F.col("first_pos").alias("at"))
    end = F.struct(F.lit("dst").alias("role"), F.col("dst_event").alias("event"), (F.col("first_pos") + 1).alias("at"))
    ends = trans.select(
        "*", F.explode(F.when(F.col("has_next"), F.array(start, end)).otherwise(F.array(start))).alias("end")
    )
    first_seen = F.min("end.at").over(Window.partitionBy(GROUP, "end.event"))
    ranked = ends.withColumn("seen", first_seen).withColumn(
        "id", (F.dense_rank().over(Window.partitionBy(GROUP).orderBy("seen")) - 1).cast("int")
    )
    joined = ranked.groupBy(GROUP, "src_event", "dst_event", "has_next").agg(
        F.max(F.when(F.col("end.role") == "src", F.col("id"))).alias("src"),
        F.max(F.when(F.col("end.role") == "dst", F.col("id"))).alias("dst"),
        *[F.first(c).alias(c) for c in ("n", "mean_dt", "var_dt", "first_pos")],
    )
    return transition_edges(joined, singletons).withColumn("dst", F.coalesce("dst", "src"))


def graph_stats(trans: DataFrame, singletons: str = "skip") -> DataFrame:
    """Events, nodes and edges per group."""
    is_edge = F.col("has_next")
    if singletons == "self_loop":
        is_edge = is_edge | (F.col("first_pos") == 0)
    per_event = trans.groupBy(GROUP, "src_event").agg(
        F.sum("n").alias("n"), F.sum(is_edge.cast("bigint")).alias("n_edges")
    )
    return per_event.groupBy(GROUP).agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_nodes"), F.sum("n_edges").alias("n_edges")
    )


def build_graphs(
    log: DataFrame,
    order: Sequence[str] = ("seq",),
    event: str = "event",
    ts: str | None = "ts_s",
    singletons: str = "skip",
    min_edges: int = 0,
    hot_rows: int | None = None,
    store: bool = False,
) -> GraphSet:
    """Directed transition graphs of all groups. ``event`` picks the node identity, for instance a
    template or the raw message; graphs with fewer than ``min_edges`` distinct edges are dropped.

    ``store`` writes the transitions to the checkpoint folder: worth it when more than one of the
    tables is used, since the log is then read once.
    """
    return graphs_of(steps(log, order, event, ts, hot_rows=hot_rows), singletons, min_edges, store)


def graphs_of(step: Steps, singletons: str = "skip", min_edges: int = 0, store: bool = False) -> GraphSet:
    """:func:`build_graphs` from steps that other summaries of the same log use too."""
    trans = transitions(step)
    hot = step.sequence.is_hot
    if hot or store:
        trans = cut_lineage(trans)
        if not hot:  # placed by group once for nodes, edges and sizes
            tasks = spread_tasks(trans.sparkSession, trans.count())
            trans = trans.repartition(GROUP) if tasks is None else trans.repartition(tasks, GROUP)
    graphs = graph_stats(trans, singletons)
    if min_edges > 0:
        graphs = min_edges_only(graphs, min_edges)
        trans = only_groups(trans, graphs)
    nodes = node_ids(distinct_events(trans), hot, step.sequence.hot_rows)
    if hot:
        edges = _edges_by_join(transition_edges(trans, singletons), nodes)
    else:
        edges = _edges_in_group(trans, singletons)
    edges = edges.select(GROUP, "src", "dst", "src_event", "dst_event", "n", "mean_dt", "var_dt")
    return GraphSet(trans, nodes, edges, graphs, step)


def min_edges_only(graphs: DataFrame, k: int = 2) -> DataFrame:
    return graphs.where(F.col("n_edges") >= k)


def only_groups(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose group is listed in ``ids``."""
    return df.join(ids.select(GROUP), GROUP, "left_semi")


def log_scaled_edges(edges: DataFrame) -> DataFrame:
    """``log1p`` of count, mean gap and gap variance."""
    return edges.select(
        *[c for c in edges.columns if c not in ("n", "mean_dt", "var_dt")],
        F.log1p("n").alias("log_n"),
        F.log1p("mean_dt").alias("log_mean_dt"),
        F.log1p("var_dt").alias("log_var_dt"),
    )


def collapse_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Parallel edges summed to one weighted edge; an unusable weight counts 1."""
    return edges.groupBy(GROUP, "src", "dst").agg(F.sum(finite_or(F.col(weight), 1.0)).alias("weight"))


def graph_set_summary(graphs: DataFrame) -> DataFrame:
    """Mean and median number of nodes and edges per graph.

    The exact median counts graphs per size first, so the final step sees one row per distinct size.
    """
    sizes = graphs.groupBy("n_nodes", "n_edges").agg(F.count(F.lit(1)).alias("graphs"))
    weight = F.col("graphs")
    return sizes.agg(
        F.sum("graphs").alias("n_graphs"),
        (F.sum(F.col("n_nodes") * weight) / F.sum(weight)).alias("mean_nodes"),
        F.percentile("n_nodes", 0.5, weight).alias("median_nodes"),
        (F.sum(F.col("n_edges") * weight) / F.sum(weight)).alias("mean_edges"),
        F.percentile("n_edges", 0.5, weight).alias("median_edges"),
    )


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges by group, source and target, for ordered exports."""
    return edges.orderBy(GROUP, "src", "dst")


def group_labels(log: DataFrame, label: str = "label") -> DataFrame:
    """A group is anomalous when any of its rows is."""
    return log.groupBy(GROUP).agg(F.max(label).cast("int").alias("label"))


def prefix_offsets(graphs: DataFrame, order: str = GROUP, hot_rows: int | None = None) -> DataFrame:
    """Graph number and node offset of every graph in the order of ``order``."""
    rows = graphs.withColumn("__all", F.lit(0))
    scanned = ordered(rows, ["__all"], [order], hot_rows).scan(
        running={"__upto": F.col("n_nodes").cast("bigint")}, position="graph_no"
    )
    return scanned.withColumn("node_offset", F.col("__upto") - F.col("n_nodes")).drop("__all", "__upto")
