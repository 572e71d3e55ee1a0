"""Root events and causal chains of anomalous groups, for all groups at once.

``nodes``: group_id, node, importance and optionally ts. ``edges``: group_id, src, dst, weight.
An edge's confidence is a weighted sum of how frequent it is, whether its times are in order, and how important
its target is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.functions.scalars import finite_or
from tracelattice.operators.graphs import GROUP
from tracelattice.session import cut_lineage

# Weights of the confidence and the score of a reversed time order.
FREQUENCY_WEIGHT, PRECEDENCE_WEIGHT, IMPORTANCE_WEIGHT = 0.55, 0.25, 0.20
REVERSED_ORDER = 0.05


class RootCauses(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    chains: DataFrame


def max_normalised(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` (negative or unusable: 0) divided by its maximum in the group; 0 when that is 0.

    The maximum is aggregated and joined back, so a large group stays spread over tasks.
    """
    clean = F.greatest(F.lit(0.0), finite_or(F.col(value), 0.0))
    top = df.groupBy(GROUP).agg(F.max(clean).alias("__top"))
    scaled = F.when(F.col("__top") > 0, clean / F.col("__top")).otherwise(0.0)
    return df.join(top, GROUP).withColumn(out, scaled).drop("__top")


def coerce_importance(nodes: DataFrame) -> DataFrame:
    return max_normalised(nodes, "importance", "importance")


def top_k(nodes: DataFrame, k: int) -> DataFrame:
    """The k most important nodes per group; ties go to the smaller name."""
    rank = F.row_number().over(Window.partitionBy(GROUP).orderBy(F.desc("importance"), "node"))
    return nodes.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def influential_subgraph(nodes: DataFrame, edges: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The top-k nodes of every group and the edges among them."""
    if k < 1:
        raise ValueError("k counts nodes and starts at 1")
    kept = top_k(coerce_importance(nodes), k)
    ids = kept.select(GROUP, "node")
    among = edges.join(ids.withColumnRenamed("node", "src"), [GROUP, "src"], "left_semi").join(
        ids.withColumnRenamed("node", "dst"), [GROUP, "dst"], "left_semi"
    )
    return kept, among


def precedence(ts_src: Column, ts_dst: Column) -> Column:
    """1 when the order is right or unknown, else 0.05."""
    src, dst = ts_src.try_cast("double"), ts_dst.try_cast("double")
    return F.when(src.isNull() | dst.isNull() | (src <= dst), 1.0).otherwise(REVERSED_ORDER)


def causal_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Confidence of every edge of the sub-graph."""
    importance = max_normalised(nodes, "importance", "importance")
    timed = "ts" in nodes.columns
    target = importance.select(
        GROUP, F.col("node").alias("dst"), "importance", *([F.col("ts").cast("string").alias("ts_dst")] if timed else [])
    )
    weighted = edges.withColumn("frequency", F.greatest(F.lit(0.0), finite_or(F.col("weight"), 1.0)))
    joined = max_normalised(weighted, "frequency", "frequency_share").join(target, [GROUP, "dst"])
    order = F.lit(1.0)
    if timed:
        source = nodes.select(GROUP, F.col("node").alias("src"), F.col("ts").cast("string").alias("ts_src"))
        joined = joined.join(source, [GROUP, "src"])
        order = precedence(F.col("ts_src"), F.col("ts_dst"))
    raw = (
        FREQUENCY_WEIGHT * F.col("frequency_share") + PRECEDENCE_WEIGHT * order + IMPORTANCE_WEIGHT * F.col("importance")
    )
    confidence = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return joined.select(
        GROUP, "src", "dst", confidence.alias("confidence"), "frequency", F.col("importance").alias("target_importance")
    )


def rank_edges(cedges: DataFrame) -> DataFrame:
    """Edges ranked inside their group by descending confidence. Groups are bounded by top_k."""
    rank = F.row_number().over(Window.partitionBy(GROUP).orderBy(F.desc("confidence"), "src", "dst"))
    return cedges.withColumn("rank", rank)


def extend_paths(paths: DataFrame, hops: DataFrame) -> DataFrame:
    """Every path one hop longer, never through a node twice."""
    longer = paths.join(hops, [GROUP, "tail"])
    return longer.where(~F.array_contains("path", F.col("dst"))).select(
        GROUP,
        "root",
        F.concat("path", F.array("dst")).alias("path"),
        F.col("dst").alias("tail"),
        (F.col("confidence") * F.col("hop_confidence")).alias("confidence"),
        F.col("hop_importance").alias("target_importance"),
    )


def simple_paths(cedges: DataFrame, max_hops: int = 4) -> DataFrame:
    """All simple paths of at most ``max_hops`` edges with the product of their confidences and the
    importance of their last node. One join per hop."""
    if max_hops < 1:
        raise ValueError("a path has one hop or more")
    paths = cedges.where("src <> dst").select(
        GROUP,
        F.col("src").alias("root"),
        F.array("src", "dst").alias("path"),
        F.col("dst").alias("tail"),
        "confidence",
        "target_importance",
    )
    hops = cedges.select(
        GROUP,
        F.col("src").alias("tail"),
        "dst",
        F.col("confidence").alias("hop_confidence"),
        F.col("target_importance").alias("hop_importance"),
    )
    found = paths
    for _ in range(max_hops - 1):
        paths = extend_paths(paths, hops)
        found = found.unionByName(paths)
    return found


def root_ranking(nodes: DataFrame, cedges: DataFrame, paths: DataFrame) -> DataFrame:
    """Root score of every node: own importance plus what its paths reach, divided by 1 + in-degree,
    scaled to a maximum of 1."""
    own = max_normalised(nodes, "importance", "importance")
    reach = F.sum(F.col("confidence") * F.col("target_importance"))
    reached = paths.groupBy(GROUP, F.col("root").alias("node")).agg(reach.alias("reach"))
    indegree = cedges.groupBy(GROUP, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))
    raw = (F.col("importance") + F.coalesce("reach", F.lit(0.0))) / (1 + F.coalesce("indegree", F.lit(0)))
    scored = (
        own.join(reached, [GROUP, "node"], "left")
        .join(indegree, [GROUP, "node"], "left")
        .select(GROUP, "node", raw.alias("raw_score"))
    )
    # Rounded, so that ties do not hang on the order of additions.
    rank = F.row_number().over(Window.partitionBy(GROUP).orderBy(F.round("score", 9).desc(), "node"))
    return max_normalised(scored, "raw_score", "score").select(GROUP, "node", "score").withColumn("rank", rank)


def causal_chains(roots: DataFrame, paths: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` strongest chains per group: root score times what the path reaches."""
    scores = roots.select(GROUP, F.col("node").alias("root"), "score")
    strength = F.col("score") * F.col("confidence") * F.col("target_importance")
    chains = (
        paths.join(scores, [GROUP, "root"])
        .select(GROUP, "path", strength.alias("confidence"))
        .where("confidence > 0")
    )
    order = Window.partitionBy(GROUP).orderBy(F.round("confidence", 9).desc(), F.array_join(F.col("path").cast("array<string>"), ">"))
    return chains.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def root_causes(
    nodes: DataFrame, edges: DataFrame, top_k: int = 10, max_hops: int = 4, chain_limit: int = 5
) -> RootCauses:
    """Sub-graph, edge confidences, ranked roots and best chains of every group.

    The sub-graphs and their paths are small against the log they come from and are used several times, so they are
    written to the checkpoint folder once. Paths grow by a join per hop, so that a group spreads over tasks.
    """
    kept, among = influential_subgraph(nodes, edges, top_k)
    kept = cut_lineage(kept)
    cedges = cut_lineage(causal_edges(kept, among))
    paths = cut_lineage(simple_paths(cedges, max_hops))
    roots = root_ranking(kept, cedges, paths)
    return RootCauses(kept, rank_edges(cedges), roots, causal_chains(roots, paths, chain_limit))
