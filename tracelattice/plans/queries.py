"""Registered queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelattice.functions import scalars
from tracelattice.functions.vectors import l2_normalise
from tracelattice.operators import (
    adjacency, explain, features, graphs, metrics, packed, propagate, splits, temporal, text,
)
from tracelattice.operators.checks import clean_labels, require_complete, require_unique, with_labels, with_summary
from tracelattice.plans import oneclass, tables, timed
from tracelattice.plans.tables import EVENT_ORDER, LINE_ORDER
from tracelattice.plans.training import Plan, Stage, centred, fit_models
from tracelattice.presets import PRESETS, SEEDS
from tracelattice.sources.store import Model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values of the queries, shared with their SQL.
SEED = 42
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "de", "la", "le", "der", "die", "und")
VOCABULARY = 10_000
TOP_K, MAX_HOPS, CHAIN_LIMIT = 10, 4, 5
DIMS = 64
HIDDEN = 8
STEP_RATE, STEP_DECAY = 5.0, 1e-2
WIDE = PRESETS["hdfs"].hidden


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str, alias: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(alias or column)


def micro(vector: str, alias: str):
    """A vector as text of rounded millionths, so that both engines print the same."""
    return F.array_join(F.transform(vector, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), " ").alias(alias)


def day_graphs(spark, folder, **options) -> graphs.GraphSet:
    options = {"singletons": "self_loop", **options}
    return graphs.build_graphs(tables.event_log(spark, folder), EVENT_ORDER, **options)


def day_steps(spark, folder, carry=()) -> graphs.Steps:
    return graphs.steps(tables.event_log(spark, folder), EVENT_ORDER, carry=carry)


def day_labels(spark, folder) -> DataFrame:
    return graphs.group_labels(tables.event_log(spark, folder))


# Scalers and centres see normal training groups alone.
FITTED = "split = 'train' AND label = 0"


def day_split(spark, folder) -> DataFrame:
    return splits.bernoulli_split(day_labels(spark, folder))


def half(labels: DataFrame) -> int:
    return labels.count() // 2


def edge_columns(edges: DataFrame) -> DataFrame:
    return edges.select(
        "group_id", "src", "dst", "src_event", "dst_event", "n", r6("mean_dt"),
        F.round(F.log1p("var_dt"), 6).alias("log_var_dt"),
    )


# --- graphs ---------------------------------------------------------------------------------------


@query
def transition_edges(spark, folder):
    return edge_columns(day_graphs(spark, folder).edges)


@query
def transition_edges_coarse(spark, folder):
    log = tables.event_log(spark, folder, "user")
    return edge_columns(graphs.build_graphs(log, EVENT_ORDER).edges)


@query
def transition_edges_lines(spark, folder):
    return edge_columns(graphs.build_graphs(tables.line_log(spark, folder), LINE_ORDER, singletons="self_loop").edges)


@query
def transition_counts_turns(spark, folder):
    built = graphs.build_graphs(tables.turn_log(spark, folder), ts=None)
    return built.edges.select("group_id", "src", "dst", "src_event", "dst_event", "n")


@query
def message_graph_edges(spark, folder):
    log = tables.event_log(spark, folder, "user")
    built = graphs.build_graphs(log, EVENT_ORDER, event="message", singletons="self_loop")
    return edge_columns(built.edges)


@query
def working_projection(spark, folder):
    log = tables.event_log(spark, folder)
    ids = log.select(
        F.col("event_id").alias("LineId"), F.col("component").alias("EventId"), F.col("group_id").alias("GroupId"),
        F.col("event").alias("EventTemplate"),
    )
    return graphs.project_log(ids)


@query
def graph_nodes(spark, folder):
    return day_graphs(spark, folder).nodes


@query
def consecutive_gaps(spark, folder):
    df = day_steps(spark, folder, ["event_id"]).df
    return df.select("group_id", "event_id", "pos", "event", "next_event", r6("dt"))


@query
def graph_stats(spark, folder):
    return day_graphs(spark, folder, singletons="skip", min_edges=2).graphs


@query
def graph_set_summary(spark, folder):
    summary = graphs.graph_set_summary(day_graphs(spark, folder).graphs)
    return summary.select("n_graphs", *[r6(c) for c in ("mean_nodes", "median_nodes", "mean_edges", "median_edges")])


@query
def collapsed_edges(spark, folder):
    edges = day_graphs(spark, folder).edges.select(
        "group_id", F.col("src_event").alias("src"), F.col("dst_event").alias("dst"), F.col("n").alias("weight")
    )
    per_user = edges.withColumn("group_id", F.substring_index("group_id", "_", 1))
    return graphs.collapse_edges(per_user).select("group_id", "src", "dst", r6("weight"))


@query
def prefix_offsets(spark, folder):
    sizes = day_graphs(spark, folder).graphs
    return graphs.prefix_offsets(sizes).select("group_id", "graph_no", "node_offset", "n_nodes")


# --- timing ---------------------------------------------------------------------------------------


@query
def gap_summary(spark, folder):
    return temporal.gap_summary(day_steps(spark, folder)).select("group_id", *[r6(c) for c in temporal.GAP_COLUMNS])


@query
def gap_summary_core(spark, folder):
    steps = graphs.steps(tables.event_log(spark, folder, "user"), EVENT_ORDER)
    columns = temporal.GAP_SUBSETS["core"]
    return temporal.gap_summary(steps).select("group_id", *[r6(c) for c in columns])


@query
def edge_summary(spark, folder):
    summary = temporal.edge_summary(day_graphs(spark, folder).edges)
    return summary.select("group_id", *[r6(c) for c in temporal.EDGE_COLUMNS])


@query
def scaled_edges(spark, folder):
    labels = day_labels(spark, folder)
    split = splits.protocol_splits(labels, half(labels), SEED)
    scaled, _ = temporal.scale_edges(graphs.log_scaled_edges(day_graphs(spark, folder).edges), split)
    return scaled.select("group_id", "src", "dst", *[r6(c) for c in ("log_n", "log_mean_dt", "log_var_dt")])


@query
def scaled_gap_summary(spark, folder):
    summary = with_labels(temporal.gap_summary(day_steps(spark, folder)), day_split(spark, folder))
    scaler = temporal.fit_scaler(summary, temporal.GAP_COLUMNS, FITTED)
    return scaler.apply(summary).select("group_id", *[r6(c) for c in temporal.GAP_COLUMNS])


@query
def parsed_times(spark, folder):
    text_time = F.date_format("ts", scalars.TIME_PATTERN)
    events = tables.table(spark, folder, "events").select("event_id", text_time.alias("Time"))
    return events.select("event_id", F.round(scalars.event_time(events.columns), 6).alias("ts_s"))


# --- labels and splits ----------------------------------------------------------------------------


@query
def group_labels(spark, folder):
    log = tables.event_log(spark, folder)
    return graphs.group_labels(clean_labels(log.withColumn("label", F.col("label").cast("string"))))


@query
def named_labels(spark, folder):
    labels = day_labels(spark, folder).select(
        "group_id", F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("Label")
    )
    return labels.select("group_id", scalars.label_to_int(F.col("Label")).alias("label"))


@query
def stratified_sample(spark, folder):
    labels = day_labels(spark, folder)
    return splits.class_sample(labels, half(labels), 0.45, SEED)


@query
def protocol_splits(spark, folder):
    labels = day_labels(spark, folder)
    return splits.protocol_splits(labels, half(labels), SEED)


@query
def protocol_splits_from_log(spark, folder):
    return splits.protocol_splits_from_log(tables.event_log(spark, folder), seed=SEED)


@query
def bernoulli_split(spark, folder):
    return splits.bernoulli_split(day_labels(spark, folder))


@query
def held_out_groups(spark, folder):
    labels = day_labels(spark, folder)
    train = splits.bernoulli_split(labels).where("split = 'train'")
    return splits.complement(labels, train)


@query
def contaminated_splits(spark, folder):
    return splits.contaminate(splits.bernoulli_split(day_labels(spark, folder)), 40, SEED)


@query
def split_audit(spark, folder):
    labels = day_labels(spark, folder)
    audit = splits.split_audit(splits.protocol_splits(labels, half(labels), SEED))
    return audit.select(
        F.coalesce("split", F.lit("total")).alias("split"), "n_graphs", "normal", "anomalous", r6("anomaly_share")
    )


@query
def class_counts(spark, folder):
    return splits.class_counts(splits.bernoulli_split(day_labels(spark, folder)))


@query
def split_leakage(spark, folder):
    labels = day_labels(spark, folder)
    return splits.split_leakage(splits.protocol_splits(labels, half(labels), SEED))


@query
def train_split_graphs(spark, folder):
    split = splits.bernoulli_split(day_labels(spark, folder))
    return splits.take_split(day_graphs(spark, folder).graphs, split, "train")


# --- fields and node features ---------------------------------------------------------------------


def parsed_log(spark, folder) -> DataFrame:
    return features.parsed_fields(tables.event_log(spark, folder))


def parsed_steps(spark, folder) -> graphs.Steps:
    return graphs.steps(parsed_log(spark, folder), EVENT_ORDER, carry=("severity", "component", "params"))


@query
def parsed_fields(spark, folder):
    return parsed_log(spark, folder).select(
        "event_id",
        "severity",
        F.array_join(F.transform(scalars.severity_onehot(F.col("severity")), lambda v: v.cast("int").cast("string")), "").alias("onehot"),
        "component",
        scalars.component_bin(F.col("component")).alias("bin"),
        F.size("params").alias("n_params"),
        F.round(scalars.signed_log(F.col("value") - 10), 6).alias("signed_log"),
    )


@query
def message_severity(spark, folder):
    log = tables.event_log(spark, folder)
    nothing = F.lit(None).cast("string")
    bracketed = F.concat(F.lit("["), F.col("component"), F.lit("] "), F.col("message"))
    return log.select(
        "event_id",
        scalars.severity(nothing, F.col("message")).alias("severity"),
        scalars.component(nothing, nothing, bracketed).alias("bracket_component"),
        scalars.component(F.col("component"), F.col("level"), F.col("message")).alias("pair_component"),
        scalars.event_or_message(F.nullif(F.col("component"), F.lit("view")), F.col("message")).alias("named"),
        scalars.clean_text(F.col("message")).alias("cleaned"),
    )


@query
def param_stats(spark, folder):
    stats = features.param_stats(parsed_log(spark, folder).select("group_id", "event", "params"))
    return stats.select("group_id", "event", *[r6(f"param_{n}") for n in ("mean", "std", "min", "max")])


@query
def node_positions(spark, folder):
    return features.node_positions(day_steps(spark, folder)).select(
        "group_id", "event", *[r6(c) for c in ("frequency", "first_rel", "last_rel")]
    )


@query
def node_modes(spark, folder):
    rows = tables.event_log(spark, folder, "user").select(
        "group_id",
        "event",
        F.when(F.col("value") > 50, "WARN").otherwise(F.when(F.col("value") > 20, "INFO").otherwise("DEBUG")).alias("severity"),
        F.substring("props", 7, 1).alias("component"),
    )
    return features.node_modes(rows)


@query
def node_statistics(spark, folder):
    return features.node_statistics(parsed_steps(spark, folder)).select("group_id", "event", micro("stats", "stats"))


@query
def standardised_nodes(spark, folder):
    stats = features.node_statistics(parsed_steps(spark, folder))
    return features.standardise_within(stats.select("group_id", "event", F.col("stats").alias("x"))).select("group_id", "event", micro("x", "x"))


@query
def node_features(spark, folder):
    built = features.node_features(parsed_steps(spark, folder), tables.event_vectors(spark, folder))
    return built.select("group_id", "event", micro("x", "x"))


@query
def distinct_messages(spark, folder):
    return text.messages(tables.event_log(spark, folder))


@query
def encoded_messages(spark, folder):
    @F.pandas_udf("array<double>")
    def letters(texts: pd.Series) -> pd.Series:
        return pd.Series(np.stack([texts.str.len(), texts.str.count(r"\d")], axis=1).astype(float).tolist(), index=texts.index)

    encoded = features.encode_distinct(tables.event_log(spark, folder), letters, "message")
    return encoded.select("event", F.get("vec", F.lit(0)).alias("n_chars"), F.get("vec", F.lit(1)).alias("n_digits"))


@query
def tfidf_terms(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    return text.tfidf(docs, "doc_id", stop=STOP_WORDS).select("doc_id", "term", r6("weight"))


@query
def tfidf_top_terms(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    return text.tfidf(docs, "doc_id", size=VOCABULARY, stop=STOP_WORDS).select("doc_id", "term", r6("weight"))


@query
def svd_embedding(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    weights = text.tfidf(docs, "doc_id", stop=STOP_WORDS)
    return text.svd_embedding(weights, docs, "doc_id", 8)


@query
def keyed_props(spark, folder):
    """The key in a text by the default pattern and by another one."""
    events = tables.table(spark, folder, "events")
    block = F.concat(F.lit("at blk_-"), F.col("event_id").cast("string"), F.lit(" "), F.col("props"))
    return events.select(
        "event_id", scalars.group_key(block).alias("block"), scalars.group_key(F.col("props"), r"(\d\d+)").alias("key")
    )


@query
def times_or_positions(spark, folder):
    """Times that are no numbers become positions."""
    df = day_steps(spark, folder, ["event_id", "value"]).df
    text_time = F.when(F.col("event") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return df.select("group_id", "event_id", r6_of(scalars.time_or_index(text_time, F.col("pos"))).alias("t"))


def r6_of(column):
    return F.round(column.cast("double"), 6)


@query
def first_fields(spark, folder):
    """First field that is given, blank ones left out; and the readable name of a row."""
    log = tables.event_log(spark, folder)
    blank = F.when(F.col("event") == "view", F.lit(" \t\u00a0")).otherwise(F.nullif(F.col("component"), F.lit("click")))
    return log.select(
        "event_id",
        scalars.first_nonblank(blank, F.lit(""), F.col("message")).alias("field"),
        scalars.node_label(F.nullif(F.col("component"), F.lit("error")), F.col("message")).alias("name"),
    )


@query
def short_vectors(spark, folder):
    vectors = tables.table(spark, folder, "embeddings")
    return vectors.select("vec_id", micro(scalars.take_dims(F.transform("embedding", lambda v: v.cast("double")), 8), "x"))


@query
def normal_test_graphs(spark, folder):
    held = splits.take_split(with_labels(day_graphs(spark, folder).graphs, day_labels(spark, folder)), day_split(spark, folder), "test")
    return splits.train_normal(held)


@query
def all_groups(spark, folder):
    return splits.all_groups(day_labels(spark, folder))


@query
def sorted_edges(spark, folder):
    return edge_columns(graphs.sort_edges(day_graphs(spark, folder).edges))


@query
def checked_graphs(spark, folder):
    """Graphs after the checks that none is listed twice and each has a label."""
    return require_complete(require_unique(day_graphs(spark, folder).graphs), day_labels(spark, folder))


@query
def graphs_with_timing(spark, folder):
    built = day_graphs(spark, folder, store=True)
    joined = with_summary(built.graphs, temporal.gap_summary(built.steps))
    return joined.select("group_id", "n_events", "n_edges", r6("gap_mean"), r6("gap_max"))


@query
def edge_timing(spark, folder):
    """Undirected normalised edges with the standardised timing of the raw ones, zeros where there is none."""
    built = day_graphs(spark, folder, store=True)
    edges = built.edges.select("group_id", "src", "dst", F.col("n").cast("double").alias("w"))
    timing = standardised_timing(built.edges, day_labels(spark, folder))
    found = propagate.with_edge_stats(adjacency.norm_undirected(edges, built.nodes), timing)
    return found.select("group_id", "src", "dst", r6("w"), micro("t", "t"))


# --- adjacency ------------------------------------------------------------------------------------


def weighted_graphs(spark, folder) -> tuple[DataFrame, DataFrame]:
    built = day_graphs(spark, folder, store=True)
    edges = built.edges.select("group_id", "src", "dst", F.col("n").cast("double").alias("w"))
    return edges, built.nodes.select("group_id", "node_id")


def edge_weights(adj: DataFrame) -> DataFrame:
    return adj.select("group_id", "src", "dst", r6("w"))


@query
def adj_undirected(spark, folder):
    return edge_weights(adjacency.norm_undirected(*weighted_graphs(spark, folder)))


@query
def adj_self_loops(spark, folder):
    return edge_weights(adjacency.add_self_loops(*weighted_graphs(spark, folder)))


@query
def transition_matrix(spark, folder):
    return adjacency.transition_matrix(*weighted_graphs(spark, folder)).select("group_id", "src", "dst", r6("p"))


@query
def node_degrees(spark, folder):
    edges, _ = weighted_graphs(spark, folder)
    return adjacency.degree(edges).select("group_id", F.col("src").alias("node_id"), r6("deg"))


@query
def symmetric_edges(spark, folder):
    edges, _ = weighted_graphs(spark, folder)
    return edge_weights(adjacency.symmetrise(edges))


@query
def pagerank(spark, folder):
    p = adjacency.cut_lineage(adjacency.transition_matrix(*weighted_graphs(spark, folder)))
    return adjacency.pagerank(p).select("group_id", F.col("node_id").cast("int").alias("node_id"), r6_of(F.round("pi", 10)).alias("pi"))


@query
def adj_ppr(spark, folder):
    return edge_weights(adjacency.normalise(*weighted_graphs(spark, folder), mode="appr"))


@query
def adj_pr(spark, folder):
    return edge_weights(adjacency.normalise(*weighted_graphs(spark, folder), mode="pr"))


@query
def pr_factors(spark, folder):
    """The full normalisation as sparse rows (with ``dst`` and ``w``) and factors of the nodes (without)."""
    sparse, factors = adjacency.pr_factors(*weighted_graphs(spark, folder))
    none = F.lit(None).cast("double")
    rows = sparse.select("group_id", "src", "dst", r6("w"), *[none.alias(c) for c in "abc"])
    nodes = factors.select("group_id", F.col("node_id").cast("int").alias("src"), F.lit(None).cast("int").alias("dst"), none.alias("w"), *[r6(c) for c in "abc"])
    return rows.unionByName(nodes)


@query
def adj_second_order(spark, folder):
    both = adjacency.normalise(*weighted_graphs(spark, folder), mode="ib")
    return both.select("group_id", "src", "dst", "ord", r6("w"))


# --- message passing and scores -------------------------------------------------------------------


def vector_graphs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and counted edges of the user-day graphs, from stored transitions, and the events' vectors."""
    built = day_graphs(spark, folder, store=True)
    edges = built.edges.withColumn("w", F.col("n").cast("double"))
    return built.graphs, edges, tables.event_vectors(spark, folder)


def node_vectors(spark, folder) -> DataFrame:
    """Node vectors of the user-day graphs."""
    x = features.with_vectors(day_graphs(spark, folder).nodes, tables.event_vectors(spark, folder))
    return x.select("group_id", "node_id", F.col("vec").alias("x"))


def formula_weights(rows: int, cols: int) -> np.ndarray:
    """Weights that SQL can state too: ((7 i + 3 j) mod 11 - 5) / 10."""
    i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return ((7 * i + 3 * j) % 11 - 5) / 10.0


@query
def propagate_once(spark, folder):
    moved = packed.propagate_graphs(*vector_graphs(spark, folder), "un")
    return moved.select("group_id", "node_id", micro("x", "x"))


@query
def mean_pool(spark, folder):
    return propagate.pool(node_vectors(spark, folder), "mean", DIMS).select("group_id", micro("z", "z"))


@query
def sum_pool(spark, folder):
    return propagate.pool(node_vectors(spark, folder), "sum", DIMS).select("group_id", micro("z", "z"))


@query
def max_pool(spark, folder):
    return propagate.pool(node_vectors(spark, folder), "max", DIMS).select("group_id", micro("z", "z"))


@query
def edge_pool(spark, folder):
    edges = graphs.log_scaled_edges(day_graphs(spark, folder).edges)
    return propagate.pool_edges(edges, ("log_mean_dt", "log_var_dt")).select("group_id", micro("t", "t"))


def labelled_means(spark, folder) -> DataFrame:
    """Mean node vector, label and split of every user-day graph, stored."""
    z = propagate.pool(node_vectors(spark, folder), dims=DIMS)
    return adjacency.cut_lineage(with_labels(z, day_split(spark, folder)))


@query
def centre_distance(spark, folder):
    z = labelled_means(spark, folder)
    scored = propagate.distances(z, propagate.centre(z, FITTED))
    return scored.select("group_id", "label", r6("score"), r6("score_sq"))


@query
def most_anomalous(spark, folder):
    z = labelled_means(spark, folder)
    scored = propagate.distances(z, propagate.centre(z, FITTED))
    return metrics.most_anomalous(scored.select("group_id", r6("score")), 10)


@query
def node_importance(spark, folder):
    return propagate.node_importance(node_vectors(spark, folder), DIMS).select("group_id", "node_id", r6("importance"))


@query
def unit_vectors(spark, folder):
    vectors = tables.table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v")
    )
    return vectors.select("vec_id", l2_normalise(F.col("v")).alias("u")).select("vec_id", micro("u", "u"))


@query
def encode_two_layers(spark, folder):
    z = packed.encode_graphs(*vector_graphs(spark, folder), formula_weights(DIMS, WIDE), formula_weights(WIDE, WIDE), "un")
    return z.select("group_id", micro("z", "z"))


@query
def encode_one_layer(spark, folder):
    z = packed.encode_graphs(*vector_graphs(spark, folder), formula_weights(DIMS, WIDE), formula_weights(WIDE, WIDE), "un", layers=1)
    return z.select("group_id", micro("z", "z"))


@query
def encode_inception(spark, folder):
    built = day_graphs(spark, folder, store=True)
    edges = built.edges.select("group_id", "src", "dst", F.col("n").cast("double").alias("w"))
    first = adjacency.cut_lineage(adjacency.norm_ppr(edges, built.nodes))
    second = adjacency.cut_lineage(adjacency.norm_second_order(first, built.nodes))
    x = features.with_vectors(built.nodes, tables.event_vectors(spark, folder))
    widths = [(DIMS, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, HIDDEN)]
    blocks = [{name: formula_weights(*shape) for name in ("W0", "W1", "W2")} for shape in widths]
    out = propagate.encode_inception(first, second, x.select("group_id", "node_id", F.col("vec").alias("x")), blocks)
    return out.select("group_id", "node_id", micro("x", "x"))


def logged_edges(built: graphs.GraphSet) -> DataFrame:
    """Counted edges (w) with the logarithms of their timing."""
    return graphs.log_scaled_edges(built.edges.withColumn("w", F.col("n").cast("double")))


def day_encoder_tables(spark, folder, **options) -> tuple[oneclass.EncoderTables, oneclass.EncoderTables, DataFrame]:
    """Encoder tables of the PageRank-normalised user-day graphs, those of the training groups, and all splits."""
    split = adjacency.cut_lineage(day_split(spark, folder))
    built = day_graphs(spark, folder, store=True)
    data = oneclass.encoder_tables(built.graphs, logged_edges(built), tables.event_vectors(spark, folder), **options)
    return data, data.where(split.where(FITTED)), split


def day_timing(spark, folder, split: DataFrame) -> DataFrame:
    """Timing summary of every user-day graph, standardised on the training groups, as a stored vector."""
    summary = with_labels(temporal.gap_summary(day_steps(spark, folder)), split)
    scaled = temporal.fit_scaler(summary, temporal.GAP_COLUMNS, FITTED).apply(summary)
    return adjacency.cut_lineage(propagate.with_summary_vector(scaled, temporal.GAP_COLUMNS))


PRESET = PRESETS["bgl"]


@query
def one_class_scores(spark, folder):
    data, train, split = day_encoder_tables(spark, folder)
    model = oneclass.new_model(DIMS, PRESET.hidden, SEED)
    (model,), _ = fit_models(oneclass.train_tables(train), oneclass.ONE_CLASS, [model], [Plan([Stage(PRESET.epochs)])])
    return oneclass.score_tables(data, model, split).select("group_id", "label", r6("score"))


@query
def one_class_step(spark, folder):
    """Scores after one step of descent from weights that SQL can state too; the rate is chosen so that the step shows."""
    data, train, split = day_encoder_tables(spark, folder)
    weights = {"W1": formula_weights(DIMS, HIDDEN), "W2": formula_weights(HIDDEN, HIDDEN)}
    (model,), _ = fit_models(oneclass.train_tables(train), oneclass.ONE_CLASS, [Model(weights, [])], [Plan([Stage(1, STEP_RATE)], STEP_DECAY)])
    return oneclass.score_tables(data, model, split).select("group_id", "label", r6("score"))


@query
def warmed_losses(spark, folder):
    """Loss of every epoch when the centre is taken anew after the tenth."""
    _, train, _ = day_encoder_tables(spark, folder)
    model = oneclass.new_model(DIMS, PRESET.hidden, SEED)
    _, (history,) = fit_models(oneclass.train_tables(train), oneclass.ONE_CLASS, [model], [Plan([Stage(20)], warmup=10)])
    return spark.createDataFrame(history, "epoch int, loss double").select("epoch", r6("loss"))


@query
def grid_losses(spark, folder):
    """Losses of models over layers, rates and seeds; all of a layer count are trained in the same passes."""
    split = adjacency.cut_lineage(day_split(spark, folder))
    built = day_graphs(spark, folder, store=True)
    sets = {}
    for layers in (1, 2):
        data = oneclass.encoder_tables(built.graphs, logged_edges(built), tables.event_vectors(spark, folder), layers=layers)
        sets[layers] = oneclass.train_tables(data.where(split.where(FITTED)))
    points = oneclass.grid(layers=[1, 2], lr=[0.01, 0.001], seed=list(SEEDS))
    _, history = oneclass.fit_grid(sets, DIMS, points, 20)
    return spark.createDataFrame(history, "config string, epoch int, loss double").select("config", "epoch", r6("loss"))


@query
def temporal_fusion_scores(spark, folder):
    data, train, split = day_encoder_tables(spark, folder)
    timing = day_timing(spark, folder, split)
    model = oneclass.new_model(DIMS, PRESET.hidden, SEED, timing_width=len(temporal.GAP_COLUMNS))
    (model,), _ = fit_models(oneclass.train_tables(train, timing), oneclass.ONE_CLASS, [model], [Plan(oneclass.staged(PRESET.epochs))])
    return oneclass.score_tables(data, model, split, timing).select("group_id", "label", r6("score"))


def standardised_timing(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Log-scaled timing of every edge as one vector, standardised on the normal training groups."""
    scaled, _ = temporal.scale_edges(graphs.log_scaled_edges(edges), splits.bernoulli_split(labels))
    return scaled.select("group_id", "src", "dst", F.array("log_mean_dt", "log_var_dt").alias("t"))


def timed_edges(spark, folder, split: DataFrame) -> tuple[graphs.GraphSet, DataFrame]:
    """The user-day graphs and their edges with log-scaled timing as one vector, standardised on the training groups."""
    built = day_graphs(spark, folder, store=True)
    scaled, _ = temporal.scale_edges(logged_edges(built), split)
    return built, scaled.withColumn("t", F.array("log_mean_dt", "log_var_dt"))


def formula_timing(width: int) -> dict[str, np.ndarray]:
    return {"U": formula_weights(width, HIDDEN), "gain": np.ones(HIDDEN), "shift": np.zeros(HIDDEN), "V": formula_weights(HIDDEN, HIDDEN)}


@query
def fused_graph_scores(spark, folder):
    """Graph vectors with the residual of each graph's timing, from weights that SQL can state too. Labels and timing go to the
    packed graphs before these are stored, so that the wide rows stay where they are."""
    split = adjacency.cut_lineage(day_split(spark, folder))
    timing = day_timing(spark, folder, split)
    built = day_graphs(spark, folder, store=True)
    vectors = tables.event_vectors(spark, folder)
    data = oneclass.encoder_tables(built.graphs, logged_edges(built), vectors, inner=timing, left=split.select("group_id", "label", "split"))
    train = data.where(split.where(FITTED), FITTED)
    weights = {"W1": formula_weights(DIMS, HIDDEN), "W2": formula_weights(HIDDEN, HIDDEN), **formula_timing(len(temporal.GAP_COLUMNS))}
    (model,) = centred(oneclass.train_tables(train, timing), oneclass.ONE_CLASS, [Model(weights, [], alpha=0.1)])
    return oneclass.score_tables(data, model, split, timing).select("group_id", "label", r6("score"))


@query
def timed_edge_scores(spark, folder):
    """Graph vectors of messages with each edge's timing, from weights that SQL can state too."""
    split = adjacency.cut_lineage(day_split(spark, folder))
    built, edges = timed_edges(spark, folder, split)
    data = oneclass.encoder_tables(built.graphs, edges, tables.event_vectors(spark, folder), timed=2)
    weights = {"W1": formula_weights(DIMS, HIDDEN), "W2": formula_weights(HIDDEN, HIDDEN)}
    for layer in timed.LAYERS:
        weights.update({f"t{name}{layer}": w for name, w in formula_timing(2).items()}, **{f"alpha{layer}": np.array([0.05])})
    (model,) = centred(timed.train_timed(data.where(split.where(FITTED))), timed.TIMED_EDGES, [Model(weights, [])])
    return with_labels(timed.score_timed(data, model), split).select("group_id", "label", r6("score"))


@query
def timed_edge_fit(spark, folder):
    split = adjacency.cut_lineage(day_split(spark, folder))
    built, edges = timed_edges(spark, folder, split)
    data = oneclass.encoder_tables(built.graphs, edges, tables.event_vectors(spark, folder), timed=2)
    train = timed.train_timed(data.where(split.where(FITTED)))
    model = timed.new_timed_model(DIMS, PRESET.hidden, SEED)
    (model,), _ = fit_models(train, timed.TIMED_EDGES, [model], [Plan(oneclass.staged(PRESET.epochs))])
    return with_labels(timed.score_timed(data, model), split).select("group_id", "label", r6("score"))


# --- metrics --------------------------------------------------------------------------------------


@query
def roc_auc(spark, folder):
    return metrics.roc_auc(tables.document_scores(spark, folder), ["lang"]).select("lang", r6("roc_auc"))


@query
def average_precision(spark, folder):
    ap = metrics.average_precision(tables.document_scores(spark, folder))
    return ap.select(r6("average_precision"))


@query
def metric_table(spark, folder):
    table = metrics.metric_table(tables.document_scores(spark, folder), ["lang", "source"])
    return table.select("lang", "source", "positives", "negatives", r6("roc_auc"), r6("average_precision"))


@query
def tie_ranks(spark, folder):
    return metrics.tie_ranks(tables.document_scores(spark, folder))


@query
def roc_points(spark, folder):
    points = metrics.roc_points(tables.document_scores(spark, folder), ["lang"])
    finite = F.when(F.col("step") > 0, F.col("threshold"))
    return points.select("lang", "step", r6("fpr"), r6("tpr"), finite.alias("threshold"))


@query
def roc_corners(spark, folder):
    points = metrics.roc_points(tables.document_scores(spark, folder), drop_intermediate=True)
    return points.select("step", r6("fpr"), r6("tpr"))


@query
def pr_points(spark, folder):
    points = metrics.pr_points(tables.document_scores(spark, folder))
    return points.select("step", r6("recall"), r6("precision"), "threshold")


@query
def curve_area(spark, folder):
    points = metrics.roc_points(tables.document_scores(spark, folder), ["lang"])
    return metrics.trapezoid(points, "fpr", "tpr", ["lang"]).select("lang", r6("area"))


def language_results(spark, folder) -> DataFrame:
    """Metrics per source (as configuration) and language (as seed)."""
    table = metrics.metric_table(tables.document_scores(spark, folder), ["source", "lang"])
    return table.select(
        F.col("source").alias("config"), F.col("lang").alias("seed"), F.col("roc_auc").alias("val_roc"),
        F.col("average_precision").alias("val_prc"),
    )


@query
def seed_summary(spark, folder):
    summary = metrics.seed_summary(language_results(spark, folder), ["val_roc", "val_prc"])
    return summary.select("config", *[r6(c) for c in summary.columns if c != "config"])


@query
def best_epoch(spark, folder):
    """Per source (as run) the language (as epoch) of the shortest documents on average; the first language is epoch 0."""
    docs = tables.table(spark, folder, "documents").where("lang is not null and source is not null")
    history = docs.groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("loss"))
    order = F.array_sort(F.collect_set("lang").over(Window.partitionBy("source")))
    history = history.select("source", (F.array_position(order, F.col("lang")) - 1).alias("epoch"), "loss")
    return metrics.best_epoch(history, ["source"])


@query
def best_config(spark, folder):
    rounded = language_results(spark, folder).select("config", "seed", r6("val_roc"), r6("val_prc"))
    return metrics.best_config(rounded)


# --- root causes ----------------------------------------------------------------------------------


def anomalous_graphs(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the anomalous user-day graphs; importance is the event count."""
    built = day_graphs(spark, folder, store=True)
    labels = day_labels(spark, folder).where("label = 1")
    nodes = graphs.only_groups(built.nodes, labels).select(
        "group_id", F.col("event").alias("node"), F.col("n").cast("double").alias("importance"), F.col("first_pos").alias("ts")
    )
    edges = graphs.only_groups(built.edges, labels).select(
        "group_id", F.col("src_event").alias("src"), F.col("dst_event").alias("dst"), F.col("n").cast("double").alias("weight")
    )
    return nodes, edges


def explained(spark, folder) -> explain.RootCauses:
    return explain.root_causes(*anomalous_graphs(spark, folder), TOP_K, MAX_HOPS, CHAIN_LIMIT)


def stored_subgraph(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The influential sub-graphs of the anomalous user-day graphs, stored: what follows them is a stage of its own, so that no
    task holds the sorts and aggregates of both."""
    nodes, edges = explain.influential_subgraph(*anomalous_graphs(spark, folder), TOP_K)
    return adjacency.cut_lineage(nodes), adjacency.cut_lineage(edges)


@query
def influential_subgraph(spark, folder):
    """Kept nodes (``dst`` null, with their importance) and the edges among them (with their weight)."""
    nodes, edges = explain.influential_subgraph(*anomalous_graphs(spark, folder), TOP_K)
    nodes = nodes.select("group_id", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), r6("importance", "size"))
    return nodes.unionByName(edges.select("group_id", "src", "dst", r6("weight", "size")))


@query
def causal_edges(spark, folder):
    nodes, edges = stored_subgraph(spark, folder)
    ranked = explain.rank_edges(
        explain.causal_edges(nodes, edges).withColumn("confidence", F.round("confidence", 9))
    )
    return ranked.select("group_id", "src", "dst", r6("confidence"), "frequency", "rank")


@query
def simple_paths(spark, folder):
    cedges = adjacency.cut_lineage(explain.causal_edges(*stored_subgraph(spark, folder)))
    paths = explain.simple_paths(cedges, MAX_HOPS)
    return paths.select("group_id", F.array_join("path", ">").alias("path"), r6("confidence"))


@query
def root_ranking(spark, folder):
    return explained(spark, folder).roots.select("group_id", "node", r6("score"), "rank")


@query
def causal_chains(spark, folder):
    chains = explained(spark, folder).chains
    return chains.select("group_id", "rank", F.array_join("path", ">").alias("path"), r6("confidence"))
