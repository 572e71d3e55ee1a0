"""Registered queries that write what another query computes, in each stored form, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelattice.operators import adjacency, metrics, splits
from tracelattice.plans import oneclass, tables
from tracelattice.plans.queries import (
    DIMS, HIDDEN, SEED, day_encoder_tables, day_graphs, day_labels, day_split, edge_columns, edge_weights, formula_weights, half,
    language_results, query, r6, weighted_graphs,
)
from tracelattice.plans.training import centred
from tracelattice.session import shared_folder
from tracelattice.sources import bundle, logs, store


def day_protocol(spark, folder):
    labels = day_labels(spark, folder)
    return splits.protocol_splits(labels, half(labels), SEED)


@query
def stored_log(spark, folder):
    """Keys and messages hold commas, quotes and line breaks."""
    path = shared_folder(spark)
    log = tables.event_log(spark, folder)
    awkward = F.concat(F.lit('a "b", c\n'), F.col("message"))
    store.write_csv(
        log.select(
            F.col("group_id").alias("node"), F.col("event_id").alias("line"), awkward.alias("message"), F.col("ts_s").alias("timestamp")
        ),
        path,
    )
    back = logs.read_raw_log(spark, path, "line")
    return back.select("group_id", "seq", F.translate("event", "\n", "|").alias("event"), r6("ts_s"))


@query
def stored_structured_log(spark, folder):
    """A structured log under the column names of a preset."""
    path = shared_folder(spark)
    log = tables.event_log(spark, folder)
    written = log.select(
        F.col("event_id").alias("LineId"), F.col("component").alias("EventId"), F.col("message").alias("EventTemplate"),
        F.col("group_id").alias("Node"), F.col("ts_s").alias("Timestamp"), F.col("level").alias("Level"),
    )
    store.write_csv(written, path)
    back = logs.read_log(spark, path, "bgl", ["Level"], multiline=False)
    return back.select("group_id", "seq", "event_id", "event", r6("ts_s"), F.col("Level").alias("level"))


@query
def stored_free_log(spark, folder):
    """Times of views are no numbers and become positions in the group."""
    path = shared_folder(spark)
    log = tables.event_log(spark, folder)
    time = F.when(F.col("event") != "view", F.col("ts_s").cast("string")).otherwise("n/a")
    template = F.when(F.col("event") != "error", F.col("event"))
    store.write_csv(
        log.select(
            F.col("group_id").alias("Node"), F.col("label").alias("Label"), template.alias("EventTemplate"),
            F.col("message").alias("Content"), time.alias("Timestamp"), F.col("event_id").alias("line"),
        ),
        path,
    )
    back = logs.read_free_log(spark, path, "line")
    return back.select("group_id", "seq", "event", F.col("label").cast("int").alias("label"), r6("ts_s"))


@query
def stored_labels(spark, folder):
    path = shared_folder(spark)
    named = F.when(F.col("label") == 1, "Anomaly").otherwise("Normal")
    store.write_csv(day_labels(spark, folder).select(F.col("group_id").alias("BlockId"), named.alias("Label")), path)
    return logs.read_labels(spark, path)


@query
def stored_vectors(spark, folder):
    path = shared_folder(spark)
    tables.event_vectors(spark, folder).write.json(path)
    back = logs.read_embeddings(spark, path, "lines")
    return back.select("event", F.posexplode("vec").alias("d", "v")).select("event", "d", r6("v"))


@query
def stored_splits(spark, folder):
    path = shared_folder(spark)
    store.write_splits(day_protocol(spark, folder), path)
    return logs.read_splits(spark, path)


@query
def stored_split_ids(spark, folder):
    path = shared_folder(spark)
    store.write_splits(day_protocol(spark, folder), path)
    return logs.read_split_ids(spark, {s: f"{path}/{s}_graph_ids" for s in splits.SPLITS})


@query
def stored_graphs(spark, folder):
    path = shared_folder(spark)
    store.write_graphs(day_graphs(spark, folder, store=True), path)
    return edge_columns(store.read_graphs(spark, path)["edges"])


def written_bundle(spark, folder):
    """Graphs, one-number node vectors and undirected adjacency as text, read back."""
    path = shared_folder(spark)
    built = day_graphs(spark, folder, store=True)
    edges, nodes = weighted_graphs(spark, folder)
    bundle.write_text_bundle(
        built.graphs.join(day_labels(spark, folder), "group_id"),
        built.nodes.select("group_id", "node_id", F.array(F.col("n").cast("double"), F.col("first_pos") / 3).alias("x")),
        adjacency.cut_lineage(adjacency.norm_undirected(edges, nodes)),
        path,
        "days",
    )
    return bundle.read_text_bundle(spark, path, "days")


@query
def bundle_nodes(spark, folder):
    read = written_bundle(spark, folder)
    nodes = read["nodes"].join(read["graphs"], "group_id")
    return nodes.select("group_id", "label", "node_id", *[r6_item("x", i, c) for i, c in enumerate(("n", "third"))])


def r6_item(vector, i, alias):
    return F.round(F.get(vector, F.lit(i)), 6).alias(alias)


@query
def bundle_edges(spark, folder):
    return edge_weights(written_bundle(spark, folder)["adj"])


@query
def stored_predictions(spark, folder):
    path = shared_folder(spark)
    store.write_predictions(tables.document_scores(spark, folder), path)
    return store.read_predictions(spark, path)


@query
def stored_curves(spark, folder):
    path = shared_folder(spark)
    scores = tables.document_scores(spark, folder)
    store.write_curves(metrics.roc_points(scores), metrics.pr_points(scores), path)
    roc = store.read_curve(spark, path, "roc").select(F.lit("roc").alias("curve"), "step", r6("fpr", "x"), r6("tpr", "y"))
    pr = store.read_curve(spark, path, "pr").select(F.lit("pr").alias("curve"), "step", r6("recall", "x"), r6("precision", "y"))
    return roc.unionByName(pr)


@query
def stored_results(spark, folder):
    path = shared_folder(spark)
    results = language_results(spark, folder).select(
        F.concat_ws("/", "config", "seed").alias("config"), F.lit(SEED).alias("seed"), "val_roc", "val_prc",
        (1 - F.col("val_roc")).alias("test_roc"), F.col("val_prc").alias("test_prc"),
    )
    store.write_results(results, path)
    store.write_results(results.withColumn("seed", F.lit(SEED + 1)), path, append=True)
    back = store.read_results(spark, path)
    return back.select("config", "seed", *[r6(c) for c in ("val_roc", "val_prc", "test_roc", "test_prc")])


@query
def stored_model_scores(spark, folder):
    """Scores of a model, weights and centre, that was saved and loaded."""
    path = shared_folder(spark)
    data, train, split = day_encoder_tables(spark, folder)
    weights = {"W1": formula_weights(DIMS, HIDDEN), "W2": formula_weights(HIDDEN, HIDDEN)}
    (model,) = centred(oneclass.train_tables(train), oneclass.ONE_CLASS, [store.Model(weights, [], meta={"dims": DIMS})])
    store.save_model(spark, model, path)
    return oneclass.score_tables(data, store.load_model(spark, path), split).select("group_id", "label", r6("score"))


@query
def joined_splits(spark, folder):
    split = day_split(spark, folder)
    return splits.union_splits(split.where("split = 'train'"), split.where("split = 'test'"))
