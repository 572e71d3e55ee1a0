"""Ordered work gives the plain window's result however groups are cut."""

import random

import pytest
from pyspark.sql import functions as F

from tracelattice import session
from tracelattice.operators import graphs, metrics, splits, temporal
from tracelattice.operators.ordered import CHUNK, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", i, rng.choice("abcde"), float(i // 2 + rng.random())) for i in range(1500)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "group_id string, seq bigint, event string, ts_s double").repartition(7)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_scan_is_the_same_in_chunks(skewed):
    options = dict(lead={"next_event": "event"}, running={"upto": F.col("seq")}, position="pos", has_next="more")
    plain = ordered(skewed, ["group_id"], ["seq"])
    cut = ordered(skewed, ["group_id"], ["seq"], hot_rows=30)
    assert not plain.is_hot and cut.is_hot
    assert same(plain.scan(**options), cut.scan(**options))


def test_large_group_is_split_evenly_and_whole(skewed):
    sizes = ordered(skewed, ["group_id"], ["seq"], hot_rows=100).chunked().groupBy("group_id", CHUNK).count().collect()
    hot = [r["count"] for r in sizes if r["group_id"] == "hot"]
    assert sum(hot) == 500 and len(hot) >= 4 and max(hot) < 300
    assert all(r[CHUNK] is None for r in sizes if r["group_id"] != "hot")


def test_every_large_group_is_cut(spark):
    rows = [(f"g{i % 90}", i, "e", float(i)) for i in range(9000)]
    df = spark.createDataFrame(rows, "group_id string, seq bigint, event string, ts_s double")
    cut = ordered(df, ["group_id"], ["seq"], hot_rows=20)
    sizes = cut.chunked().groupBy("group_id", CHUNK).count().collect()
    assert len({r["group_id"] for r in sizes if r[CHUNK] is not None}) == 90 and max(r["count"] for r in sizes) < 100
    assert same(ordered(df, ["group_id"], ["seq"]).scan(position="pos"), cut.scan(position="pos"))


def test_null_values_are_not_taken_for_missing_rows(spark):
    rows = [("g", i, None if i % 4 == 0 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "group_id string, seq bigint, event string")
    options = dict(lead={"n": "event"}, has_next="more")
    cut = ordered(df, ["group_id"], ["seq"], hot_rows=10)
    assert cut.is_hot and same(ordered(df, ["group_id"], ["seq"]).scan(**options), cut.scan(**options))


@pytest.mark.parametrize("singletons", ["skip", "self_loop"])
def test_graphs_do_not_depend_on_cutting(skewed, singletons):
    def rounded(df):
        return df.select(*[F.round(c, 6).alias(c) if c.endswith("_dt") else F.col(c) for c in df.columns])

    plain = graphs.build_graphs(skewed, singletons=singletons)
    cut = graphs.build_graphs(skewed, singletons=singletons, hot_rows=40)
    for name in ("nodes", "edges", "graphs"):
        assert same(rounded(getattr(plain, name)), rounded(getattr(cut, name)))


def test_gap_summary_of_a_large_group(skewed):
    def rounded(df):
        return df.select("group_id", *[F.round(c, 8).alias(c) for c in temporal.GAP_COLUMNS])

    plain = temporal.gap_summary(graphs.steps(skewed))
    cut = temporal.gap_summary(graphs.steps(skewed, hot_rows=40))
    assert same(rounded(plain), rounded(cut))


def test_metrics_in_chunks(spark):
    rng = random.Random(3)
    rows = [(f"g{i}", rng.randrange(2), float(rng.randrange(200))) for i in range(600)]
    scores = spark.createDataFrame(rows, "group_id string, label int, score double")
    a, b = metrics.metric_table(scores).first(), metrics.metric_table(scores, hot_rows=20).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["average_precision"] == pytest.approx(b["average_precision"])
    for points in (metrics.roc_points, metrics.pr_points):
        assert same(points(scores), points(scores, hot_rows=20))
    offsets = graphs.prefix_offsets(scores.select("group_id", F.lit(3).alias("n_nodes")))
    assert same(offsets, graphs.prefix_offsets(scores.select("group_id", F.lit(3).alias("n_nodes")), hot_rows=25))


def test_tasks_grow_with_the_rows_of_a_log(skewed, monkeypatch):
    """a task of the one stage of edges keeps its size however large the log is."""
    usual = graphs.build_graphs(skewed).edges.collect()
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    built = graphs.build_graphs(skewed)
    assert built.edges.rdd.getNumPartitions() >= 1500 // 50
    assert sorted(map(tuple, built.edges.collect())) == sorted(map(tuple, usual))
    cut = graphs.build_graphs(skewed, hot_rows=30)
    assert same(cut.edges.withColumns({c: F.round(c, 9) for c in ("mean_dt", "var_dt")}),
                built.edges.withColumns({c: F.round(c, 9) for c in ("mean_dt", "var_dt")}))


def test_tasks_grow_with_the_rows_of_stored_transitions(skewed, monkeypatch):
    """stored transitions go over tasks by their number."""
    usual = graphs.build_graphs(skewed, store=True)
    rows = usual.transitions.count()
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    built = graphs.build_graphs(skewed, store=True)
    assert built.transitions.rdd.getNumPartitions() >= rows // 20
    assert same(built.nodes, usual.nodes) and same(built.edges, usual.edges)
