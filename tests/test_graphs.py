import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelattice.operators import graphs, temporal

LOG = "group_id string, seq bigint, event string, ts_s double"


def log(spark):
    rows = [("s", i, e, t) for i, (e, t) in enumerate(zip("ababc", (0.0, 1.0, 3.0, 3.0, 2.0)))]
    rows += [("one", 0, "x", 5.0), ("rep", 0, "a", 0.0), ("rep", 1, "a", 4.0), (None, 0, "z", 1.0)]
    return spark.createDataFrame(rows, LOG)


def by_edge(edges):
    return {(r["group_id"], r["src_event"], r["dst_event"]): r for r in edges.collect()}


def test_counts_gaps_and_node_numbers(spark):
    built = graphs.build_graphs(log(spark))
    edges = by_edge(built.edges)
    assert {k for k in edges if k[0] == "s"} == {("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c")}
    ab = edges["s", "a", "b"]
    assert (ab["n"], ab["mean_dt"], ab["var_dt"]) == (2, 0.5, 0.25)
    assert edges["s", "b", "a"]["mean_dt"] == 2 and edges["s", "b", "c"]["mean_dt"] == 0
    ids = {(r["group_id"], r["event"]): r["node_id"] for r in built.nodes.collect()}
    assert [ids["s", e] for e in "abc"] == [0, 1, 2]
    assert (ab["src"], ab["dst"]) == (0, 1)
    assert edges["rep", "a", "a"]["n"] == 1
    assert not any(g is None for g, _ in ids)


def test_singletons(spark):
    skip = graphs.build_graphs(log(spark))
    assert "one" not in {k[0] for k in by_edge(skip.edges)}
    loop = by_edge(graphs.build_graphs(log(spark), singletons="self_loop").edges)["one", "x", "x"]
    assert (loop["src"], loop["dst"], loop["n"], loop["mean_dt"], loop["var_dt"]) == (0, 0, 1, 0.0, 0.0)
    with pytest.raises(ValueError):
        graphs.build_graphs(log(spark), singletons="other")


def test_stats_and_minimum(spark):
    stats = {r["group_id"]: tuple(r)[1:] for r in graphs.build_graphs(log(spark)).graphs.collect()}
    assert stats == {"s": (5, 3, 3), "one": (1, 1, 0), "rep": (2, 1, 1)}
    legacy = graphs.build_graphs(log(spark), min_edges=2)
    assert {r["group_id"] for r in legacy.nodes.collect()} == {"s"}
    assert {r["group_id"] for r in legacy.edges.collect()} == {"s"}


def test_counts_add_up_and_partitioning_does_not_matter(spark):
    rows = [(f"g{i % 7}", i, "abcd"[(i * i) % 4], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, LOG)
    one, many = graphs.build_graphs(df.repartition(1)), graphs.build_graphs(df.repartition(9), store=True)
    assert one.edges.agg(F.sum("n")).first()[0] == 200 - 7
    assert sorted(map(tuple, one.edges.collect())) == sorted(map(tuple, many.edges.collect()))


def test_edges_need_one_shuffle_of_the_log(spark, capsys):
    edges = graphs.build_graphs(log(spark)).edges
    capsys.readouterr()
    edges.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_gap_summary_matches_numpy(spark):
    out = {r["group_id"]: r for r in temporal.gap_summary(graphs.steps(log(spark))).collect()}
    gaps = np.log1p([1, 2, 0, 0])
    want = [gaps.mean(), np.median(gaps), np.percentile(gaps, 95), gaps.std(), gaps.max(), 0.5]
    assert [out["s"][c] for c in temporal.GAP_COLUMNS] == pytest.approx(want)
    assert [out["one"][c] for c in temporal.GAP_COLUMNS] == [0.0] * 6


def test_edge_summary_and_scaler(spark):
    built = graphs.build_graphs(log(spark), singletons="self_loop")
    s = temporal.edge_summary(built.edges).where("group_id = 's'").first()
    means, variances = np.log1p([0.5, 2, 0]), np.log1p([0.25, 0, 0])
    assert s["mean_log_mean_dt"] == pytest.approx(means.mean()) and s["std_log_var_dt"] == pytest.approx(variances.std())
    logs = graphs.log_scaled_edges(built.edges)
    splits = spark.createDataFrame([("s", 0, "train"), ("rep", 1, "test")], "group_id string, label int, split string")
    scaled, scaler = temporal.scale_edges(logs, splits)
    assert scaler.means[0] == pytest.approx(means.mean()) and scaler.stds[0] == pytest.approx(means.std())
    rep = scaled.where("group_id = 'rep'").first()
    assert rep["log_mean_dt"] == pytest.approx((np.log1p(4) - means.mean()) / means.std())
    with pytest.raises(RuntimeError):
        temporal.fit_scaler(logs.where("1 = 0"), ["log_n"])


def test_collapse_sums_parallel_edges(spark):
    rows = [("g", "a", "b", 2.0), ("g", "a", "b", float("nan")), ("g", "b", "a", -1.0)]
    edges = spark.createDataFrame(rows, "group_id string, src string, dst string, weight double")
    got = {(r["src"], r["dst"]): r["weight"] for r in graphs.collapse_edges(edges).collect()}
    assert got == {("a", "b"): 3.0, ("b", "a"): -1.0}
