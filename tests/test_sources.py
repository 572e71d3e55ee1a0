import json

import numpy as np
import pytest

from tracelattice.operators import metrics, splits
from tracelattice.sources import bundle, logs, store


def write(path, text):
    path.write_text(text)
    return str(path)


def test_structured_logs(spark, tmp_path):
    path = write(tmp_path / "log.csv", 'LineId,EventId,EventTemplate,Node,Timestamp\n1,E1,"a, ""b""",007,5\n2,E2,c,008,6.5\n')
    rows = logs.read_log(spark, path, "bgl").orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [("007", 1, "E1", 'a, "b"', 5.0), ("008", 2, "E2", "c", 6.5)]
    path = write(tmp_path / "h.csv", "LineId,EventTemplate,ParameterList,Time\n1,a,['blk_-5'],2005-06-03-15.42.50.363779\n2,b,none,2005-06-03-15.42.51.363779\n")
    rows = logs.read_log(spark, path, "hdfs").orderBy("seq").collect()
    assert [r["group_id"] for r in rows] == ["blk_-5", None] and rows[1]["ts_s"] - rows[0]["ts_s"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        logs.read_log(spark, path, "hadoop")
    path = write(tmp_path / "labels.csv", "BlockId,Label\nx,Normal\ny,Anomaly\n")
    assert {tuple(r) for r in logs.read_labels(spark, path).collect()} == {("x", 0), ("y", 1)}


def test_free_logs(spark, tmp_path):
    path = write(tmp_path / "f.csv", "n, Node ,Label,EventTemplate,Content,datetime\n1,a,0,,hello,x\n2,a,1,t,hi,9\n3,b,0,nan,,3\n")
    rows = logs.read_free_log(spark, path, "n").orderBy("seq").collect()
    assert [(r["group_id"], r["event"], r["ts_s"]) for r in rows] == [("a", "hello", 0.0), ("a", "t", 9.0), ("b", "UNKNOWN", 3.0)]
    out = splits.protocol_splits_from_log(logs.read_free_log(spark, path, "n"))
    assert {(r["group_id"], r["label"]) for r in out.collect()} == {("a", 1), ("b", 0)}
    path = write(tmp_path / "raw.csv", "i,node,message,timestamp\n1,a,m,2\n")
    assert tuple(logs.read_raw_log(spark, path, "i").first()) == ("a", 1, "m", 2.0)


def test_vector_files(spark, tmp_path):
    a = write(tmp_path / "a.json", json.dumps({"x": [1, 2.5], "y ], \"q": [3, 4]}))
    b = write(tmp_path / "b.json", json.dumps({"x": {str(i): i * 1.0 for i in range(12)}}))
    c = write(tmp_path / "c.json", '{"event": "x", "vec": [1.0, 2.0]}\n{"event": "z", "vec": [0.0, 1.0]}\n')
    assert {r["event"]: r["vec"] for r in logs.read_embeddings(spark, a).collect()} == {"x": [1.0, 2.5], 'y ], "q': [3.0, 4.0]}
    assert logs.read_embeddings(spark, b).first()["vec"] == [float(i) for i in range(12)]
    assert logs.read_embeddings(spark, c, "lines").count() == 2
    with pytest.raises(ValueError):
        logs.read_embeddings(spark, a, "other")


def test_split_files(spark, tmp_path):
    rows = [("a", 0, "train"), ("b", 1, "test"), ("c", 0, "validation")]
    df = spark.createDataFrame(rows, "group_id string, label int, split string")
    store.write_splits(df, str(tmp_path))
    assert {tuple(r) for r in logs.read_splits(spark, str(tmp_path)).collect()} == set(rows)
    ids = logs.read_split_ids(spark, {s: f"{tmp_path}/{s}_graph_ids" for s in splits.SPLITS})
    assert {tuple(r) for r in ids.collect()} == set(rows)
    assert spark.read.option("header", True).csv(f"{tmp_path}/audit").count() == 4


def test_scores_curves_results_models(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.5), ("c", 1, 0.5), ("d", 0, 0.1)], "group_id string, label int, score double")
    store.write_predictions(scores, f"{tmp_path}/p")
    assert {tuple(r) for r in store.read_predictions(spark, f"{tmp_path}/p").collect()} == {tuple(r) for r in scores.collect()}
    store.write_curves(metrics.roc_points(scores), metrics.pr_points(scores), str(tmp_path))
    assert metrics.trapezoid(store.read_curve(spark, str(tmp_path), "roc"), "fpr", "tpr").first()[0] == 0.875
    results = spark.createDataFrame([("x", 1, 0.1, 0.2, 0.3, 0.4)], "config string, seed int, val_roc double, val_prc double, test_roc double, test_prc double")
    store.write_results(results, f"{tmp_path}/r")
    store.write_results(results, f"{tmp_path}/r", append=True)
    assert store.read_results(spark, f"{tmp_path}/r").count() == 2
    model = store.Model({"W1": np.arange(6.0).reshape(2, 3), "gain": np.ones(3)}, [1.0, 2.0], 2, 0.1, {"seed": 42})
    store.save_model(spark, model, f"{tmp_path}/m")
    back = store.load_model(spark, f"{tmp_path}/m")
    np.testing.assert_array_equal(back.weights["W1"], model.weights["W1"])
    assert (back.centre, back.layers, back.alpha, back.meta) == (model.centre, 2, 0.1, {"seed": 42})


def test_text_bundle_round_trip(spark, tmp_path):
    graphs = spark.createDataFrame([("k2", 1, 2), ("k1", 0, 3)], "group_id string, label int, n_nodes bigint")
    nodes = spark.createDataFrame(
        [(g, i, [float(i), len(g) + 0.5]) for g, n in (("k1", 3), ("k2", 2)) for i in range(n)],
        "group_id string, node_id int, x array<double>",
    )
    edges = [("k1", 0, 1, 0.25), ("k1", 2, 2, 1.0), ("k2", 1, 0, 0.5)]
    adj = spark.createDataFrame(edges, "group_id string, src int, dst int, w double")
    bundle.write_text_bundle(graphs, nodes.repartition(3), adj.repartition(3), str(tmp_path), "T", adj2=adj)
    lines = spark.read.text(f"{tmp_path}/T_A").collect()
    assert sorted(r["value"] for r in lines) == ["1, 2", "3, 3", "5, 4"]
    back = bundle.read_text_bundle(spark, str(tmp_path), "T")
    names = {"k1": "1", "k2": "2"}
    assert {tuple(r) for r in back["graphs"].collect()} == {("1", 0), ("2", 1)}
    for key in ("adj", "adj2"):
        assert {tuple(r) for r in back[key].collect()} == {(names[g], *rest) for g, *rest in edges}
    assert {(r[0], r[1], tuple(r[2])) for r in back["nodes"].collect()} == {
        (names[r[0]], r[1], tuple(r[2])) for r in nodes.collect()
    }


def test_graph_store(spark, tmp_path):
    from tracelattice.operators.graphs import build_graphs

    log = spark.createDataFrame([("g", i, "ab"[i % 2], float(i)) for i in range(6)], "group_id string, seq bigint, event string, ts_s double")
    built = build_graphs(log)
    store.write_graphs(built, str(tmp_path / "s"))
    back = store.read_graphs(spark, str(tmp_path / "s"))
    assert {k: v.count() for k, v in back.items()} == {"nodes": 2, "edges": 2, "graphs": 1}


def test_awkward_keys_survive_split_files(spark, tmp_path):
    rows = [('a"b', 0, "train"), ("c,d", 1, "test"), ("e\nf", 0, "validation"), ("g\\h", 0, "train"), ('\\"', 1, "test")]
    store.write_splits(spark.createDataFrame(rows, "group_id string, label int, split string"), str(tmp_path))
    assert {tuple(r) for r in logs.read_splits(spark, str(tmp_path)).collect()} == set(rows)


def test_quoted_line_breaks_need_no_flag(spark, tmp_path):
    path = write(tmp_path / "log.csv", 'LineId,EventTemplate,Node,Timestamp\n1,"a\nb",x,5\n2,c,y,6\n')
    assert [(r["seq"], r["event"]) for r in logs.read_log(spark, path, "bgl").orderBy("seq").collect()] == [(1, "a\nb"), (2, "c")]
