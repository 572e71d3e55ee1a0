"""Packed graphs: message passing, encoders and training agree with the joined forms, and plans move data as little as stated."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelattice.operators import adjacency, features, graphs, packed, propagate, splits
from tracelattice.plans import oneclass as O
from tracelattice.plans import queries, timed
from tracelattice.plans.training import Plan, Stage, centred, fit_models, mean_gradients

SMALL = "/root/testdata/sf0.001"
SIZES = {"a": 7, "b": 1, "c": 3, "d": 5, "e": 2}


@pytest.fixture(scope="module")
def tables(spark):
    """Sizes, edges with timing, node vectors; one graph has no edge."""
    rng = random.Random(5)
    edges = {(g, rng.randrange(n), rng.randrange(n)) for g, n in SIZES.items() if g != "b" for _ in range(3 * n)}
    rows = [(g, s, d, rng.choice((1.0, 2.0, 5.0)), [rng.gauss(0, 1), rng.gauss(0, 1)]) for g, s, d in sorted(edges)]
    x = [(g, i, [rng.gauss(0, 1) for _ in range(4)]) for g, n in SIZES.items() for i in range(n)]
    rng.shuffle(x)
    sizes = [(g, n, sum(e[0] == g for e in edges)) for g, n in SIZES.items()]
    return (
        spark.createDataFrame(sizes, "group_id string, n_nodes int, n_edges int"),
        spark.createDataFrame(rows, "group_id string, src int, dst int, w double, t array<double>"),
        spark.createDataFrame(x, "group_id string, node_id int, x array<double>"),
    )


def values(df, *keys):
    column = [c for c in df.columns if c not in keys][0]
    return {tuple(r[k] for k in keys): np.array(r[column]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("norm", ["un", "appr"])
@pytest.mark.parametrize("limit", [0, 6, packed.LIMIT])
def test_propagation_of_all_sizes(tables, norm, limit):
    sizes, edges, x = tables
    adj = adjacency.normalise(edges.drop("t"), x.select("group_id", "node_id"), mode=norm)
    want = values(propagate.propagate(adj, x), "group_id", "node_id")
    same(values(packed.propagate_graphs(sizes, edges, x, norm, limit), "group_id", "node_id"), want)


@pytest.mark.parametrize("block", [1, 2, 3, packed.BLOCK])
def test_grid_of_blocks(tables, block):
    _, edges, x = tables
    same(values(packed.propagate_blocks(edges, x, block), "group_id", "node_id"), values(propagate.propagate(edges, x), "group_id", "node_id"))


def test_edges_as_they_are(tables):
    _, edges, x = tables
    got = values(packed.propagate(packed.pack(edges, x)), "group_id", "node_id")
    want = values(propagate.propagate(edges, x), "group_id", "node_id")
    for k, v in got.items():
        np.testing.assert_allclose(v, want.get(k, np.zeros(4)), atol=1e-12)


@pytest.mark.parametrize("limit", [0, 6, packed.LIMIT])
def test_packs_from_named_events(spark, tables, limit):
    sizes, edges, _ = tables
    vectors = spark.createDataFrame([(f"e{i}", [float(i), 1.0 / (i + 1)]) for i in range(9)], "event string, vec array<double>")
    named = edges.withColumns({f"{c}_event": F.concat(F.lit("e"), F.col(c) % 5) for c in ("src", "dst")})
    ends = edges.select("group_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    present = ends.groupBy("group_id").agg(F.count("*").alias("k"), F.max("node_id").alias("m")).where("k = m + 1").select("group_id")
    named, ends = named.join(present, "group_id", "left_semi"), ends.join(present, "group_id", "left_semi")
    x = features.with_vectors(ends.withColumn("event", F.concat(F.lit("e"), F.col("node_id") % 5)), vectors)
    x = x.select("group_id", "node_id", F.col("vec").alias("x"))
    want = values(packed.propagate_graphs(sizes, named, x, "un"), "group_id", "node_id")
    same(values(packed.propagate_graphs(sizes, named, vectors, "un", limit), "group_id", "node_id"), want)
    with pytest.raises(Exception, match="no vector"):
        packed.propagate_graphs(sizes, named, vectors.where("event <> 'e0'"), "un", limit).collect()


@pytest.mark.parametrize("layers", [1, 2])
@pytest.mark.parametrize("limit", [0, packed.LIMIT])
def test_encoders_of_all_sizes(tables, layers, limit):
    sizes, edges, x = tables
    rng = np.random.default_rng(1)
    w1, w2 = rng.normal(size=(4, 6)), rng.normal(size=(6, 3))
    adj = adjacency.norm_ppr(edges.drop("t"), x.select("group_id", "node_id"))
    want = values(propagate.encode(adj, x, w1, w2, layers), "group_id")
    same(values(packed.encode_graphs(sizes, edges, x, w1, w2, "appr", layers, limit), "group_id"), want)


@pytest.fixture(scope="module")
def summary(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(g, [rng.gauss(0, 1), rng.gauss(0, 1)]) for g in SIZES], "group_id string, t array<double>")


def test_training_by_packs_and_by_joins(tables, summary):
    sizes, edges, x = tables
    model, plan = O.new_model(4, 5, 3, timing_width=2, alpha=0.3), Plan(O.staged(6, 2, 0.05, 0.02), warmup=3)
    results = []
    for limit in (0, 4, packed.LIMIT):
        data = O.encoder_tables(sizes, edges, x, limit=limit)
        assert (data.wide is None) == (limit == packed.LIMIT)
        (fitted,), (history,) = fit_models(O.train_tables(data, summary), O.ONE_CLASS, [model], [plan])
        results.append((fitted, [loss for _, loss in history], values(O.score_tables(data, fitted, None, summary).drop("score_sq"), "group_id")))
    for fitted, losses, scores in results[:-1]:
        np.testing.assert_allclose(losses, results[-1][1], rtol=1e-9)
        same(scores, results[-1][2])
        for name, w in fitted.weights.items():
            np.testing.assert_allclose(w, results[-1][0].weights[name], rtol=1e-9, atol=1e-12)
    # rows that come unpacked give the same
    adj = adjacency.norm_ppr(edges.drop("t"), x.select("group_id", "node_id"))
    _, history = O.fit_one_class(propagate.encoder_rows(adj, x), model, plan.stages, summary=summary, warmup=3, limit=3)
    np.testing.assert_allclose([loss for _, loss in history], results[-1][1], rtol=1e-9)


def test_timed_training_by_packs_and_by_joins(tables):
    sizes, edges, x = tables
    model, results = timed.new_timed_model(4, 5, 3, alpha=0.3), []
    for limit in (0, 4, packed.LIMIT):
        data = O.encoder_tables(sizes, edges, x, timed=2, limit=limit)
        train = timed.train_timed(data)
        (start,) = centred(train, timed.TIMED_EDGES, [model])
        ((loss, grads),) = mean_gradients(train, timed.TIMED_EDGES, [start], [True])
        (fitted,), (history,) = fit_models(train, timed.TIMED_EDGES, [model], [Plan(O.staged(4, 2, 0.05, 0.02))])
        results.append((loss, grads, [v for _, v in history], values(timed.score_timed(data, fitted).drop("score_sq"), "group_id")))
    for loss, grads, history, scores in results[:-1]:
        assert loss == pytest.approx(results[-1][0])
        for name, g in grads.items():
            np.testing.assert_allclose(g, results[-1][1][name], rtol=1e-8, atol=1e-12)
        np.testing.assert_allclose(history, results[-1][2], rtol=1e-8)
        same(scores, results[-1][3])
    adj = adjacency.norm_ppr(edges.drop("t"), x.select("group_id", "node_id"))
    timed_edges = propagate.with_edge_stats(adj, edges)
    _, history = timed.fit_timed(propagate.encoder_rows(adj, x), timed_edges, model, O.staged(4, 2, 0.05, 0.02), limit=1000)
    np.testing.assert_allclose([v for _, v in history], results[-1][2], rtol=1e-8)


def test_many_models_share_the_passes(tables):
    sizes, edges, x = tables
    data = O.train_tables(O.encoder_tables(sizes, edges, x))
    models = [O.new_model(4, h, s) for h, s in ((5, 1), (3, 2), (5, 3))]
    plans = [Plan([Stage(4, 0.02)]), Plan([Stage(2, 0.01)], warmup=1), Plan([Stage(3, 0.05)], 0.1)]
    _, together = fit_models(data, O.ONE_CLASS, models, plans)
    for model, plan, history in zip(models, plans, together):
        _, (alone,) = fit_models(data, O.ONE_CLASS, [model], [plan])
        assert [e for e, _ in alone] == [e for e, _ in history]
        np.testing.assert_allclose([v for _, v in history], [v for _, v in alone], rtol=1e-10)


def test_the_step_of_the_query_shows(spark, monkeypatch):
    stepped = values(queries.one_class_step(spark, SMALL).select("group_id", "score"), "group_id")
    monkeypatch.setattr(queries, "STEP_RATE", 0.0)
    still = values(queries.one_class_step(spark, SMALL).select("group_id", "score"), "group_id")
    assert max(abs(stepped[k] - still[k]) for k in still) > 0.01


def plan_of(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_message_passing_moves_stored_graphs_once(spark):
    """One exchange of the stored transitions by their group serves nodes, edges and packs; one more averages the event vectors."""
    plan = plan_of(packed.propagate_graphs(*queries.vector_graphs(spark, SMALL), "un"))
    assert plan.count("ShuffleQueryStage") - plan.count("ReusedExchange") <= 2, plan


def test_node_features_read_the_log_once(spark):
    plan = plan_of(queries.QUERIES["node_features"](spark, SMALL))
    assert plan.count("event_type") and plan.count("FileScan parquet") == 2, plan  # the log and the event vectors
    assert plan.count("ShuffleQueryStage") <= 3, plan


def test_standardised_graphs(spark):
    rng = np.random.default_rng(4)
    parts = {"a": rng.normal(5, 2, (6, 3)), "b": rng.normal(size=(1, 3)), "c": np.tile([1e6 + 0.1, 2.0, -3.0], (4, 1))}
    parts["a"][:, 1] = 7.7
    rows = [(g, f"e{i}", [float(v) for v in x[i]]) for g, x in parts.items() for i in range(len(x))]
    nodes = spark.createDataFrame(rows, "group_id string, event string, x array<double>")
    for any_size in (False, True):
        got = features.standardise_within(nodes, any_size=any_size)
        assert got.columns == nodes.columns
        for r in got.collect():
            x = parts[r["group_id"]]
            spread = np.where(x.std(axis=0) < 1e-9, np.inf, x.std(axis=0))
            want = x[0] if len(x) == 1 else (x[int(r["event"][1:])] - x.mean(axis=0)) / spread
            np.testing.assert_allclose(r["x"], want, atol=1e-9)
    assert features.standardise_within(nodes.limit(0)).collect() == []


def test_moments_merge(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        event, kind = rng.choice("xy"), rng.choice(("disk", "net", "fan"))
        numbers = " ".join(str(round(1e6 + rng.gauss(0, 3), 3)) for _ in range(rng.randrange(0, 4)))
        rows.append((rng.choice("gh"), i, event, kind, rng.choice(("INFO", "WARN", "ERROR")), f"{kind} {numbers}"))
    log = spark.createDataFrame(rows, "group_id string, seq bigint, event string, component string, level string, message string")
    step = graphs.steps(features.parsed_fields(log), ts=None, carry=("severity", "component", "params"))
    got = {(r["group_id"], r["event"]): r["stats"] for r in features.node_statistics(step).collect()}
    for (g, e), stats in got.items():
        mine = [r for r in rows if r[0] == g and r[2] == e]
        numbers = np.array([float(v) for r in mine for v in r[5].split()[1:]])
        want = [numbers.mean(), numbers.std(), numbers.min(), numbers.max()]
        np.testing.assert_allclose(stats[-4:], np.log1p(want), rtol=1e-9)
        order = sorted(r[1] for r in rows if r[0] == g)
        places = [order.index(r[1]) for r in mine]
        np.testing.assert_allclose(stats[-7:-4], np.array([len(mine), min(places), max(places)]) / len(order))
        for column, slots in ((4, stats[:7]), ):
            names = [r[column] for r in mine]
            best = min(set(names), key=lambda v: (-names.count(v), v))
            assert slots.index(1.0) == ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN").index(best)


def test_row_fields_under_other_names(spark):
    rows = [("a", " ", "warning", None, "Core", "db"), ("b", "CRITICAL", None, "", None, "web"), ("c", None, None, "net", "x", None)]
    log = spark.createDataFrame(rows, "event string, Level string, LogLevel string, Component string, Module string, Service string")
    log = log.withColumn("Content", F.lit("at 3 of 4")).withColumn("Parameters", F.expr("if(event = 'b', array('7', 'n 8'), null)"))
    got = {r["event"]: (r["severity"], r["component"], r["params"]) for r in features.parsed_fields(log).collect()}
    assert got == {"a": ("WARN", "core", [3.0, 4.0]), "b": ("FATAL", "web", [7.0, 8.0]), "c": ("UNKNOWN", "net", [3.0, 4.0])}


def test_capped_sizes_round_anomalies_first():
    for n0 in range(1, 13):
        for n1 in range(1, 13):
            for n in range(1, 28):
                got = splits.capped_sizes(n0, n1, n)
                asked = min(n, n0 + n1)
                anomalous = round(Fraction(asked * n1, n0 + n1))
                assert (got.normal, got.anomalous) == (asked - anomalous, anomalous)
                assert 0 <= got.normal <= n0 and 0 <= got.anomalous <= n1
    five = splits.capped_sizes(10, 10, 5)
    assert (five.normal, five.anomalous) == (3, 2)


def test_places_without_sorting_a_class(spark):
    rows = [(f"g{i}", i % 3 == 0) for i in range(3000)]
    labels = spark.createDataFrame([(g, int(a)) for g, a in rows], "group_id string, label int")
    want = {}
    for label in (0, 1):
        order = sorted((hashlib.md5(f"5:{g}".encode()).hexdigest(), g) for g, a in rows if a == label)
        want.update({g: k for k, (_, g) in enumerate(order)})
    placed = splits.hash_order(labels, 5)
    assert {r["group_id"]: r["place"] for r in placed.collect()} == want
    windows = re.findall(r"Window \[row_number\(\).*?\], \[(.*?)\], \[", plan_of(placed))
    assert windows and all("__bucket" in w for w in windows)


def naive_timed_gradients(model, g):
    """Loss and numeric check values of a timed model, graph by graph and edge by edge."""
    total = 0.0
    w, c = model.weights, np.asarray(model.centre)
    for k in range(len(g.sizes)):
        nodes, edges = range(g.starts[k], g.starts[k + 1]), range(g.cuts[k], g.cuts[k + 1])
        pre, end = {i: g.x[i] @ w["W1"] for i in nodes}, np.zeros(len(c))
        for j in edges:
            for layer in (1, 2):
                h = g.e[j] @ w[f"tU{layer}"]
                h = (h - h.mean()) / np.sqrt(h.var() + 1e-5)
                out = w[f"alpha{layer}"][0] * np.tanh(np.maximum(h * w[f"tgain{layer}"] + w[f"tshift{layer}"], 0) @ w[f"tV{layer}"])
                if layer == 1:
                    pre[g.dst[j]] = pre[g.dst[j]] + out
                else:
                    end = end + out / g.sizes[k]
        z = sum(g.s[i] * np.maximum(pre[i], 0) for i in nodes) @ w["W2"] + end
        total += ((z - c) ** 2).sum()
    return total


def test_edges_without_timing_go_through_the_branch_once(monkeypatch):
    """The value at zero is shared by all edges that the normalisation added; the gradients are those of all of them."""
    from dataclasses import replace

    from tracelattice.plans.training import Graphs

    rng = np.random.default_rng(4)
    sizes, n_edges = np.array([1, 3, 2, 20]), np.array([1, 6, 0, 45])
    starts, cuts = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(n_edges))
    dst = np.concatenate([rng.integers(0, n, m) for n, m in zip(sizes, n_edges)]) + np.repeat(starts[:-1], n_edges)
    e = rng.normal(size=(cuts[-1], 2))
    e[rng.random(len(e)) < 0.6] = 0
    g = Graphs(rng.normal(size=(starts[-1], 4)), rng.random(starts[-1]), starts, None, dst, e, cuts)
    model = timed.new_timed_model(4, 5, 3, alpha=0.4)
    weights = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in model.weights.items()}
    model = replace(model, weights=weights, centre=list(rng.normal(size=5)))
    widths, branch = [], timed.timing_branch
    monkeypatch.setattr(timed, "timing_branch", lambda t, p: (widths.append(len(t)), branch(t, p))[1])
    got = timed.TIMED_EDGES.gradients(model, g, True)
    assert set(widths) == {1 + e.any(axis=1).sum()}
    assert got["loss"][0] == pytest.approx(naive_timed_gradients(model, g))
    assert set(got) == {*weights, "loss"}
    for name, w in weights.items():
        for at in list(np.ndindex(w.shape))[::3]:
            up, down = ({**weights, name: w.copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            slope = (naive_timed_gradients(replace(model, weights=up), g) - naive_timed_gradients(replace(model, weights=down), g)) / 2e-6
            assert np.reshape(got[name], w.shape)[at] == pytest.approx(slope, abs=1e-5), name


def test_frozen_stages_leave_the_encoder_out():
    from tracelattice.plans.training import Graphs

    rng = np.random.default_rng(5)
    starts = np.array([0, 2, 5, 30])
    g = Graphs(rng.normal(size=(30, 4)), rng.random(30), starts, rng.normal(size=(3, 2)))
    model = O.new_model(4, 5, 3, timing_width=2, alpha=0.3)
    model.centre.extend(rng.normal(size=5))
    whole, frozen = (O.ONE_CLASS.gradients(model, g, base) for base in (True, False))
    assert set(whole) - set(frozen) == {"W1", "W2"}
    for name, v in frozen.items():
        np.testing.assert_allclose(v, whole[name])


def test_runs_and_segments_are_summed():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 40, 2, 16, 17, 3])
    starts, values = np.append(0, np.cumsum(sizes)), rng.normal(size=(79, 3))
    want = np.array([values[a:b].sum(axis=0) for a, b in zip(starts, starts[1:])])
    np.testing.assert_allclose(packed.run_sums(values, starts), want)
    keys, order = np.repeat([5, 0, 3, 7, 2, 1], sizes), rng.permutation(79)
    got = packed.segment_sums(keys[order], values[order], 9)
    np.testing.assert_allclose(got[[5, 0, 3, 7, 2, 1]], want)
    assert not got[[4, 6, 8]].any()


def test_labels_and_timing_that_come_with_the_packs(spark, tables, summary):
    """Scores and sums are those of tables joined later; the wide rows are not joined any more."""
    sizes, edges, x = tables
    model = O.new_model(4, 5, 3, timing_width=2, alpha=0.3)
    labels = spark.createDataFrame([(g, k % 2) for k, g in enumerate(SIZES)], "group_id string, label int")
    for limit in (4, packed.LIMIT):
        plain = O.encoder_tables(sizes, edges, x, limit=limit)
        whole = O.encoder_tables(sizes, edges, x, limit=limit, inner=summary, left=labels)
        some = labels.where("label = 0")
        (a,) = centred(O.train_tables(plain.where(some), summary), O.ONE_CLASS, [model])
        (b,) = centred(O.train_tables(whole.where(some, "label = 0"), summary), O.ONE_CLASS, [model])
        np.testing.assert_allclose(b.centre, a.centre)
        scores = [O.score_tables(d, a, labels, summary).drop("score_sq", "label") for d in (plain, whole)]
        same(values(scores[1], "group_id"), values(scores[0], "group_id"))
    assert scores[1]._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the labels


@pytest.mark.parametrize("width, ordered", [(2, True), (2, False), (3, False)])
def test_branch_of_runs_equals_the_dense_one(width, ordered):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(4000, width)) * rng.choice([0.2, 1.0, 30.0], size=(4000, 1))
    t[:9] *= 1e-5
    if ordered:
        t = t[np.argsort(np.arctan2(t[:, 1], t[:, 0]))]
    t[0] = 0.0
    params = propagate.init_timing(width, 60, rng)
    params = {n: w + 0.1 * rng.normal(size=np.shape(w)) for n, w in params.items()}
    branch, dense = timed.Branch(t, params), propagate.timing_branch(t, params)
    np.testing.assert_allclose(branch.out, dense[-1], atol=1e-12)
    d_out = rng.normal(size=branch.out.shape)
    want = O.timing_gradients(params, dense, d_out)
    got = branch.gradients(d_out)
    assert set(got) == set(want)
    for name in want:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9, atol=1e-9, err_msg=name)
    if ordered:  # most units are on or off throughout a run
        assert np.mean([len(units) for units in branch.changing[1:]]) < 60 / 2


def test_loss_and_second_map_follow_from_the_gram_matrix():
    """As of single graphs, from sums of several pieces."""
    from dataclasses import replace

    from tracelattice.plans.training import Graphs, add_up, gradient_sums

    rng = np.random.default_rng(8)
    model = replace(O.new_model(5, 7, 1), centre=list(rng.normal(size=7)))
    pieces = []
    for sizes in ((1, 3, 2), (4, 1)):
        n = sum(sizes)
        pieces.append(Graphs(rng.normal(size=(n, 5)), rng.random(n), np.append(0, np.cumsum(sizes))))
    local, done = gradient_sums(O.ONE_CLASS, [model], [True])
    total = {}
    for g in pieces:
        part = local(g)
        assert set(part) == {"n", "0/count", "0/r", "0/rr", "0/W1"}  # no product of graphs and the second map
        add_up(total, part)
    got, want = done(total), {}
    for g in pieces:
        pre = g.x @ model.weights["W1"]
        r = np.add.reduceat(np.maximum(pre, 0) * g.s[:, None], g.starts[:-1])
        sums = O.graph_gradients(r, None, model)
        grad_r = np.repeat(sums.pop("r"), g.sizes, axis=0)
        add_up(want, {**sums, "W1": g.x.T @ (g.s[:, None] * (pre > 0) * grad_r), "n": np.array([float(len(g.sizes))])})
    assert {k.split("/")[-1] for k in got} == set(want)
    for k, v in got.items():
        np.testing.assert_allclose(v, want[k.split("/")[-1]], rtol=1e-10, atol=1e-10)


def test_tanh_by_the_exponential():
    x = np.concatenate([np.linspace(-40, 40, 4001), [0.0, 1e-9, -1e-9, 800.0, -800.0]])
    np.testing.assert_allclose(propagate.tanh(x), np.tanh(x), atol=1e-15, rtol=0)
