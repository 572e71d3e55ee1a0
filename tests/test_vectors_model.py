"""Message passing, encoders, features, text vectors and training against numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelattice.operators import adjacency, features, graphs, propagate, text
from tracelattice.plans import oneclass as O

RNG = np.random.default_rng(3)
SIZES = {"a": 4, "b": 2, "c": 3}
ADJ = {g: np.abs(RNG.normal(size=(n, n))) * (RNG.random((n, n)) < 0.7) + np.eye(n) for g, n in SIZES.items()}
X = {g: RNG.normal(size=(n, 5)) for g, n in SIZES.items()}
W1, W2 = RNG.normal(size=(5, 6)), RNG.normal(size=(6, 6))


@pytest.fixture(scope="module")
def adj(spark):
    rows = [(g, i, j, float(m[i, j])) for g, m in ADJ.items() for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame([(g, int(i), int(j), w) for g, i, j, w in rows], "group_id string, src int, dst int, w double")


@pytest.fixture(scope="module")
def x(spark):
    rows = [(g, i, [float(v) for v in m[i]]) for g, m in X.items() for i in range(len(m))]
    return spark.createDataFrame(rows, "group_id string, node_id int, x array<double>")


def by_group(df, column="z"):
    return {r["group_id"]: np.array(r[column]) for r in df.collect()}


def relu(v):
    return np.maximum(v, 0)


def test_propagate_and_pools(adj, x):
    got = {(r["group_id"], r["node_id"]): r["x"] for r in propagate.propagate(adj, x).collect()}
    for g in SIZES:
        want = ADJ[g].T @ X[g]
        for i in range(SIZES[g]):
            np.testing.assert_allclose(got[g, i], want[i])
    for how, fn in (("mean", np.mean), ("sum", np.sum), ("max", np.max)):
        pooled = by_group(propagate.pool(x, how))
        for g in SIZES:
            np.testing.assert_allclose(pooled[g], fn(X[g], axis=0))
    with pytest.raises(ValueError):
        propagate.pool(x, "median")
    importance = {(r["group_id"], r["node_id"]): r["importance"] for r in propagate.node_importance(x).collect()}
    assert importance["b", 0] == pytest.approx(np.linalg.norm(X["b"][0] - X["b"].mean(axis=0)))


def test_encoders(adj, x):
    two, one = by_group(propagate.encode(adj, x, W1, W2)), by_group(propagate.encode(adj, x, W1, W2, layers=1))
    for g in SIZES:
        a = ADJ[g].T
        h = relu(a @ X[g] @ W1)
        np.testing.assert_allclose(two[g], (a @ h @ W2).mean(axis=0))
        np.testing.assert_allclose(one[g], h.mean(axis=0) @ W2)


def test_inception(adj, x):
    blocks = [{"W0": W1, "W1": W1 * 2, "W2": W1 - 1, "b0": np.ones(6)}, {"W0": W2, "W1": W2 + 1, "W2": W2}]
    out = propagate.encode_inception(adj, adj, x, blocks)
    got = {(r["group_id"], r["node_id"]): r["x"] for r in out.collect()}
    for g in SIZES:
        a, h = ADJ[g].T, X[g]
        for b in blocks:
            h = h @ b["W0"] + b.get("b0", 0) + a @ h @ b["W1"] + a @ h @ b["W2"]
        for i in range(SIZES[g]):
            np.testing.assert_allclose(got[g, i], h[i])


def test_inception_packed_and_joined(spark):
    """A node reached by edges alone, a node of two rows, a graph without edges, different orders; packed graphs take no join."""
    edge, node = "group_id string, src int, dst int, w double", "group_id string, node_id int, x array<double>"
    first = spark.createDataFrame([("p", 0, 1, 0.5), ("p", 1, 2, 2.0), ("p", 0, 0, 0.0), ("q", 0, 0, 1.0)], edge)
    second = spark.createDataFrame([("p", 2, 0, 1.5), ("p", 1, 1, 1.0), ("r", 0, 0, 1.0)], edge)
    x = spark.createDataFrame([("p", 0, [1.0, 2.0, 3.0]), ("p", 0, [0.5, 0.0, 1.0]), ("p", 1, [0.0, -1.0, 1.0]), ("q", 0, [1.0, 1.0, 1.0]), ("s", 0, [2.0, 0.0, 0.0])], node)
    rng = np.random.default_rng(1)
    blocks = [{n: rng.normal(size=s) for n in ("W0", "W1", "W2")} for s in ((3, 4), (4, 2), (2, 2))]
    blocks[0]["b0"] = rng.normal(size=4)
    results = []
    for limit in (propagate.INCEPTION_LIMIT, 4, 0):
        out = propagate.encode_inception(first, second, x, blocks, limit)
        results.append({(r["group_id"], r["node_id"]): r["x"] for r in out.collect()})
        if limit == propagate.INCEPTION_LIMIT:
            assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert set(results[0]) == {("p", 0), ("p", 1), ("p", 2), ("q", 0), ("s", 0)}
    for other in results[1:]:
        assert set(other) == set(results[0])
        for key, value in other.items():
            np.testing.assert_allclose(results[0][key], value)


def branch(t, p):
    h = t @ p["U"]
    h = (h - h.mean(axis=-1, keepdims=True)) / np.sqrt(h.var(axis=-1, keepdims=True) + 1e-5)
    return np.tanh(relu(h * p["gain"] + p["shift"]) @ p["V"])


def test_timed_messages(spark, adj, x):
    params = propagate.init_timing(2, 5, np.random.default_rng(0))
    timing = {("a", 0, 0): [1.0, -0.5], ("c", 2, 2): [0.3, 2.0]}
    t = spark.createDataFrame([(*k, v) for k, v in timing.items()], "group_id string, src int, dst int, t array<double>")
    got = {(r["group_id"], r["node_id"]): r["x"] for r in propagate.propagate_timed(adj, x, t, params, 0.05).collect()}
    for g in SIZES:
        want = np.zeros((SIZES[g], 5))
        for i, j in zip(*np.nonzero(ADJ[g])):
            stats = np.array([timing.get((g, i, j), [0.0, 0.0])])
            want[j] += ADJ[g][i, j] * X[g][i] + 0.05 * branch(stats, params)[0]
        for i in range(SIZES[g]):
            np.testing.assert_allclose(got[g, i], want[i])


def model_with(weights, alpha, c):
    return replace(O.new_model(5, 6, 1, timing_width=2, alpha=alpha), weights=weights, centre=list(c))


def test_gradients_match_finite_differences(spark, adj, x):
    rows = adjacency.cut_lineage(propagate.encoder_rows(adj, x))
    t = {g: RNG.normal(size=2) for g in SIZES}
    summary = spark.createDataFrame([(g, [float(v) for v in r]) for g, r in t.items()], "group_id string, t array<double>")
    base = O.new_model(5, 6, 1, timing_width=2, alpha=0.3)
    weights = {k: w + 0.1 * RNG.normal(size=w.shape) for k, w in base.weights.items()}
    c = RNG.normal(size=6)

    def loss(weights, alpha):
        total = 0.0
        for g in SIZES:
            a = ADJ[g].T
            z = (a @ relu(a @ X[g] @ weights["W1"]) @ weights["W2"]).mean(axis=0) + alpha * branch(t[g][None], weights)[0]
            total += ((z - c) ** 2).sum()
        return total / len(SIZES)

    value, grads = O.gradients(rows, model_with(weights, 0.3, c), len(SIZES), summary, True)
    assert value == pytest.approx(loss(weights, 0.3))
    step = 1e-6
    for name, w in weights.items():
        for at in list(np.ndindex(w.shape))[::5]:
            up, down = ({**weights, name: w.copy()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            assert grads[name][at] == pytest.approx((loss(up, 0.3) - loss(down, 0.3)) / (2 * step), abs=1e-6)
    assert grads["alpha"] == pytest.approx((loss(weights, 0.3 + step) - loss(weights, 0.3 - step)) / (2 * step), abs=1e-6)


def test_training_lowers_the_loss(spark, adj, x):
    rows = propagate.encoder_rows(adj, x)
    model, history = O.fit_one_class(rows, O.new_model(5, 6, 1), [O.Stage(6, 0.02)], warmup=2)
    assert history[-1][1] < history[0][1] and [e for e, _ in history] == list(range(1, 7))
    scored = O.score(rows, model, spark.createDataFrame([("a", 1)], "group_id string, label int")).collect()
    assert {r["group_id"]: r["label"] for r in scored} == {"a": 1, "b": None, "c": None}
    frozen, _ = O.fit_one_class(
        rows, O.new_model(5, 6, 1, timing_width=2), O.staged(2, 2),
        summary=spark.createDataFrame([(g, [0.1, 0.2]) for g in SIZES], "group_id string, t array<double>"),
    )
    start = O.new_model(5, 6, 1, timing_width=2).weights
    np.testing.assert_array_equal(frozen.weights["W1"], start["W1"])
    assert not np.array_equal(frozen.weights["V"], start["V"])


def test_grid(x, adj):
    points = O.grid(lr=[0.01, 0.02], seed=[0], hidden=[4])
    models, table = O.run_grid(adj, x, 5, points, 2)
    assert len(models) == 2 and table.count() == 4


def test_grid_over_layers(x, adj):
    _, table = O.run_grid(adj, x, 5, O.grid(layers=[1, 2], seed=[0], hidden=[4]), 2)
    losses = {(r["config"], r["epoch"]): r["loss"] for r in table.collect()}
    one, two = (losses[f"layers={n},seed=0,hidden=4", 1] for n in (1, 2))
    assert abs(one - two) > 1e-9
    for n, loss in ((1, one), (2, two)):
        _, alone = O.fit_one_class(propagate.encoder_rows(adj, x, n), O.new_model(5, 4, 0, layers=n), [O.Stage(2, 0.01)], 1e-4)
        assert alone[0][1] == pytest.approx(loss)


def test_node_features_match_numpy(spark):
    rows = [("g", 0, "a", "disk 1 and 3", "INFO"), ("g", 1, "b", "mem 5", "WARN"), ("g", 2, "a", "disk 2", "ERROR"),
            ("g", 3, "a", "none", "ERROR"), ("h", 0, "b", "mem -2", None)]
    log = spark.createDataFrame(rows, "group_id string, seq bigint, event string, message string, level string")
    step = graphs.steps(features.parsed_fields(log), ts=None, carry=("severity", "component", "params"))
    got = {(r["group_id"], r["event"]): r["stats"] for r in features.node_statistics(step).collect()}
    a = got["g", "a"]
    assert len(a) == 46 and a[4] == 1.0 and sum(a[:7]) == 1 and sum(a[7:39]) == 1
    nums = np.array([1.0, 3.0, 2.0])
    want = [3 / 4, 0, 3 / 4, *np.log1p([nums.mean(), nums.std(), 1, 3])]
    assert a[39:] == pytest.approx(want)
    assert got["h", "b"][39:] == pytest.approx([1, 0, 0, -np.log1p(2), 0, -np.log1p(2), -np.log1p(2)])
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [3.0, 0.5])], "event string, vec array<double>")
    x = {(r["group_id"], r["event"]): r["x"] for r in features.node_features(step, vectors).collect()}
    assert x["g", "a"][:2] == pytest.approx([-1.0, 0.0]) and x["h", "b"][:2] == [3.0, 0.5]
    with pytest.raises(Exception, match="no vector"):
        features.node_features(step, vectors.where("event = 'a'")).collect()


def test_tfidf_and_svd_match_numpy(spark):
    docs = ["disk disk failed", "the disk works", "memory failed again again", "network failed network", "12 !!"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, text string")
    weights = text.tfidf(df, "k", stop=["the"])
    terms = ["again", "disk", "failed", "memory", "network", "works"]
    tf = np.array([[d.split().count(t) for t in terms] for d in docs], dtype=float)
    m = tf * (np.log((1 + len(docs)) / (1 + (tf > 0).sum(axis=0))) + 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(norm == 0, 1, norm)
    got = np.zeros_like(m)
    for r in weights.collect():
        got[r["k"], terms.index(r["term"])] = r["weight"]
    np.testing.assert_allclose(got, m)
    assert {r["term"] for r in text.tfidf(df, "k", size=2, stop=["the"]).collect()} == {"disk", "failed"}

    u, s, vt = np.linalg.svd(m)
    out = text.svd_embedding(weights, df, "k", 2, rounds=25)
    vec = np.array([r["vec"] for r in out.orderBy("k").collect()])
    want = m @ vt[:2].T
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(length < 1e-9, 1, length)
    mask = (length > 1e-6).ravel()
    np.testing.assert_allclose(np.abs(vec[mask]), np.abs(want[mask]), atol=1e-5)
    assert list(vec[4]) == [0.0, 0.0]


def test_timed_gradients_and_training(spark, adj, x):
    from tracelattice.plans import timed

    rng = np.random.default_rng(11)
    stats = {(g, int(i), int(j)): rng.normal(size=2) for g, m in ADJ.items() for i, j in zip(*np.nonzero(m))}
    known = {k: v for n, (k, v) in enumerate(stats.items()) if n % 3}
    timing = spark.createDataFrame([(*k, [float(a) for a in v]) for k, v in known.items()], "group_id string, src int, dst int, t array<double>")
    edges = adjacency.cut_lineage(propagate.with_edge_stats(adj, timing))
    rows = adjacency.cut_lineage(propagate.encoder_rows(adj, x))
    model = timed.new_timed_model(5, 6, 2, alpha=0.4)
    model = replace(
        model, weights={k: w + 0.1 * rng.normal(size=w.shape) for k, w in model.weights.items()}, centre=list(rng.normal(size=6))
    )

    def vectors(weights):
        out = {}
        for g, m in ADJ.items():
            pre, total = m.T @ X[g] @ weights["W1"], np.zeros(6)
            for i, j in zip(*np.nonzero(m)):
                t = np.array([known.get((g, int(i), int(j)), np.zeros(2))])
                pre[j] += weights["alpha1"][0] * branch(t, {k: weights[f"t{k}1"] for k in ("U", "gain", "shift", "V")})[0]
                total += weights["alpha2"][0] * branch(t, {k: weights[f"t{k}2"] for k in ("U", "gain", "shift", "V")})[0]
            out[g] = ((m.T @ relu(pre) @ weights["W2"]).sum(axis=0) + total) / SIZES[g]
        return out

    def loss(weights):
        return sum(((z - np.array(model.centre)) ** 2).sum() for z in vectors(weights).values()) / len(SIZES)

    got = by_group(timed.timed_vectors(rows, edges, model))
    for g, z in vectors(model.weights).items():
        np.testing.assert_allclose(got[g], z)
    # The same encoder written as two timed message steps.
    layers = [{"W": model.weights[f"W{k}"], **{n: model.weights[f"t{n}{k}"] for n in ("U", "gain", "shift", "V")}} for k in (1, 2)]
    same_alpha = replace(model, weights={**model.weights, "alpha1": np.array([0.4]), "alpha2": np.array([0.4])})
    steps, packed = by_group(propagate.encode_timed(adj, x, timing, layers, 0.4)), by_group(timed.timed_vectors(rows, edges, same_alpha))
    for g in SIZES:
        np.testing.assert_allclose(steps[g], packed[g])

    value, grads = timed.timed_gradients(rows, edges, model, len(SIZES))
    assert value == pytest.approx(loss(model.weights))
    assert set(grads) == set(model.weights)
    step = 1e-6
    for name, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[::7]:
            up, down = ({**model.weights, name: w.copy()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=1e-6), name

    fitted, history = timed.fit_timed(rows, edges, timed.new_timed_model(5, 6, 2), O.staged(4, 2, 0.05, 0.01))
    assert history[-1][1] < history[0][1]
    assert timed.timed_score(rows, edges, fitted).count() == len(SIZES)


def test_term_counts_are_stored_compressed(spark):
    texts = spark.createDataFrame([(1, "red blue red"), (2, "blue"), (None, "blue green"), (3, None)], "id long, text string")
    weights = text.tfidf(texts, "id", stop=())
    assert weights.inputFiles() and all(f.endswith(".parquet") for f in weights.inputFiles())
    idf = {"red": np.log(5 / 2) + 1, "blue": np.log(5 / 4) + 1}
    length = np.hypot(2 * idf["red"], idf["blue"])
    want = {(1, "red"): 2 * idf["red"] / length, (1, "blue"): idf["blue"] / length, (2, "blue"): 1.0}
    got = {(r.id, r.term): r.weight for r in weights.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_weights_of_the_projection_are_stored_compressed(spark):
    rows = [(1, "a", 0.6), (1, "b", 0.8), (2, "a", 1.0)]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    texts = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    out = text.svd_embedding(weights, texts, "id", 1, rounds=1)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    assert {r.id: [round(abs(v), 6) for v in r.vec] for r in out.collect()} == {1: [1.0], 2: [1.0], 3: [0.0]}


def test_projection_by_blocks_keeps_one_round_on_disk(spark, monkeypatch):
    """Blocks of one or two texts, terms in one and in many of them; a text without key takes no part."""
    import os

    monkeypatch.setattr(text, "BLOCK_WEIGHTS", 4)
    rng = np.random.default_rng(4)
    m = np.where(rng.random((9, 12)) < 0.4, rng.random((9, 12)), 0.0)
    rows = [(int(i), f"t{j:02}", float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(None, "t00", 5.0), (None, "other", 7.0)]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    texts = spark.createDataFrame([(i,) for i in [*range(9), 3, None]], "id long")
    adjacency.cut_lineage(texts)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = text.svd_embedding(weights, texts, "id", 3, rounds=4).collect()
    assert len(set(os.listdir(folder)) - before) == 2  # the blocks and the last round
    values = np.linalg.svd(m)
    basis = values[2][:3].T
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), range(3)])
    want = m @ basis
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    assert len(out) == 11 and all(r.vec == [0.0] * 3 for r in out if r.id is None)
    got = np.array([r.vec for r in sorted((r for r in out if r.id is not None), key=lambda r: r.id)])
    np.testing.assert_allclose(got, want[sorted([*range(9), 3])], atol=1e-6)
