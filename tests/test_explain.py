import itertools
import random

import pytest

from tracelattice.operators import explain as X

NODES = [("g", "spark", 2.0), ("g", "smoke", 5.0), ("g", "fire", 8.0), ("g", "moth", 0.5)]
EDGES = [("g", "spark", "smoke", 4.0), ("g", "smoke", "fire", 3.0), ("g", "moth", "fire", 2.0)]
NODE = "group_id string, node string, importance double"
EDGE = "group_id string, src string, dst string, weight double"


def test_subgraph_keeps_directed_weighted_edges(spark):
    nodes, edges = X.influential_subgraph(spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, EDGE), 3)
    kept = {r["node"]: r["importance"] for r in nodes.collect()}
    assert set(kept) == {"spark", "smoke", "fire"} and kept["fire"] == 1.0
    weights = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    assert weights == {("spark", "smoke"): 4.0, ("smoke", "fire"): 3.0}
    with pytest.raises(ValueError):
        X.influential_subgraph(nodes, edges, 0)


def brute_force(nodes, edges, hops):
    """Root scores and chains of one group by plain enumeration."""
    importance = {n: v / max(nodes.values()) for n, v in nodes.items()}
    top = max(edges.values())
    conf = {(s, d): min(1.0, 0.55 * w / top + 0.25 + 0.2 * importance[d]) for (s, d), w in edges.items()}
    paths = []
    for length in range(2, hops + 2):
        for p in itertools.permutations(nodes, length):
            if all(step in conf for step in zip(p, p[1:])):
                product = 1.0
                for step in zip(p, p[1:]):
                    product *= conf[step]
                paths.append((p, product * importance[p[-1]]))
    raw = {}
    for n in nodes:
        indegree = sum(d == n for _, d in conf)
        raw[n] = (importance[n] + sum(v for p, v in paths if p[0] == n)) / (1 + indegree)
    score = {n: v / max(raw.values()) for n, v in raw.items()}
    return score, {p: v * score[p[0]] for p, v in paths if v * score[p[0]] > 0}


def test_random_graphs_match_brute_force(spark):
    rng = random.Random(5)
    nodes, edges = [], []
    for g in ("p", "q", "r"):
        names = [f"{g}{i}" for i in range(5)]
        nodes += [(g, n, float(rng.randrange(5))) for n in names[:-1]] + [(g, names[-1], 4.0)]
        edges += [(g, a, b, float(rng.randrange(1, 9))) for a in names for b in names if rng.random() < 0.5]
    got = X.root_causes(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), 10, 3, 1000)
    roots, chains = got.roots.collect(), got.chains.collect()
    for g in ("p", "q", "r"):
        score, want = brute_force(
            {n: v for k, n, v in nodes if k == g}, {(s, d): w for k, s, d, w in edges if k == g}, 3
        )
        assert {r["node"]: r["score"] for r in roots if r["group_id"] == g} == pytest.approx(score)
        assert {tuple(r["path"]): r["confidence"] for r in chains if r["group_id"] == g} == pytest.approx(want)


def test_paths_are_all_simple_ones(spark):
    rng = random.Random(8)
    rows = [("g", f"n{a}", f"n{b}", rng.random(), rng.random()) for a in range(6) for b in range(6) if rng.random() < 0.6]
    conf = {(s, d): c for _, s, d, c, _ in rows}
    cedges = spark.createDataFrame(rows, "group_id string, src string, dst string, confidence double, target_importance double")
    for hops in (1, 2, 4):
        got = {tuple(r["path"]): r["confidence"] for r in X.simple_paths(cedges, hops).collect()}
        want = {}
        for length in range(2, hops + 2):
            for p in itertools.permutations([f"n{k}" for k in range(6)], length):
                if all(step in conf for step in zip(p, p[1:])):
                    want[p] = 1.0
                    for step in zip(p, p[1:]):
                        want[p] *= conf[step]
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        X.simple_paths(cedges, 0)


def test_order_of_times_counts(spark):
    nodes = spark.createDataFrame([("g", "a", 1.0, "5"), ("g", "b", 1.0, "2"), ("g", "c", 1.0, "x")], NODE + ", ts string")
    edges = spark.createDataFrame([("g", "a", "b", 2.0), ("g", "b", "a", 2.0), ("g", "a", "c", -1.0)], EDGE)
    got = {(r["src"], r["dst"]): r["confidence"] for r in X.causal_edges(nodes, edges).collect()}
    assert got == pytest.approx({("a", "b"): 0.55 + 0.0125 + 0.2, ("b", "a"): 1.0, ("a", "c"): 0.45})


def test_queries_of_paths_start_from_stored_subgraphs(spark, tmp_path):
    """Graphs are cut out and explained in stages of their own: no window but the rank stands in the plans of the explanations."""
    from tracelattice.plans import queries as Q

    log = [(i, f"2024-01-0{1 + i % 3} 00:0{i % 10}:{i % 60:02d}", i % 4, ("view", "error", "click")[i * i % 3]) for i in range(60)]
    rows = spark.createDataFrame(log, "event_id long, ts string, user_id long, event_type string")
    rows = rows.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "0d value", "'{}' props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    nodes, edges = X.influential_subgraph(*Q.anomalous_graphs(spark, str(tmp_path)), Q.TOP_K)
    want = X.causal_edges(nodes, edges)
    paths = Q.simple_paths(spark, str(tmp_path))
    ranked = Q.causal_edges(spark, str(tmp_path))
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 0
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    expected = {(r["group_id"], r["src"], r["dst"]): r["confidence"] for r in want.collect()}
    got = {(r["group_id"], r["src"], r["dst"]): r["confidence"] for r in ranked.collect()}
    assert got == pytest.approx(expected, abs=1e-6) and len(got) > 3
    wanted = {(r["group_id"], ">".join(r["path"])): r["confidence"] for r in X.simple_paths(want, Q.MAX_HOPS).collect()}
    assert {(r["group_id"], r["path"]): r["confidence"] for r in paths.collect()} == pytest.approx(wanted, abs=1e-6)
