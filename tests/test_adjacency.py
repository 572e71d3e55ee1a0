import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelattice.operators import adjacency as A

EDGES = [
    ("a", 0, 1, 3.0), ("a", 1, 2, 1.0), ("a", 2, 0, 2.0), ("a", 0, 0, 1.0), ("b", 0, 1, 1.0),
    ("c", 0, 1, 2.0), ("c", 1, 3, 1.0), ("c", 3, 4, 5.0), ("c", 2, 1, 1.0),
]
SIZES = {"a": 3, "b": 2, "c": 5, "lonely": 1}


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.createDataFrame(EDGES, "group_id string, src int, dst int, w double")
    nodes = spark.createDataFrame([(g, i) for g, n in SIZES.items() for i in range(n)], "group_id string, node_id int")
    return edges, nodes


def matrices():
    out = {g: np.zeros((n, n)) for g, n in SIZES.items()}
    for g, i, j, w in EDGES:
        out[g][i, j] += w
    return out


def transition(a):
    full = a + np.eye(len(a))
    return full / full.sum(axis=1, keepdims=True)


def stationary(p, alpha=0.1):
    n = len(p)
    return np.linalg.solve((np.eye(n) - (1 - alpha) * p).T, np.full(n, alpha / n))


def sym_norm(m):
    d = m.sum(axis=1)
    return m / np.sqrt(np.outer(d, d))


def balanced(p, pi):
    s = np.sqrt(pi)
    return sym_norm((s[:, None] * p / s[None, :] + (s[:, None] * p / s[None, :]).T) / 2)


def dense(df):
    out = {g: np.zeros((n, n)) for g, n in SIZES.items()}
    for r in df.collect():
        assert out[r["group_id"]][r["src"], r["dst"]] == 0
        out[r["group_id"]][r["src"], r["dst"]] = r["w"]
    return out


def check(df, expected, tolerance=1e-4):
    got = dense(df)
    for g, m in matrices().items():
        np.testing.assert_allclose(got[g], expected(m), atol=tolerance)


def test_transition_rows_sum_to_one(tables):
    for g, m in dense(A.transition_matrix(*tables).withColumnRenamed("p", "w")).items():
        np.testing.assert_allclose(m, transition(matrices()[g]))


@pytest.mark.parametrize("small", [1, 4, 2048])
def test_pagerank_matches_the_linear_solve(tables, small):
    pi = {}
    for r in A.pagerank(A.transition_matrix(*tables), small_edges=small).collect():
        pi.setdefault(r["group_id"], {})[r["node_id"]] = r["pi"]
    for g, m in matrices().items():
        got = [pi[g][i] for i in range(SIZES[g])]
        assert sum(got) == pytest.approx(1.0)
        np.testing.assert_allclose(got, stationary(transition(m)), atol=5e-5)


@pytest.mark.parametrize("small", [1, 5, 2048])
def test_ppr_packed_and_joined(tables, small):
    def expected(m):
        p = transition(m)
        return balanced(p, stationary(p))

    out = A.norm_ppr(*tables, small_edges=small)
    check(out, expected)
    for m in dense(out).values():
        np.testing.assert_allclose(m, m.T)


def test_packed_and_joined_agree_exactly(tables):
    a, b = dense(A.norm_ppr(*tables)), dense(A.norm_ppr(*tables, small_edges=1))
    for g in SIZES:
        np.testing.assert_allclose(a[g], b[g], rtol=1e-12)


def test_full_pagerank(tables):
    def expected(m):
        p = transition(m)
        return balanced(0.9 * p + 0.1 / len(p), stationary(p))

    check(A.norm_pr(*tables), expected)


def test_undirected(tables):
    def expected(m):
        both = ((m + m.T) > 0).astype(float)
        return sym_norm(both + np.eye(len(m)))

    check(A.norm_undirected(*tables), expected, 1e-12)


def test_second_order(tables):
    first = A.norm_ppr(*tables)

    def expected(m):
        p1 = transition(m)
        p = transition(balanced(p1, stationary(p1)))
        inward, outward = p.T @ p, p @ p.T
        return sym_norm((inward + outward) / 2 * ((inward != 0) & (outward != 0)))

    check(A.norm_second_order(first, tables[1]), expected)


def test_modes_and_self_loops(tables):
    assert set(r["ord"] for r in A.normalise(*tables, mode="ib").collect()) == {1, 2}
    assert A.add_self_loops(*tables).count() == len(EDGES) + sum(SIZES.values())
    with pytest.raises(ValueError):
        A.normalise(*tables, mode="x")


@pytest.mark.parametrize("small", [1, 5, 2048])
def test_first_and_second_order_packed_and_joined(tables, small):
    both = A.normalise(*tables, mode="ib", small_edges=small)
    first = dense(A.norm_ppr(*tables))
    second = dense(A.norm_second_order(A.norm_ppr(*tables), tables[1]))
    for order, want in ((1, first), (2, second)):
        got = dense(both.where(f"ord = {order}").drop("ord"))
        assert got.keys() == want.keys()
        for g in want:
            np.testing.assert_allclose(got[g], want[g], atol=1e-12)


def test_second_order_of_directed_graphs(spark):
    """Graphs where the two kinds of pairs differ: a star outwards, one inwards, and a random one."""
    rng = np.random.default_rng(9)
    edges = [("out", 0, i) for i in range(1, 30)] + [("in", i, 0) for i in range(1, 30)]
    edges += [("mixed", int(i), int(j)) for i, j in {tuple(e) for e in rng.integers(0, 12, (40, 2)).tolist()}]
    sizes = {"out": 30, "in": 30, "mixed": 12}
    adj = spark.createDataFrame([(g, i, j, 1.0 + (i + j) % 3) for g, i, j in edges], "group_id string, src int, dst int, w double")
    nodes = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "group_id string, node_id int")
    got = {}
    for r in A.norm_second_order(adj, nodes).collect():
        got.setdefault(r["group_id"], np.zeros((sizes[r["group_id"]],) * 2))[r["src"], r["dst"]] = r["w"]
    for g, n in sizes.items():
        m = np.eye(n)
        for h, i, j in edges:
            if h == g:
                m[i, j] += 1.0 + (i + j) % 3
        p = m / m.sum(axis=1, keepdims=True)
        inward, outward = p.T @ p, p @ p.T
        want = sym_norm((inward + outward) / 2 * ((inward != 0) & (outward != 0)))
        np.testing.assert_allclose(got[g], want, atol=1e-12)


@pytest.mark.parametrize("small", [0, 12, 2048])
def test_second_order_by_size(tables, small):
    """Small graphs give their second order in a task, without the joins of large ones."""
    first = A.norm_ppr(*tables).localCheckpoint()
    got = A.norm_second_order(first, tables[1], small)
    want, dense_got = dense(A._second_by_joins(first, tables[1])), dense(got)
    assert dense_got.keys() == want.keys()
    for g in want:
        np.testing.assert_allclose(dense_got[g], want[g], atol=1e-12)
    if small == 2048:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_second_order_of_a_large_star(spark):
    """A hub of 100,000 leaves: its square is never written out."""
    leaves = 100_000
    adj = spark.range(1, leaves + 1).selectExpr("'s' group_id", "0 src", "cast(id as int) dst", "1d w")
    nodes = spark.range(leaves + 1).selectExpr("'s' group_id", "cast(id as int) node_id")
    got = A.norm_second_order(adj, nodes)
    assert got.count() == 3 * leaves + 1  # every node with itself, the hub with every leaf both ways
    assert got.where("src <> dst and src <> 0 and dst <> 0").isEmpty()


def test_factors_of_full_pagerank(tables):
    sparse, factors = A.pr_factors(*tables)
    rows, full = dense(sparse), dense(A.norm_pr(*tables))
    for g, want in full.items():
        f = {r["node_id"]: r for r in factors.where(F.col("group_id") == g).collect()}
        a, b = (np.array([f[i][k] for i in range(SIZES[g])]) for k in ("a", "b"))
        got = rows[g] + f[0]["c"] * (np.outer(a, b) + np.outer(b, a))
        np.testing.assert_allclose(got, want, atol=1e-12)
