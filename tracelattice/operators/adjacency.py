"""Normalised adjacency of all graphs at once.

``edges``: group_id, src, dst, w. ``nodes``: group_id, node_id. Results: group_id, src, dst, w.
The transition matrix is ``P = D^-1 (A + I)``; a self-loop of weight 1 comes on top of an existing one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.operators.checks import fail_if_any
from tracelattice.operators.graphs import GROUP
from tracelattice.session import cut_lineage, spread

ALPHA = 0.1
# Rounds end when no node moves by more than the tolerance; 0.9 ** 300 is far below it.
ITERATIONS, TOLERANCE = 300, 1e-15

SMALL_EDGES = 2048
"""Graphs up to this size are worked on inside a task, many at a time; larger ones by joins."""

GRAPHS_PER_STEP = 512
"""Graphs that one vectorised step holds at a time."""

CHECKPOINT_EVERY = 10


def collapse(edges: DataFrame) -> DataFrame:
    """Parallel edges summed."""
    return edges.groupBy(GROUP, "src", "dst").agg(F.sum("w").alias("w"))


def degree(edges: DataFrame) -> DataFrame:
    """Sum of outgoing weights per node."""
    return edges.groupBy(GROUP, "src").agg(F.sum("w").alias("deg"))


def self_loops(nodes: DataFrame) -> DataFrame:
    return nodes.select(GROUP, F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("w"))


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One more edge of weight 1 from every node to itself; weights are otherwise kept."""
    return edges.select(GROUP, "src", "dst", F.col("w").cast("double").alias("w")).unionByName(self_loops(nodes))


def transition_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``D^-1 (A + I)`` as group_id, src, dst, p."""
    full = collapse(add_self_loops(edges, nodes))
    return full.join(degree(full), [GROUP, "src"]).select(GROUP, "src", "dst", (F.col("w") / F.col("deg")).alias("p"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """``(A + A^T) / 2``."""
    back = edges.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return collapse(edges.select(GROUP, "src", "dst", "w").unionByName(back)).withColumn("w", F.col("w") / 2)


def degree_normalised(edges: DataFrame) -> DataFrame:
    """``D^-1/2 A D^-1/2``; a node of degree 0 gives 0. The input is stored, as it is read three times."""
    edges = cut_lineage(edges)
    deg = degree(edges).select(GROUP, F.col("src").alias("node_id"), "deg")
    root = F.sqrt(F.col("deg_src") * F.col("deg_dst"))
    return (
        edges.join(deg.select(GROUP, F.col("node_id").alias("src"), F.col("deg").alias("deg_src")), [GROUP, "src"])
        .join(deg.select(GROUP, F.col("node_id").alias("dst"), F.col("deg").alias("deg_dst")), [GROUP, "dst"])
        .select(GROUP, "src", "dst", F.when(root > 0, F.col("w") / root).otherwise(0.0).alias("w"))
    )


def _flat(n_nodes: pd.Series, *lists: pd.Series) -> tuple[np.ndarray, ...]:
    """Graphs laid side by side: first node of each graph, shifted sources and targets, weights."""
    src, dst, weight = lists
    starts = np.concatenate(([0], np.cumsum(n_nodes.to_numpy(dtype=np.int64))))
    shift = np.repeat(starts[:-1], [len(a) for a in src])
    rows, cols = (np.concatenate(part.to_list()).astype(np.int64) + shift for part in (src, dst))
    return starts, rows, cols, np.concatenate(weight.to_list())


def _power_rounds(starts: np.ndarray, rows, cols, p, alpha: float, iterations: int) -> np.ndarray:
    n = np.diff(starts)
    base = np.repeat(1.0 / n, n)
    pi = base
    for _ in range(iterations):
        before, pi = pi, (1 - alpha) * np.bincount(cols, p * pi[rows], minlength=len(pi)) + alpha * base
        if np.max(np.abs(pi - before), initial=0.0) <= TOLERANCE:
            break
    return pi


def summed_entries(rows: np.ndarray, cols: np.ndarray, w: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
    """Entries of a sparse matrix sorted by row and column, repeated ones added up."""
    keys, place = np.unique(rows * total + cols, return_inverse=True)
    return keys // total, keys % total, np.bincount(place, w, minlength=len(keys))


def balanced_entries(starts: np.ndarray, rows, cols, weight, alpha: float, iterations: int) -> tuple[np.ndarray, ...]:
    """Graphs laid side by side, normalised by personalised PageRank: rows, columns and weights, sorted."""
    total, loops = starts[-1], np.arange(starts[-1])
    rows, cols, weight = summed_entries(
        np.append(rows, loops), np.append(cols, loops), np.append(weight, np.ones(total)), total
    )
    p = weight / np.bincount(rows, weight, minlength=total)[rows]
    pi = _power_rounds(starts, rows, cols, p, alpha, iterations)
    half = np.sqrt(pi[rows] / pi[cols]) * p / 2
    rows, cols, weight = summed_entries(np.append(rows, cols), np.append(cols, rows), np.append(half, half), total)
    degree = np.bincount(rows, weight, minlength=total)
    return rows, cols, weight / np.sqrt(degree[rows] * degree[cols])


def _wedges(mid: np.ndarray, end: np.ndarray, p: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of ends that share a middle node the summed products of their entries: keys end * total + end, values."""
    order = np.argsort(mid, kind="stable")
    mid, end, p = mid[order], end[order], p[order]
    first, many = (np.searchsorted(mid, mid, side) for side in ("left", "right"))
    many = many - first
    one = np.repeat(np.arange(len(mid)), many)
    other = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + first[one]
    keys, place = np.unique(end[one] * total + end[other], return_inverse=True)
    return keys, np.bincount(place, p[one] * p[other], minlength=len(keys))


def second_entries(total: int, rows, cols, weight) -> tuple[np.ndarray, ...]:
    """Second-order proximity of graphs laid side by side with ``total`` nodes, see :func:`norm_second_order`."""
    loops = np.arange(total)
    rows, cols, weight = summed_entries(np.append(rows, loops), np.append(cols, loops), np.append(weight, np.ones(total)), total)
    p = weight / np.bincount(rows, weight, minlength=total)[rows]
    (inward, v_in), (outward, v_out) = _wedges(rows, cols, p, total), _wedges(cols, rows, p, total)
    keys, i, j = np.intersect1d(inward[v_in != 0], outward[v_out != 0], assume_unique=True, return_indices=True)
    w = (v_in[v_in != 0][i] + v_out[v_out != 0][j]) / 2
    rows, cols = keys // total, keys % total
    degree = np.bincount(rows, w, minlength=total)
    root = np.sqrt(degree[rows] * degree[cols])
    return rows, cols, np.divide(w, root, out=np.zeros_like(w), where=root > 0)


WEDGES_PER_STEP = 1 << 22


def _loads(n_nodes: pd.Series, src: pd.Series) -> list[slice]:
    """Graphs in steps of bounded size, counting for each the most wedges that its normalised entries can have."""
    most = np.array([(2 * len(a) + n) ** 2 // max(n, 1) for n, a in zip(n_nodes, src)], dtype=np.float64)
    step = np.maximum.accumulate(np.cumsum(most) // WEDGES_PER_STEP) if len(most) else most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(most)]
    return [slice(a, b) for s, e in zip(cuts, cuts[1:]) for a, b in zip(range(s, e, GRAPHS_PER_STEP), [*range(s + GRAPHS_PER_STEP, e, GRAPHS_PER_STEP), e])]


def _slices(length: int) -> list[slice]:
    return [slice(at, at + GRAPHS_PER_STEP) for at in range(0, length, GRAPHS_PER_STEP)]


def _power_iterations(alpha: float, iterations: int):
    """Column function: stationary distributions of a batch of packed transition matrices."""

    @F.pandas_udf("array<double>")
    def stationary(n_nodes: pd.Series, src: pd.Series, dst: pd.Series, p: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for part in _slices(len(n_nodes)):
            starts, rows, cols, weight = _flat(n_nodes[part], src[part], dst[part], p[part])
            out += np.split(_power_rounds(starts, rows, cols, weight, alpha, iterations), starts[1:-1])
        return pd.Series(out, dtype=object)

    return stationary


def _ppr_weights(alpha: float, iterations: int, second: bool):
    """Column function: normalised adjacencies of a batch of packed graphs, as parallel arrays; with ``second`` those of second
    order follow, told apart by ``ord``."""

    @F.pandas_udf("src array<int>, dst array<int>, w array<double>, ord array<int>")
    def weights(n_nodes: pd.Series, src: pd.Series, dst: pd.Series, w: pd.Series) -> pd.DataFrame:
        out: dict[str, list[np.ndarray]] = {"src": [], "dst": [], "w": [], "ord": []}
        for part in _loads(n_nodes, src) if second else _slices(len(n_nodes)):
            starts, rows, cols, weight = _flat(n_nodes[part], src[part], dst[part], w[part])
            rows, cols, weight = balanced_entries(starts, rows, cols, weight, alpha, iterations)
            order = np.ones(len(rows), np.int64)
            if second:
                again = second_entries(starts[-1], rows, cols, weight)
                rows, cols, weight = (np.append(a, b) for a, b in zip((rows, cols, weight), again))
                order = np.append(order, np.full(len(again[0]), 2))
            graph = np.searchsorted(starts, rows, side="right") - 1
            place = np.argsort(graph, kind="stable")
            rows, cols, weight, order, graph = (v[place] for v in (rows, cols, weight, order, graph))
            ends = np.searchsorted(graph, np.arange(1, len(starts) - 1))
            for name, values in (("src", rows - starts[graph]), ("dst", cols - starts[graph]), ("w", weight), ("ord", order)):
                out[name] += np.split(values, ends)
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in out.items()})

    return weights


def matrix_nodes(p: DataFrame) -> DataFrame:
    """The nodes of a transition matrix: each has a self-loop."""
    return p.where("src = dst").select(GROUP, F.col("src").alias("node_id"))


def _pagerank_in_tasks(p: DataFrame, alpha: float, iterations: int) -> DataFrame:
    packed = p.groupBy(GROUP).agg(
        F.collect_list(F.struct("src", "dst", "p")).alias("entries"), F.count_if(F.col("src") == F.col("dst")).alias("n_nodes")
    )
    run = _power_iterations(alpha, iterations)
    pi = run(F.col("n_nodes"), F.col("entries.src"), F.col("entries.dst"), F.col("entries.p"))
    return packed.select(GROUP, pi.alias("pi")).select(GROUP, F.posexplode("pi").alias("node_id", "pi"))


def _pagerank_by_joins(p: DataFrame, alpha: float, iterations: int) -> DataFrame:
    p = cut_lineage(p)
    nodes = matrix_nodes(p)
    sizes = nodes.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_nodes"))
    base = cut_lineage(
        nodes.join(sizes, GROUP).select(GROUP, "node_id", (1.0 / F.col("n_nodes")).alias("base"))
    )
    pi = reached = base.withColumnRenamed("base", "pi")
    for i in range(1, iterations + 1):
        step = (
            p.join(pi.withColumnRenamed("node_id", "src"), [GROUP, "src"])
            .groupBy(GROUP, F.col("dst").alias("node_id"))
            .agg(F.sum(F.col("p") * F.col("pi")).alias("flow"))
        )
        # Every node has a self-loop, so every node receives flow.
        pi = step.join(base, [GROUP, "node_id"]).select(
            GROUP, "node_id", ((1 - alpha) * F.col("flow") + alpha * F.col("base")).alias("pi")
        )
        if i % CHECKPOINT_EVERY == 0 and i < iterations:
            pi = cut_lineage(pi)
            moves = pi.join(reached.withColumnRenamed("pi", "before"), [GROUP, "node_id"])
            if moves.agg(F.max(F.abs(F.col("pi") - F.col("before"))).alias("m")).first()["m"] <= TOLERANCE:
                break
            reached = pi
    return pi


def pagerank(
    p: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, small_edges: int = SMALL_EDGES
) -> DataFrame:
    """Stationary distribution of ``pi = (1 - alpha) pi P + alpha / n`` per graph, by rounds from the
    uniform start until nothing moves, ``iterations`` at most. Nodes are numbered 0 … n-1 in each graph; ``p`` is read several
    times, so pass a stored table.

    Small graphs are packed, one row each, and iterated in vectorised batches after a single shuffle.
    Graphs above ``small_edges`` entries run the same rounds as joins over the whole cluster.
    """
    entries = p.groupBy(GROUP).agg(F.count(F.lit(1)).alias("entries"))
    large = entries.where(F.col("entries") > small_edges).select(GROUP)
    if large.isEmpty():
        return _pagerank_in_tasks(p, alpha, iterations)
    large = cut_lineage(large)
    small = _pagerank_in_tasks(p.join(large, GROUP, "left_anti"), alpha, iterations)
    big = _pagerank_by_joins(p.join(large, GROUP, "left_semi"), alpha, iterations)
    return small.unionByName(big)


def _pagerank_symmetric(p: DataFrame, pi: DataFrame) -> DataFrame:
    """``(sqrt(pi_i/pi_j) p_ij + sqrt(pi_j/pi_i) p_ji) / 2``, then degree-normalised. Symmetric."""
    src = pi.select(GROUP, F.col("node_id").alias("src"), F.col("pi").alias("pi_src"))
    dst = pi.select(GROUP, F.col("node_id").alias("dst"), F.col("pi").alias("pi_dst"))
    balanced = (
        p.join(src, [GROUP, "src"])
        .join(dst, [GROUP, "dst"])
        .select(GROUP, "src", "dst", (F.sqrt(F.col("pi_src") / F.col("pi_dst")) * F.col("p")).alias("w"))
    )
    return degree_normalised(symmetrise(balanced))


def norm_undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symmetric normalisation of the unweighted graph. A node that already has a self-loop keeps it
    beside the added one; the two are summed."""
    forth = edges.select(GROUP, "src", "dst")
    back = edges.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = forth.unionByName(back).distinct().withColumn("w", F.lit(1.0))
    return degree_normalised(collapse(add_self_loops(both, nodes)))


def _ppr_in_tasks(edges: DataFrame, nodes: DataFrame, alpha: float, iterations: int, second: bool = False) -> DataFrame:
    packed = edges.groupBy(GROUP).agg(F.collect_list(F.struct("src", "dst", "w")).alias("entries"))
    sizes = nodes.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_nodes"))
    empty = F.array().cast(packed.schema["entries"].dataType)
    entries = sizes.join(packed, GROUP, "left").withColumn("entries", F.coalesce("entries", empty))
    run = _ppr_weights(alpha, iterations, second)
    arrays = run(F.col("n_nodes"), F.col("entries.src"), F.col("entries.dst"), F.col("entries.w"))
    lists = F.arrays_zip("a.src", "a.dst", "a.w", "a.ord")
    rows = entries.select(GROUP, arrays.alias("a")).select(GROUP, F.explode(lists).alias("e"))
    return rows.select(GROUP, "e.src", "e.dst", "e.w", *(["e.ord"] if second else []))


def _ppr_by_joins(edges: DataFrame, nodes: DataFrame, alpha: float, iterations: int) -> DataFrame:
    p = cut_lineage(transition_matrix(edges, nodes))
    return _pagerank_symmetric(p, _pagerank_by_joins(p, alpha, iterations))


def norm_ppr(
    edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, small_edges: int = SMALL_EDGES
) -> DataFrame:
    """Personalised-PageRank normalisation of directed graphs; as sparse as the graphs. Edges are unique.
    Both tables are read twice, once for the sizes: pass stored graphs.

    A graph with at most ``small_edges`` nodes and edges travels as one row and is normalised in a
    vectorised batch: one shuffle in all. Larger graphs take the same steps as joins, spread over the
    cluster.
    """
    return _of_both_sizes(edges, nodes, alpha, iterations, small_edges, False)


def _of_both_sizes(edges: DataFrame, nodes: DataFrame, alpha: float, iterations: int, small_edges: int, second: bool) -> DataFrame:
    edges = edges.select(GROUP, "src", "dst", F.col("w").cast("double").alias("w"))
    nodes = nodes.select(GROUP, "node_id")
    parts = edges.select(GROUP).unionByName(nodes.select(GROUP))
    large = parts.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small_edges).select(GROUP)
    if large.isEmpty():
        return _ppr_in_tasks(edges, nodes, alpha, iterations, second)
    large = cut_lineage(large)
    small = _ppr_in_tasks(edges.join(large, GROUP, "left_anti"), nodes.join(large, GROUP, "left_anti"), alpha, iterations, second)
    edges, nodes = edges.join(large, GROUP, "left_semi"), nodes.join(large, GROUP, "left_semi")
    big = _ppr_by_joins(edges, nodes, alpha, iterations)
    if second:
        big = cut_lineage(big)
        again = _second_by_joins(big, nodes).withColumn("ord", F.lit(2))
        big = big.withColumn("ord", F.lit(1)).unionByName(again)
    return small.unionByName(big)


def first_and_second_order(
    edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, small_edges: int = SMALL_EDGES
) -> DataFrame:
    """PageRank-normalised edges (``ord`` 1) and their second-order proximity (``ord`` 2), see :func:`norm_second_order`. Small
    graphs give both from one packed row, larger ones by joins."""
    return _of_both_sizes(edges, nodes, alpha, iterations, small_edges, True)


def pr_factors(
    edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA, iterations: int = ITERATIONS, small_edges: int = SMALL_EDGES
) -> tuple[DataFrame, DataFrame]:
    """The full PageRank normalisation as a sparse part (group_id, src, dst, w) and node factors (group_id, node_id, a, b, c): the
    weight of a pair is ``w`` (0 where there is no such row) plus ``c * (a_src * b_dst + b_src * a_dst)``.

    The transition ``(1 - alpha) P + alpha / n`` balanced by pi has the sparse part of P and, as 1 / n is the same everywhere, sums
    of sqrt(pi) / sqrt(pi) over all pairs: two factors per node. Degrees follow from the sums of the factors. Both are stored.
    """
    p = cut_lineage(transition_matrix(edges, nodes))
    pi = cut_lineage(pagerank(p, alpha, iterations, small_edges))
    root = F.sqrt("pi")
    sums = pi.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum(root).alias("sum_a"), F.sum(1 / root).alias("sum_b"))
    ends = [pi.select(GROUP, F.col("node_id").alias(c), root.alias(f"a_{c}")) for c in ("src", "dst")]
    moved = p.join(ends[0], [GROUP, "src"]).join(ends[1], [GROUP, "dst"])
    half = moved.select(GROUP, "src", "dst", ((1 - alpha) / 2 * F.col("p") * F.col("a_src") / F.col("a_dst")).alias("w"))
    sparse = cut_lineage(collapse(half.unionByName(half.select(GROUP, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))))
    own = sparse.groupBy(GROUP, F.col("src").alias("node_id")).agg(F.sum("w").alias("own"))
    c = alpha / (2 * F.col("n"))
    scale = F.sqrt(F.col("own") + c * (root * F.col("sum_b") + F.col("sum_a") / root))
    rows = pi.join(own, [GROUP, "node_id"]).join(sums, GROUP)
    factors = cut_lineage(rows.select(GROUP, "node_id", (root / scale).alias("a"), (1 / root / scale).alias("b"), c.alias("c"), scale.alias("scale")))
    ends = [factors.select(GROUP, F.col("node_id").alias(e), F.col("scale").alias(f"s_{e}")) for e in ("src", "dst")]
    scaled = sparse.join(ends[0], [GROUP, "src"]).join(ends[1], [GROUP, "dst"])
    return scaled.select(GROUP, "src", "dst", (F.col("w") / (F.col("s_src") * F.col("s_dst"))).alias("w")), factors.drop("scale")


PAIR_BLOCK = 1024
"""Targets whose factors travel as one row when all pairs are wanted."""


def norm_pr(
    edges: DataFrame,
    nodes: DataFrame,
    alpha: float = ALPHA,
    iterations: int = ITERATIONS,
    small_edges: int = SMALL_EDGES,
) -> DataFrame:
    """Full PageRank normalisation, where every node pair of a graph gets a weight: n² rows per graph
    by definition, whatever its size. :func:`pr_factors` has the same in as many rows as there are edges and nodes.

    Sources with their sparse rows meet blocks of targets; the pairs are written out where they meet and not moved again.
    """
    sparse, factors = pr_factors(edges, nodes, alpha, iterations, small_edges)
    rows = sparse.groupBy(GROUP, F.col("src").alias("node_id")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("row"))
    sources = factors.join(rows, [GROUP, "node_id"]).select(GROUP, F.col("node_id").alias("src"), F.col("a").alias("a_i"), F.col("b").alias("b_i"), "c", "row")
    targets = factors.groupBy(GROUP, F.expr(f"node_id div {PAIR_BLOCK}")).agg(F.collect_list(F.struct("node_id", "a", "b")).alias("targets"))
    pairs = sources.join(targets.select(GROUP, "targets"), GROUP).select(GROUP, "src", "a_i", "b_i", "c", "row", F.explode("targets").alias("t"))
    dense = F.col("c") * (F.col("a_i") * F.col("t.b") + F.col("b_i") * F.col("t.a"))
    return pairs.select(GROUP, "src", F.col("t.node_id").alias("dst"), (dense + F.coalesce(F.try_element_at("row", F.col("t.node_id")), F.lit(0.0))).alias("w"))


def _second_in_tasks(adj: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Second-order proximity of small graphs, one packed row each; ``rows``: how many rows both tables have."""
    entries = spread(adj.select(GROUP, "src", "dst", F.col("w").cast("double").alias("w")), rows, [GROUP])
    packed = entries.groupBy(GROUP).agg(F.collect_list(F.struct("src", "dst", "w")).alias("entries"))
    sizes = nodes.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_nodes"))
    empty = F.array().cast(packed.schema["entries"].dataType)
    graphs = sizes.join(packed, GROUP, "left").select(GROUP, "n_nodes", F.coalesce("entries", empty).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, groups = batch.column("entries"), batch.column(GROUP)
            starts = np.concatenate(([0], np.cumsum(batch.column("n_nodes").to_numpy())))
            cuts, ends = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            cuts -= cuts[0]
            shift = np.repeat(starts[:-1], np.diff(cuts))
            src, dst = (ends.field(c).to_numpy().astype(np.int64) + shift for c in ("src", "dst"))
            w = ends.field("w").to_numpy()
            # pairs that meet in a node, its self-loop included, bound what a step writes out
            met = sum((np.bincount(end, minlength=starts[-1]) + 1.0) ** 2 for end in (src, dst))
            step = np.cumsum(np.add.reduceat(met, starts[:-1])) // WEDGES_PER_STEP
            bounds = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                part, first = slice(cuts[a], cuts[b]), starts[a]
                rows, cols, weight = second_entries(starts[b] - first, src[part] - first, dst[part] - first, w[part])
                graph = np.searchsorted(starts, rows + first, side="right") - 1
                local = [pa.array((v + first - starts[graph]).astype(np.int32)) for v in (rows, cols)]
                yield pa.RecordBatch.from_arrays([groups.take(pa.array(graph)), *local, pa.array(weight)], [GROUP, "src", "dst", "w"])

    return graphs.mapInArrow(run, f"{GROUP} string, src int, dst int, w double")


def norm_second_order(adj: DataFrame, nodes: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """Second-order proximity ``(P'P + PP') / 2`` where both parts are non-zero, degree-normalised.
    Its input is the normalised first-order adjacency of nodes numbered 0 … n-1; it is read several times, so pass a stored table.

    A graph with at most ``small_edges`` nodes and entries travels as one row, larger graphs take the same steps as joins.
    """
    sizes = adj.select(GROUP).unionByName(nodes.select(GROUP)).groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))
    most, rows = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most <= small_edges:
        return _second_in_tasks(adj, nodes, rows)
    large = cut_lineage(sizes.where(F.col("n") > small_edges).select(GROUP))
    small = _second_in_tasks(adj.join(large, GROUP, "left_anti"), nodes.join(large, GROUP, "left_anti"), rows)
    return small.unionByName(_second_by_joins(adj.join(large, GROUP, "left_semi"), nodes.join(large, GROUP, "left_semi")))


def _second_by_joins(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for graphs of any size.

    Pairs with a common source give the first part, pairs with a common target the second. Of each graph the kind with fewer pairs
    is written out; the other part is only looked up for these, through the end with fewer entries. A hub costs the square of
    its entries only if it is one in both directions, where the result has as many rows.
    """
    p = cut_lineage(transition_matrix(adj, nodes).where("p <> 0"))
    degrees = [p.groupBy(GROUP, F.col(c).alias("node_id")).agg(F.count(F.lit(1)).alias("d")) for c in ("src", "dst")]
    pairs = [d.groupBy(GROUP).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias(c)) for d, c in zip(degrees, ("by_src", "by_dst"))]
    side = pairs[0].join(pairs[1], GROUP).select(GROUP, (F.col("by_src") <= F.col("by_dst")).alias("out"))
    # mid: the node that pairs are written out over; end: the nodes they consist of
    mid, end = F.when(F.col("out"), F.col("src")).otherwise(F.col("dst")), F.when(F.col("out"), F.col("dst")).otherwise(F.col("src"))
    q = cut_lineage(p.join(side, GROUP).select(GROUP, mid.alias("mid"), end.alias("end"), "p"))
    one, two = (q.select(GROUP, "mid", F.col("end").alias(n), F.col("p").alias(f"p_{n}")) for n in ("i", "j"))
    written = one.join(two, [GROUP, "mid"]).where("i <= j").groupBy(GROUP, "i", "j").agg(F.sum(F.col("p_i") * F.col("p_j")).alias("v1"))
    # the other part: what i and j as middle nodes have in common
    sizes = q.groupBy(GROUP, "mid").agg(F.count(F.lit(1)).alias("d"))
    for n in ("i", "j"):
        written = written.join(sizes.select(GROUP, F.col("mid").alias(n), F.col("d").alias(f"d_{n}")), [GROUP, n])
    less = F.col("d_i") <= F.col("d_j")
    asked = written.select(GROUP, "i", "j", "v1", F.when(less, F.col("i")).otherwise(F.col("j")).alias("mid"), F.when(less, F.col("j")).otherwise(F.col("i")).alias("far"))
    through = asked.join(q, [GROUP, "mid"]).select(GROUP, "i", "j", "v1", "far", "end", "p")
    far = q.select(GROUP, F.col("mid").alias("far"), "end", F.col("p").alias("p_far"))
    both = through.join(far, [GROUP, "far", "end"]).groupBy(GROUP, "i", "j").agg(F.first("v1").alias("v1"), F.sum(F.col("p") * F.col("p_far")).alias("v2"))
    half = both.where("v1 <> 0 AND v2 <> 0").select(GROUP, "i", "j", ((F.col("v1") + F.col("v2")) / 2).alias("w"))
    turned = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return degree_normalised(half.select(GROUP, "w", F.explode(turned).alias("e")).select(GROUP, F.col("e.i").alias("src"), F.col("e.j").alias("dst"), "w"))


def normalise(edges: DataFrame, nodes: DataFrame, mode: str = "appr", **options) -> DataFrame:
    """``un`` undirected, ``appr`` personalised PageRank, ``pr`` full PageRank, ``ib`` first and second
    order together, told apart by the column ``ord``."""
    if mode == "un":
        return norm_undirected(edges, nodes).withColumn("ord", F.lit(1))
    if mode == "appr":
        return norm_ppr(edges, nodes, **options).withColumn("ord", F.lit(1))
    if mode == "pr":
        return norm_pr(edges, nodes, **options).withColumn("ord", F.lit(1))
    if mode == "ib":
        return first_and_second_order(edges, nodes, **options)
    raise ValueError("mode must be un, appr, pr or ib")
