"""Message passing, pooling and the fixed-weight encoders, for all graphs at once.

``adj``: group_id, src, dst, w. ``x``: group_id, node_id, x (array<double>). Weight matrices are small
numpy arrays whose size depends on the model, not on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.vectors import (
    concat_array_columns, constant, l2, plus, scaled, vector_max, vector_mean, vector_sum,
)
from tracelattice.operators.graphs import GROUP
from tracelattice.session import cut_lineage, spread

POOLS = {
    "mean": vector_mean,
    "sum": lambda vector, dims=None: vector_sum(vector, dims=dims),
    "max": vector_max,
}


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy())


def dense(weight: np.ndarray, relu: bool = False, bias: np.ndarray | None = None):
    """Column function: row vector times ``weight``, optionally plus ``bias`` and clipped at 0."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        out = _matrix(x) @ weight
        if bias is not None:
            out = out + bias
        return pd.Series(list(np.maximum(out, 0.0) if relu else out))

    return apply


def gated(params: dict[str, np.ndarray], alpha: float):
    """Column function: ``alpha * tanh(V relu(layernorm(U x)))``, the bounded timing residual."""

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(alpha * np.tanh(timing_branch(_matrix(x), params)[-1])))

    return apply


def centred_map(params: dict[str, np.ndarray]) -> np.ndarray:
    """The first map of a timing branch less its row means, so that what it gives has mean 0 as the layer norm asks."""
    return params["U"] - params["U"].mean(axis=1, keepdims=True)


def timing_branch(x: np.ndarray, params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear, layer norm, relu, linear. For gradients also returns the timing over the norm's spread, since the norm of
    ``x U`` is that times the centred map, and the active values; the output comes last."""
    u = centred_map(params)
    h = x @ u
    scaled = x / np.sqrt(np.einsum("ij,ij->i", h, h) / u.shape[1] + 1e-5)[:, None]
    active = scaled @ (u * params["gain"])
    active += params["shift"]
    np.maximum(active, 0.0, out=active)
    return scaled, active, active @ params["V"]


def tanh(values: np.ndarray) -> np.ndarray:
    """The hyperbolic tangent to 4e-16, by the exponential, which takes less than half the time of numpy's tanh."""
    with np.errstate(over="ignore"):
        out = np.exp(2.0 * values)
    out += 1.0
    np.divide(-2.0, out, out=out)
    out += 1.0
    return out


def gather(adj: DataFrame, x: DataFrame) -> DataFrame:
    """Every edge with the vector of its source node."""
    return adj.join(x.select(GROUP, F.col("node_id").alias("src"), "x"), [GROUP, "src"])


def propagate(adj: DataFrame, x: DataFrame, dims: int | None = None) -> DataFrame:
    """Weighted sum of the vectors arriving at every node. Nodes without an incoming edge drop out;
    normalised adjacencies have none such. Partial sums are built before the shuffle. ``dims`` is the
    width of ``x``, if known."""
    moved = gather(adj.where("w > 0"), x)
    return moved.groupBy(GROUP, F.col("dst").alias("node_id")).agg(vector_sum(F.col("x"), F.col("w"), dims).alias("x"))


def propagate_timed(
    adj: DataFrame, x: DataFrame, timing: DataFrame, params: dict[str, np.ndarray], alpha: float = 0.05
) -> DataFrame:
    """Weighted messages plus a bounded residual from each edge's standardised timing.

    ``timing``: group_id, src, dst, t (array). Edges the normalisation added have none and take zeros.
    """
    width = params["U"].shape[0]
    timed = with_edge_stats(adj, timing, width)
    message = plus(scaled(F.col("x"), F.col("w")), gated(params, alpha)(F.col("t")))
    return gather(timed, x).groupBy(GROUP, F.col("dst").alias("node_id")).agg(vector_sum(message).alias("x"))


def with_edge_stats(adj: DataFrame, timing: DataFrame, width: int = 2) -> DataFrame:
    """Normalised edges with the raw edge's statistics, a zero vector where there is none."""
    return adj.join(timing.select(GROUP, "src", "dst", "t"), [GROUP, "src", "dst"], "left").withColumn(
        "t", F.coalesce("t", constant([0.0] * width))
    )


def pool(x: DataFrame, how: str = "mean", dims: int | None = None) -> DataFrame:
    """Node vectors to one vector per graph."""
    if how not in POOLS:
        raise ValueError(f"pool must be one of {sorted(POOLS)}")
    return x.groupBy(GROUP).agg(POOLS[how](F.col("x"), dims).alias("z"))


def pool_edges(edges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mean and maximum of edge columns per graph, as one vector: means first, then maxima."""
    values = [fn(c) for fn in (F.avg, F.max) for c in columns]
    return edges.groupBy(GROUP).agg(F.array(*values).alias("t"))


def centre(z: DataFrame, train: Column | str | None = None) -> list[float]:
    """Mean of the graph vectors, of the rows of ``train`` if given. Fixed size."""
    rows = z if train is None else z.where(train)
    value = rows.agg(vector_mean(F.col("z")).alias("c")).first()["c"]
    if value is None:
        raise RuntimeError("no graphs to take the centre of")
    return list(value)


def distances(z: DataFrame, c: list[float]) -> DataFrame:
    """Distance to the centre per graph, plain (``score``) and squared."""
    keep = [name for name in z.columns if name != "z"]
    return z.select(*keep, l2(F.col("z"), constant(c)).alias("score")).withColumn(
        "score_sq", F.col("score") * F.col("score")
    )


def node_importance(x: DataFrame, dims: int | None = None) -> DataFrame:
    """Distance of every node vector from the mean of its graph."""
    return x.join(pool(x, "mean", dims), GROUP).select(GROUP, "node_id", l2(F.col("x"), F.col("z")).alias("importance"))


def encoder_rows(adj: DataFrame, x: DataFrame, layers: int = 2, dims: int | None = None) -> DataFrame:
    """What a fixed encoder needs per node: the neighbour sum ``x`` and its share ``s`` in the graph
    vector. Since the second convolution and the mean pool are linear, a node counts with the sum
    of its outgoing weights over the number of nodes, and neighbours are summed only once."""
    summed = propagate(adj, x, dims)
    sizes = x.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n_nodes"))
    if layers == 1:
        return summed.join(sizes, GROUP).select(GROUP, "node_id", "x", (1.0 / F.col("n_nodes")).alias("s"))
    out = adj.groupBy(GROUP, F.col("src").alias("node_id")).agg(F.sum("w").alias("out_w"))
    return (
        summed.join(out, [GROUP, "node_id"])
        .join(sizes, GROUP)
        .select(GROUP, "node_id", "x", (F.col("out_w") / F.col("n_nodes")).alias("s"))
    )


def encode_rows(rows: DataFrame, w1: np.ndarray, w2: np.ndarray) -> DataFrame:
    """``z = (sum_j s_j relu(x_j W1)) W2`` per graph."""
    hidden = rows.select(GROUP, "s", dense(w1, relu=True)(F.col("x")).alias("h")).where("s > 0")
    summed = hidden.groupBy(GROUP).agg(vector_sum(F.col("h"), F.col("s"), w1.shape[1]).alias("r"))
    return summed.select(GROUP, dense(w2)(F.col("r")).alias("z"))


def encode(adj: DataFrame, x: DataFrame, w1: np.ndarray, w2: np.ndarray, layers: int = 2) -> DataFrame:
    """Graph vectors: convolution, relu, convolution, mean pool (``layers=2``), or convolution, relu,
    mean pool, linear map (``layers=1``)."""
    return encode_rows(encoder_rows(adj, x, layers, w1.shape[0]), w1, w2)


INCEPTION_LIMIT = 4096
"""Nodes and edges of both orders up to which a graph travels as one row."""
INCEPTION_VALUES = 1 << 21
"""Numbers of node vectors that one step of the packed form holds."""


def encode_inception(
    adj1: DataFrame, adj2: DataFrame, x: DataFrame, blocks: list[dict[str, np.ndarray]], limit: int = INCEPTION_LIMIT
) -> DataFrame:
    """Node vectors after blocks of ``x W0 + b0 + conv1(x) + conv2(x)`` over both adjacency orders. Nodes are numbered 0 … n-1.

    A graph of at most ``limit`` nodes and edges is one row and takes all blocks in one task; larger graphs take them as joins.
    """
    edges = [a.where("w > 0").select(GROUP, F.lit(k).alias("k"), "src", "dst", "w") for k, a in ((1, adj1), (2, adj2))]
    both = edges[0].unionByName(edges[1])
    sizes = both.select(GROUP).unionByName(x.select(GROUP)).groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))
    most, rows = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most <= limit:
        return _inception_in_tasks(both, x, blocks, rows)
    large = cut_lineage(sizes.where(F.col("n") > limit).select(GROUP))
    small = _inception_in_tasks(both.join(large, GROUP, "left_anti"), x.join(large, GROUP, "left_anti"), blocks, rows)
    wide = _inception_by_joins(*(t.join(large, GROUP, "left_semi") for t in (adj1, adj2, x)), blocks)
    return small.unionByName(wide)


def _inception_by_joins(adj1: DataFrame, adj2: DataFrame, x: DataFrame, blocks: list[dict[str, np.ndarray]]) -> DataFrame:
    for block in blocks:
        own = x.select(GROUP, "node_id", dense(block["W0"], bias=block.get("b0"))(F.col("x")).alias("x"))
        parts = [own]
        for adj, name in ((adj1, "W1"), (adj2, "W2")):
            parts.append(propagate(adj, x, block[name].shape[0]).select(GROUP, "node_id", dense(block[name])(F.col("x")).alias("x")))
        union = parts[0].unionByName(parts[1]).unionByName(parts[2])
        # A block reads its input three times, so it is stored once.
        x = cut_lineage(union.groupBy(GROUP, "node_id").agg(vector_sum(F.col("x"), dims=block["W0"].shape[1]).alias("x")))
    return x


def _inception_in_tasks(edges: DataFrame, x: DataFrame, blocks: list[dict[str, np.ndarray]], rows: int) -> DataFrame:
    """All blocks over packed graphs. ``edges`` of order ``k``; ``rows``: how many rows both tables have."""
    lists = spread(edges, rows, [GROUP]).groupBy(GROUP).agg(F.collect_list(F.struct("k", "src", "dst", "w")).alias("edges"))
    nodes = spread(x.select(GROUP, "node_id", "x"), rows, [GROUP]).groupBy(GROUP).agg(F.collect_list(F.struct("node_id", "x")).alias("nodes"))
    empty = F.array().cast(lists.schema["edges"].dataType)
    packs = nodes.join(lists, GROUP, "left").select(GROUP, "nodes", F.coalesce("edges", empty).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in ("nodes", "edges"))
            width = len(batch.column("nodes").flatten().field("x")[0])
            load = np.cumsum(size.astype(np.int64) * width) // INCEPTION_VALUES
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield _inception_batch(batch.slice(a, b - a), blocks)

    return packs.mapInArrow(run, f"{GROUP} string, node_id int, x array<double>")


def _inception_batch(batch: pa.RecordBatch, blocks: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """The blocks over some packed graphs at once. A node that only edges name has no vector until a message reaches it."""
    graph = [np.repeat(np.arange(batch.num_rows), np.diff(batch.column(c).offsets.to_numpy())) for c in ("nodes", "edges")]
    inside, ends = batch.column("nodes").flatten(), batch.column("edges").flatten()
    node, src, dst = (a.to_numpy().astype(np.int64) for a in (inside.field("node_id"), ends.field("src"), ends.field("dst")))
    span = 1 + max(int(a.max(initial=0)) for a in (node, src, dst))
    keys, place = np.unique(np.concatenate([graph[0] * span + node, graph[1] * span + src, graph[1] * span + dst]), return_inverse=True)
    at, src, dst = np.split(place, [len(node), len(node) + len(src)])
    kind, w = ends.field("k").to_numpy(), ends.field("w").to_numpy()
    vectors = inside.field("x").flatten().to_numpy().reshape(len(node), -1)
    held = np.bincount(at, minlength=len(keys)).astype(float)  # rows of a node that hold its vector
    if len(node) and held.max() > 1:
        x = _sums_by(at, vectors, len(keys))
    else:
        x = np.zeros((len(keys), vectors.shape[1]))
        x[at] = vectors
    for block in blocks:
        out = x @ block["W0"]
        if block.get("b0") is not None:
            out += held[:, None] * block["b0"]
        reached = held > 0
        for k, name in ((1, "W1"), (2, "W2")):
            sent = (kind == k) & (held[src] > 0)
            moved = x @ block[name]
            out += _sums_by(dst[sent], w[sent, None] * moved[src[sent]], len(keys))
            reached[dst[sent]] = True
        x, held = out, reached.astype(float)
    kept = np.flatnonzero(held > 0)
    starts = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * x.shape[1])
    columns = [batch.column(GROUP).take(pa.array(keys[kept] // span)), pa.array((keys[kept] % span).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(starts, pa.array(x[kept].ravel()))], [GROUP, "node_id", "x"])


def _sums_by(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by key (0 … n-1)."""
    return np.stack([np.bincount(keys, column, minlength=n) for column in values.T], axis=1)


def encode_timed(
    adj: DataFrame, x: DataFrame, timing: DataFrame, layers: list[dict], alpha: float = 0.05
) -> DataFrame:
    """Two timed convolutions with relu between, mean-pooled. Each layer has ``W`` and its timing branch."""
    for i, layer in enumerate(layers):
        projected = x.select(GROUP, "node_id", dense(layer["W"])(F.col("x")).alias("x"))
        x = propagate_timed(adj, projected, timing, layer, alpha)
        if i < len(layers) - 1:
            x = x.withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))))
    return pool(x, "mean")


def fuse_graph(z: DataFrame, summary: DataFrame, params: dict[str, np.ndarray], alpha: float = 0.1) -> DataFrame:
    """Graph vectors plus the bounded residual of each graph's timing summary ``t``."""
    return z.join(summary.select(GROUP, "t"), GROUP).select(
        GROUP, plus(F.col("z"), gated(params, alpha)(F.col("t"))).alias("z")
    )


def with_summary_vector(summary: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return summary.select(GROUP, concat_array_columns(columns).alias("t"))


def init_weights(shape: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """Glorot-uniform weights."""
    bound = np.sqrt(6.0 / sum(shape))
    return rng.uniform(-bound, bound, shape)


def init_timing(width: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A timing branch: two uniform linear maps around a layer norm at its identity."""
    near, far = 1 / np.sqrt(width), 1 / np.sqrt(hidden)
    return {
        "U": rng.uniform(-near, near, (width, hidden)),
        "gain": np.ones(hidden),
        "shift": np.zeros(hidden),
        "V": rng.uniform(-far, far, (hidden, hidden)),
    }
