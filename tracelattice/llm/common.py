"""Helpers shared by the text operators: storing tables, words, streamed groups, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SQL = r"[^\x20\x09-\x0D]+"
FULL = 1 << 20
LINKS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read again from a checkpoint: computed once, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; compressed, for large tables read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most `limit` rows, those of smallest hash of `keys`. A count of the rows lets tasks drop nearly all others first."""
    spare = (1.5 * limit + 1000) / max(df.count(), 1)
    mark = F.xxhash64(*keys)
    return df.where(F.pmod(mark, F.lit(1 << 40)) < int(min(1.0, spare) * (1 << 40))).orderBy(F.pmod(mark, F.lit(1 << 40)), mark).limit(limit)


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def pieces(texts: list[bytes], limit: int = FULL) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row that is longer."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """fn over batches of rows as lists by column, in tasks; strings arrive as UTF-8 bytes."""
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(columns_of(batch)), schema=out)

    return df.mapInArrow(run, schema)


def columns_of(batch) -> dict[str, list]:
    got = {}
    for name in batch.schema.names:
        c = batch.column(name)
        got[name] = (c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist()
    return got


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat list `name type, ...`."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (part.strip().split() for part in ddl.split(","))])


def token_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a few texts together: 64-bit hash, start and end byte of every lower-cased word, and each text's first word.

    Starts and ends count from the beginning of the word's own text.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    white = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64)
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint64) + np.uint64(1)
    at = np.arange(len(buf)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(buf)]])))
    power = powers(int(at.max()) + 1)
    low[white] = 0
    h = mixed(np.add.reduceat(low * power[at], starts))
    first = np.searchsorted(starts, base)
    own = np.repeat(base[:-1], np.diff(first))
    return h, starts - own, ends - own, first


def powers(n: int) -> np.ndarray:
    """1, b, b*b, ... modulo 2^64 for a fixed odd b."""
    out = np.full(max(n, 1), 0x9E3779B97F4A7C55, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed one-to-one map)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of pairs (a, b) that keep all nodes as connected as all pairs do, without cycles."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a):]
    label, live, kept = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        x, y = label[a[live]], label[b[live]]
        open_ = x != y
        live, x, y = live[open_], x[open_], y[open_]
        if not len(live):
            return np.concatenate(kept) if kept else live
        high, one = np.unique(np.maximum(x, y), return_index=True)
        kept.append(live[one])
        parent = np.arange(len(nodes))
        parent[high] = np.minimum(x, y)[one]
        while not np.array_equal(nxt := parent[parent], parent):
            parent = nxt
        label = parent[label]


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: every node that is not the smallest of its component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while len(live := np.flatnonzero(label[a] != label[b])):
        a, b = a[live], b[live]
        x, y = label[a], label[b]
        low = np.arange(len(nodes))
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := low[low], low):
            low = nxt
        label = low[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v: long) that connect the same nodes: LINKS of a task at a time become stars, so that few rounds remain."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column("u")), np.asarray(batch.column("v"))))
            n += batch.num_rows
            if n >= LINKS:
                yield star(held)
                held, n = [], 0
        if n:
            yield star(held)

    def star(held):
        u, v = hung(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected(links: DataFrame) -> DataFrame:
    """node, root of every node in links (a, b: long): root is the smallest node reachable.

    Links become stars inside the tasks that hold them; then alternating stars: every node's neighbours are hung on the smallest
    neighbour until nothing changes. Links are stored each round; a large hub is a skewed join that Spark splits.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(contracted(edges).distinct())
    state = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = edges.agg(*state).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        edges = stored(small)
        now = edges.agg(*state).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
