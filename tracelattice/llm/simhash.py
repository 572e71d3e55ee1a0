"""SimHash near-duplicates by a generalised pigeonhole search.

Bits of the fingerprints are grouped into parts, correlated bits together. Part i gets its own threshold t_i >= -1 with
sum(t_i) = radius - parts + 1; two fingerprints within the radius then differ by at most t_i bits in some part i with t_i >= 0.
Thresholds (and the number of parts) minimise the estimated cost of probes and candidates by dynamic programming over
statistics of all fingerprints. Each fingerprint is filed under its part values, and probes the values within t_i bits of
them; every candidate is verified on all bits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.llm.common import (
    arrow_schema, columns_of, connected, hash_sample, map_rows, spanning, stored, whole_text, words, written,
)

BITS = 64
PROBE_COST, PAIR_COST = 600.0, 4.0  # nanoseconds, measured: a probe row through the shuffle, a compared pair
HOT_ROWS = 20_000
PAIRS_AT_ONCE = 1 << 20
SALTS = 64
SAMPLE_DOCS, USUAL = 10_000, 1 << 16  # for the order of shingles alone; results do not depend on it


def shingle_hashes(tokens: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of every space-joined shingle; of the whole sequence if it is shorter; none without words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes (over half), as an unsigned number; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, widths: tuple[int, ...] = (4,), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and one long column fp<width> per shingle width, of every whole text (null: empty)."""
    kinds = dict(docs.dtypes)
    ddl = ", ".join([f"{c} {'long' if kinds[c] == 'bigint' else kinds[c]}" for c in keep] + [f"fp{w} long" for w in widths])

    def rows(c):
        out = {k: c[k] for k in keep} | {f"fp{w}": [] for w in widths}
        for t in c["_text"]:
            tokens = words(t)
            for w in widths:
                out[f"fp{w}"].append(signed(fingerprint(shingle_hashes(tokens, w))))
        return out

    return map_rows(docs.select(*keep, whole_text().alias("_text")), rows, ddl)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for every two bits (most significant first) how many have both set."""

    def counts(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(np.asarray(b.column("fp")).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(x), 8192):
                y = x[at : at + 8192]
                total += y.T @ y
            n += len(x)
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["cell", "n"])

    cells = fps.select("fp").mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    full = np.zeros(BITS * BITS + 1, np.int64)
    for r in cells:
        full[r.cell] = r.n
    return int(full[-1]), full[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        rest = sorted(left)
        group = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(1)))]]
        left.discard(group[0])
        while len(group) < width:
            rest = sorted(left)
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def allocated(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Least estimated cost and the threshold of every part, summing to radius - parts + 1."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    goal, best = radius - len(groups) + 1, {0: (0.0, [])}
    for g in groups:
        dist = np.ones(1)
        for b in g:
            dist = np.convolve(dist, [1 - differ[b], differ[b]])
        costs = {-1: 0.0}
        for t in range(min(radius, len(g), 3) + 1):
            probes = n * (1 + sum(comb(len(g), k) for k in range(t + 1)))
            costs[t] = PROBE_COST * probes + PAIR_COST * n * n * float(dist[: t + 1].sum())
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t, c in costs.items():
                if s + t not in nxt or cost + c < nxt[s + t][0]:
                    nxt[s + t] = (cost + c, [*ts, t])
        best = nxt
    return best.get(goal, (float("inf"), []))


def search_plan(n: int, both: np.ndarray, radius: int) -> tuple[list[list[int]], list[int]]:
    """The groups of bits and thresholds of the cheapest number of parts."""
    found = []
    for parts in range(2, min(radius + 5, 13)):
        groups = grouped_bits(n, both, parts)
        found.append((*allocated(n, both, groups, radius), groups))
    cost, thresholds, groups = min(found, key=lambda x: x[0])
    return groups, thresholds


@lru_cache
def masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.int64(BITS - 1 - b)) & 1) << np.int64(k)
    return out


def links(fps: DataFrame, radius: int = 4, other_radius: int = BITS) -> DataFrame:
    """Pairs (a, b) of ids of `fps` (id, fp, other: long; ids distinct) within `radius` bits by fp and `other_radius` by other.

    Linear in size: where a task finds many pairs, a spanning subset of them is returned, so that connected components are
    those of all pairs; pairs that are checked further are then not all there are. A part value with more than HOT_ROWS fingerprints is dealt over several tasks: its probes are split,
    its filed fingerprints are copied to each. `fps` is read three times: pass a stored table.
    """
    n, both = bit_statistics(fps)
    groups, thresholds = search_plan(n, both, radius)
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, thresholds)) if t >= 0]
    names = ["key", "id", "fp", "other"]

    def emit(batches, probe):
        for b in batches:
            got = [np.asarray(b.column(c)) for c in ("id", "fp", "other")]
            for at in range(0, len(got[0]), 4096):
                part = [x[at : at + 4096] for x in got]
                for i, g, t in used:
                    value, m = part_value(part[1], g), masks(len(g), t if probe else 0)
                    keys = ((value[:, None] ^ m[None, :]) | np.int64(i << 40)).reshape(-1)
                    for s in range(0, len(keys), 1 << 16):
                        e = min(s + (1 << 16), len(keys))
                        row = np.arange(s, e) // len(m)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[s:e]), *(pa.array(x[row]) for x in part)], names=names)

    ddl = "key long, id long, fp long, other long"
    filed = fps.select("id", "fp", "other").mapInArrow(lambda b: emit(b, False), ddl)
    probes = fps.select("id", "fp", "other").mapInArrow(lambda b: emit(b, True), ddl)
    hot = stored(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
                 .select("key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts")))
    if hot.isEmpty():
        filed, probes = filed.withColumn("salt", F.lit(0)), probes.withColumn("salt", F.lit(0))
    else:
        filed = filed.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        probes = probes.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("id"), F.col("salts")), F.lit(0)))
    rows = filed.withColumn("role", F.lit(0)).unionByName(probes.withColumn("role", F.lit(1)), allowMissingColumns=True)
    rows = rows.select("key", "salt", "role", "id", "fp", "other").repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
    return rows.mapInArrow(lambda b: compared(b, radius, other_radius), "a long, b long")


def compared(batches, radius: int, other_radius: int):
    """Probes of each key against the fingerprints filed under it; only the latter are held."""
    held = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        key, salt, role, ident, fp, other = (np.asarray(batch.column(c)) for c in ("key", "salt", "role", "id", "fp", "other"))
        isf = role == 0
        fk, fs, fi, ff, fo = (np.concatenate([h, x[isf]]) for h, x in zip(held, (key, salt, ident, fp, other)))
        pk, ps, pi, pf, po = (x[~isf] for x in (key, salt, ident, fp, other))
        if len(fk) and len(pk):
            group = np.cumsum(np.concatenate([[0], (np.diff(fk) != 0) | (np.diff(fs) != 0)]))
            first = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
            size = np.diff(np.append(first, len(fk)))
            order = {k: i for i, k in enumerate(zip(fk[first].tolist(), fs[first].tolist()))}
            turn = np.flatnonzero(np.concatenate([[True], (np.diff(pk) != 0) | (np.diff(ps) != 0)]))
            of = np.array([order.get(k, -1) for k in zip(pk[turn].tolist(), ps[turn].tolist())], np.int64)
            of = np.repeat(of, np.diff(np.append(turn, len(pk))))
            live = np.flatnonzero(of >= 0)
            yield from matches(live, of[live], first, size, (pi, pf, po), (fi, ff, fo), radius, other_radius)
        last = (fk == key[-1]) & (fs == salt[-1]) if len(fk) and len(key) else np.zeros(len(fk), bool)
        held = [x[last] for x in (fk, fs, fi, ff, fo)]


def matches(rows, of, first, size, probe, filed, radius, other_radius):
    many, total, start = size[of], np.cumsum(size[of]), 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        k = many[start:stop]
        q = np.repeat(rows[start:stop], k)
        f = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[of[start:stop]], k)
        hit = np.bitwise_count((probe[1][q] ^ filed[1][f]).view(np.uint64)) <= radius
        q, f = q[hit], f[hit]
        hit = (np.bitwise_count((probe[2][q] ^ filed[2][f]).view(np.uint64)) <= other_radius) & (probe[0][q] < filed[0][f])
        a, b = probe[0][q[hit]], filed[0][f[hit]]
        if len(a):
            some = spanning(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], names=["a", "b"])
        start = stop


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `radius` bits. A null text is an empty one; without
    words the fingerprint is zero. Null ids never are the smallest while another is there. Repeated rows stay; other
    columns are left aside; an empty table gives none.
    """
    fps = stored(fingerprints(docs, (width,)).withColumnRenamed(f"fp{width}", "fp"))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = distinct.select(F.col("fp").alias("id"), "fp", F.lit(0).cast("long").alias("other"))
    roots = connected(links(nodes, radius))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have a Jaccard similarity of at least `least` over sets of word shingles.

    Each pair moves the text of b once; the text of a goes once to each of at most SALTS tasks that hold its pairs.
    """
    pairs = pairs.distinct().withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
    members = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text", F.lit(1).alias("role"))
    hubs = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    hubs = hubs.select("a", "salt", F.lit(0).cast("long").alias("b"), "text", F.lit(0).alias("role"))

    def check(batches):
        hub, held = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "role")), batch.column("text").cast(pa.binary()).to_pylist())
            good: tuple[list, list] = ([], [])
            for a, salt, b, role, text in rows:
                mine = np.unique(shingle_hashes(words(text), width))
                if role == 0:
                    hub, held = (a, salt), mine
                elif hub == (a, salt):
                    common = len(np.intersect1d(held, mine, assume_unique=True))
                    if common >= least * (len(held) + len(mine) - common):
                        good[0].append(a)
                        good[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in good], names=["a", "b"])

    rows = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(check, "a long, b long")


def usual_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur among SAMPLE_DOCS texts (id, text), sorted, and how often: at most USUAL of them, the most frequent."""

    def rows(c):
        return {"key": np.concatenate([np.zeros(0, np.int64), *(np.unique(shingle_hashes(words(t), width)).view(np.int64) for t in c["text"])])}

    found = map_rows(hash_sample(texts, SAMPLE_DOCS, "id").select("text"), rows, "key long").groupBy("key").agg(F.count("*").alias("c"))
    found = found.where("c > 2").orderBy(F.desc("c"), "key").limit(USUAL).orderBy("key").toArrow()
    return found.column("key").to_numpy().astype(np.int64), found.column("c").to_numpy().astype(np.int64)


def prefixes(texts: DataFrame, width: int, least: float) -> DataFrame:
    """key, salt, n, id: of every text (id, text) with n different shingles the first n - ceil(least * n) + 1. Equal texts have
    equal ids, and a task gives the rows of an id once, so that a group of copies has no more rows of a key than there are tasks.

    All texts order their shingles alike, those of `usual_shingles` last, so that two texts of a Jaccard similarity of at least
    `least` have their first common shingle among these of both, whatever the order. Usual shingles have salts from 1 on.
    """
    usual, often = usual_shingles(texts, width)

    def rows(c, seen: set):
        out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("key", "salt", "n", "id")}
        for ident, t in zip(c["id"], c["text"]):
            if ident in seen:
                continue
            seen.add(ident)
            keys = np.unique(shingle_hashes(words(t), width)).view(np.int64)
            n = len(keys)
            if not n:
                keys = np.zeros(1, np.int64)
            count = np.zeros(len(keys), np.int64)
            if len(usual):
                place = np.minimum(np.searchsorted(usual, keys), len(usual) - 1)
                count = np.where(usual[place] == keys, often[place], 0)
            first = np.lexsort((keys, count))[: n - ceil(least * n - 1e-9) + 1]
            out["key"].append(keys[first])
            out["salt"].append(np.where(count[first] > 0, 1 + ident % SALTS, 0))
            out["n"].append(np.full(len(first), n))
            out["id"].append(np.full(len(first), ident))
        return {k: np.concatenate(v) for k, v in out.items()}

    def run(batches):
        seen: set[int] = set()  # ids of this task's texts
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(rows(columns_of(batch), seen), schema=arrow_schema(schema))

    schema = "key long, salt long, n long, id long"
    return texts.select("id", "text").mapInArrow(run, schema)


def probed(texts: DataFrame, width: int, radius: int) -> DataFrame:
    """Pairs (a, b) of ids of texts (id, text; equal texts have equal ids) that connect all those whose SimHash fingerprints of
    `width`-word shingles differ by at most `radius` bits; the search runs over the distinct fingerprints."""
    fps = stored(fingerprints(texts, (width,), ("id",)).withColumnRenamed(f"fp{width}", "fp").distinct())
    least = stored(fps.groupBy("fp").agg(F.min("id").alias("least")))
    same = fps.join(least, "fp").where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    nodes = least.select(F.col("least").alias("id"), "fp", F.lit(0).cast("long").alias("other"))
    return same.unionByName(links(nodes, radius))


def alike(texts: DataFrame, lowest: DataFrame, width: int, least: float, radius: int) -> DataFrame:
    """Links (a, b) that connect all texts (id, doc_id, text; `lowest`: the smallest doc_id `low` of each id) with a Jaccard similarity of at least `least` over sets of word shingles.

    Candidates come first from the fingerprints: the pigeonhole search of `links` finds those within `radius` bits, of which the
    shingle sets keep the alike. What that misses is found exactly: what two texts share lies in the shared part of their prefixes or behind the prefix that ends first, hence the least
    number of shared prefix shingles. With the fingerprints' pairs each text is compared with the next smaller one of its shingles, if enough of
    them agree on it; then all pairs that share enough and are not connected yet. Pairs grow with the square of a group
    only where texts share rare shingles and stay unlike.
    """
    group = Window.partitionBy("key", "salt").orderBy("n", "id")
    found = prefixes(texts, width, least).withColumn("before", F.lag("id").over(group)).withColumn("small", F.lag("n").over(group))
    found = found.withColumn("next", F.lead("id").over(group)).where("not id <=> before and (salt > 0 or before is not null or next is not null)")
    shared = written(found.select("key", "salt", "n", "id", "before", "small"))

    def enough(rows: DataFrame) -> DataFrame:
        """Pairs of (a, b, low, high) in as many rows as a similarity of `least` takes, with texts of low <= high shingles."""
        rows = rows.where(F.col("low") >= F.col("high") * least - 1e-6).groupBy("a", "b", "low", "high").agg(F.count("*").alias("c"))
        need = (F.col("low") + F.col("high")) * (least / (1 + least)) - F.ceil(F.col("high") * least - 1e-9) + 1
        return stored(rows.where(F.col("c") >= need - 1e-6).select("a", "b"))

    def checked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().join(lowest, "id")
        asked = asked.select(F.col("id").alias("of"), "low")
        # one row of an id is moved, and copies with other ids of their own go elsewhere
        own = texts.join(asked, (F.col("id") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("id").agg(F.first("text").alias("text"))
        return stored(verified(pairs, written(own), width, least))

    def neighbours(rows: DataFrame) -> DataFrame:
        rows = rows.where("before is not null")
        return enough(rows.select(F.least("id", "before").alias("a"), F.greatest("id", "before").alias("b"), F.col("small").alias("low"), F.col("n").alias("high")))

    first = stored(probed(texts, width, radius).unionByName(neighbours(shared)).distinct())
    near = checked(first)
    # Usual shingles were looked at within their salts, so that a large group is in as many parts: their heads meet now.
    heads = connected(near).where("node = root").select(F.col("node").alias("id"))
    of_key = Window.partitionBy("key").orderBy("n", "id")
    rows = shared.where("salt > 0").select("key", "n", "id").join(heads, "id")
    again = neighbours(rows.withColumn("before", F.lag("id").over(of_key)).withColumn("small", F.lag("n").over(of_key)))
    again = stored(again.join(first, ["a", "b"], "left_anti"))
    near, first = stored(near.unionByName(checked(again))), first.unionByName(again)
    rows = shared.select("key", "n", "id").join(connected(near).withColumnRenamed("node", "id"), "id", "left")
    rows = rows.select("key", "n", "id", F.coalesce("root", "id").alias("root"))
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("n", "id", "root"))) for side in "xy")
    pairs = x.join(y, "key").where("id_x < id_y and root_x <> root_y")
    pairs = pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.least("n_x", "n_y").alias("low"), F.greatest("n_x", "n_y").alias("high"))
    return near.unionByName(checked(enough(pairs).join(first, ["a", "b"], "left_anti")))


def near_dedup(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of `docs` without near copies: of each group the row with the smallest doc_id stays.

    Groups are connected by equal texts and by all pairs with Jaccard similarity of at least `least` over `width`-word
    shingles; SimHash candidates within `radius` bits come first, an exact search finds the rest. Null and empty texts are equal texts. Columns stay as they are; of repeated rows one stays; null ids come last.
    """
    ident = F.xxhash64(whole_text())
    marked = docs.withColumn("__llm_id", ident)
    of = stored(marked.select("__llm_id", "doc_id").groupBy("__llm_id").agg(F.min("doc_id").alias("low")))
    texts = docs.select(ident.alias("id"), "doc_id", whole_text().alias("text"))
    roots = connected(stored(alike(texts, of.withColumnRenamed("__llm_id", "id"), width, least, radius)))
    of = of.join(roots, of.__llm_id == roots.node, "left").select("__llm_id", "low", F.coalesce("root", "__llm_id").alias("__llm_root"))
    of = of.join(of.groupBy("__llm_root").agg(F.min("low").alias("__llm_least")), "__llm_root").select("__llm_id", "__llm_root", "__llm_least")
    kept = marked.join(of, "__llm_id").where(F.col("doc_id").eqNullSafe(F.col("__llm_least")))
    return kept.dropDuplicates(["__llm_root"]).select(*docs.columns)
