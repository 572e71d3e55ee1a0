"""Benchmark decontamination by spaced seeds.

A window of `window` tokens is split into `subs` + 2 interleaved groups; each mask keeps two groups and ignores the others.
With at most `subs` substitutions at least two groups are untouched, so some mask hashes equally: no overlap is missed.
Hashes of all windows of the benchmark and of the documents are tables that are joined; every pair of equal hashes gives an
alignment, along which the tokens of both are compared, and spans made of windows with few enough differences are reported.

Documents only send hashes that pass a filter of fixed size over the benchmark's hashes, which says no to nearly all others.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import arrow_schema, mixed, pieces, token_arrays, whole_text, written

WINDOW, SUBS, SHORTEST = 13, 2, 5
FACTORS = mixed(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
FILTER_BITS, PART_BITS = 26, 16  # 8 MB, built as rows of 8 KB: the size does not depend on the benchmark
HOT = 5000  # document hits of one hash from which it is dealt out
SALTS = 32


def seed_masks(window: int, subs: int) -> list[np.ndarray]:
    """The positions each mask looks at."""
    groups = [np.arange(g, window, subs + 2) for g in range(subs + 2)]
    return [np.sort(np.concatenate(pair)) for pair in combinations(groups, 2)]


def allowed(length: int, window: int, subs: int) -> tuple[int, int]:
    """Tokens of a window of an item and the differences it may have: shorter items are one window, with differences in proportion."""
    return (window, subs) if length >= window else (length, subs * length // window)


def all_masks(lengths: list[int], window: int, subs: int) -> list[tuple[int, np.ndarray, int]]:
    """(tokens of a window, positions, number) of every mask for items of some lengths."""
    out = []
    for span, most in sorted({allowed(n, window, subs) for n in lengths}):
        out += [(span, mask, 100 * span + k) for k, mask in enumerate(seed_masks(span, most))]
    return out


def masked_hashes(tokens: np.ndarray, mask: np.ndarray, span: int, salt: int) -> np.ndarray:
    """Hash of the tokens under the mask, for every window of `span` tokens."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(salt * 2654435761 + 1))
    for k, p in enumerate(mask.tolist()):
        h += tokens[p : p + n] * FACTORS[k % len(FACTORS)]
    return mixed(h)


ITEM = "item long, item_id long, tokens array<long>"
SEED = "hash long, item long, start int"
HIT = "hash long, doc long, start int"


def benchmark_items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """item (key), item_id, tokens of the distinct rows of `shortest` tokens or more."""

    def run(batches):
        for b in batches:
            keys, ids, texts = (b.column(c) for c in ("item", "item_id", "text"))
            lists = [token_arrays([t])[0].view(np.int64) for t in texts.cast(pa.binary()).to_pylist()]
            keep = pa.array([len(t) >= shortest for t in lists], pa.bool_())
            rows = pa.RecordBatch.from_arrays([keys, ids.cast(pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=arrow_schema(ITEM))
            yield rows.filter(keep)

    rows = benchmark.select("item_id", whole_text().alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    return rows.mapInArrow(run, ITEM)


def item_seeds(items: DataFrame, masks: list, window: int, subs: int) -> DataFrame:
    """hash, item, start of every masked window of the items."""

    def run(batches):
        for b in batches:
            for key, tokens in zip(b.column("item").to_pylist(), b.column("tokens")):
                t = tokens.values.to_numpy().view(np.uint64)
                width = allowed(len(t), window, subs)[0]
                for span, mask, salt in masks:
                    if span == width:
                        h = masked_hashes(t, mask, span, salt).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), key)), pa.array(np.arange(len(h), dtype=np.int32))], schema=arrow_schema(SEED))

    return items.mapInArrow(run, SEED)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter of each hash."""
    bits = np.uint64((1 << FILTER_BITS) - 1)
    return (h & bits).astype(np.int64), (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds as bytes. They are set in tasks, part by part; 2 ** (FILTER_BITS - 3) bytes reach the driver at most."""
    ends = F.array(F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), F.shiftrightunsigned("hash", 64 - FILTER_BITS))
    set_ = seeds.select(F.explode(ends).alias("at")).distinct()
    parts = set_.groupBy(F.shiftright("at", PART_BITS).alias("part")).agg(
        F.collect_set(F.col("at").bitwiseAND(F.lit((1 << PART_BITS) - 1)).cast("int")).alias("bits")
    )
    schema = "part long, bits binary"

    def run(batches):
        for b in batches:
            rows = []
            for bits in b.column("bits"):
                flags = np.zeros(1 << PART_BITS, np.uint8)
                flags[bits.values.to_numpy()] = 1
                rows.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part").cast(pa.int64()), pa.array(rows, pa.binary())], schema=arrow_schema(schema))

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for r in parts.mapInArrow(run, schema).toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def document_hits(rows: DataFrame, masks: list, bits: np.ndarray) -> DataFrame:
    """hash, doc, start of every masked window of the documents (doc, text) whose hash may be one of the benchmark's."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def holds(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def run(batches):
        filter_ = sent.value
        for b in batches:
            keys, texts = b.column("doc").to_numpy(), b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in pieces(texts):
                tokens, _, _, first = token_arrays(texts[lo:hi])
                for span, mask, salt in masks:
                    h = masked_hashes(tokens, mask, span, salt)
                    one, two = places(h)
                    at = np.flatnonzero(holds(filter_, one))
                    at = at[holds(filter_, two[at])]
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + span <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[at].view(np.int64)), pa.array(keys[lo + doc]), pa.array((at - first[doc]).astype(np.int32))], schema=arrow_schema(HIT)
                        )

    return rows.mapInArrow(run, HIT)


def joined_hits(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc, item, shift (document position minus item position) of all equal hashes. Hashes that many documents hold are dealt out."""
    hits = written(hits)
    hot = hits.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)
    left = hits.join(hot, "hash", "left").select("hash", "doc", F.col("start").alias("at"), salt.alias("salt"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = seeds.join(hot, "hash", "left").select("hash", "item", "start", F.explode(every).alias("salt"))
    return left.join(right, ["hash", "salt"]).select("doc", "item", (F.col("at") - F.col("start")).alias("shift")).distinct()


SLICE = "doc_id long, item long, shift int, low int, tokens array<long>, first array<int>, last array<int>"


def aligned_slices(rows: DataFrame) -> DataFrame:
    """Of each alignment of a document (doc_id, text, aligned: item, shift, n tokens of the item) the document's tokens along it, from
    the item's token `low` on, and the code points where they start and end."""

    def run(batches):
        for b in batches:
            out = []
            for i, t, aligned in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("aligned").to_pylist()):
                tokens, starts, ends, _ = token_arrays([t])
                tokens = tokens.view(np.int64)
                if not t.isascii():  # byte places to code points
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                    starts, ends = chars[starts], chars[ends]
                for a in aligned:
                    low, high = max(0, -a["shift"]), min(a["n"], len(tokens) - a["shift"])
                    part = slice(low + a["shift"], high + a["shift"])
                    out.append((i, a["item"], a["shift"], low, tokens[part], starts[part].astype(np.int32), ends[part].astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow_schema(SLICE))], schema=arrow_schema(SLICE))

    return rows.select("doc_id", "text", "aligned").mapInArrow(run, SLICE)


def spans(doc: np.ndarray, item: np.ndarray, width: int, most: int) -> list[tuple[int, int, int]]:
    """(first, end, differing tokens) of spans along two aligned token lists: runs of windows of `width` with at most `most`
    differences, ends on equal tokens."""
    same = doc == item
    if len(same) < width:
        return []
    wrong = np.concatenate([[0], np.cumsum(~same)])
    good = np.flatnonzero(wrong[width:] - wrong[:-width] <= most)
    out: list[list[int]] = []
    for s in good.tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = s + width
        else:
            out.append([s, s + width])
    done = []
    for s, e in out:
        equal = np.flatnonzero(same[s:e])
        s, e = s + int(equal[0]), s + int(equal[-1]) + 1
        done.append((s, e, int(wrong[e] - wrong[s])))
    return done


DDL = "doc_id long, item_id long, first_token long, end_token long, n_diff long, first_char long, end_char long"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, subs: int = SUBS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, first_token, end_token, n_diff, first_char, end_char (code points) of every overlap of a document row and
    a benchmark item: one row for each span along each alignment. Documents without overlap have no row.

    Tokens are words between ASCII white space, A-Z lower-cased. An overlap is a run of windows of `window` aligned tokens of
    which at most `subs` differ; an item of fewer tokens must occur whole, with differences in proportion (rounded down); items
    under `shortest` tokens never match. Null texts are empty; repeated rows of `docs` give repeated results, repeated rows of
    `benchmark` count once; null ids stay null; of equal spans along several alignments each is a row; other columns are left
    aside; empty tables give an empty result.
    """
    items = written(benchmark_items(benchmark, shortest))
    n = F.size("tokens")
    lengths = [r.n for r in items.select(F.least(n, F.lit(window)).alias("n")).distinct().collect()]  # at most `window` values
    masks = all_masks(lengths, window, subs)
    seeds = written(item_seeds(items, masks, window, subs))
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    hits = document_hits(rows.select("doc", "text"), masks, seed_filter(seeds))
    found = joined_hits(hits, seeds).join(items.select("item", n.alias("n")), "item")
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("item", "shift", "n")).alias("aligned"))
    slices = aligned_slices(rows.join(per_doc, "doc"))
    paired = slices.join(items.select("item", "item_id", F.col("tokens").alias("want")), "item")

    def run(batches):
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("doc_id", "item_id", "shift", "low")]
            lists = [b.column(c) for c in ("tokens", "want", "first", "last")]
            for k, (i, item_id, shift, low) in enumerate(zip(*columns)):
                tokens, want, first, last = (c[k].values.to_numpy() for c in lists)
                for s, e, wrong in spans(tokens, want[low : low + len(tokens)], *allowed(len(want), window, subs)):
                    out.append((i, item_id, s + low + shift, e + low + shift, wrong, int(first[s]), int(last[e - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow_schema(DDL))], schema=arrow_schema(DDL))

    return paired.select("doc_id", "item_id", "shift", "low", "tokens", "want", "first", "last").mapInArrow(run, DDL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that overlap no benchmark item; columns as they are. Rows with a null id are told apart by text; repeated
    rows stay or go together; an empty benchmark leaves all rows."""
    key = F.xxhash64("doc_id", whole_text())
    marked = docs.withColumn("__llm_row", key)
    bad = contaminated_spans(marked.select(F.col("__llm_row").alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("__llm_row")).distinct()
    return marked.join(bad, "__llm_row", "left_anti").select(*docs.columns)
