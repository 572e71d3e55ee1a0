"""Removal of long repeated byte strings with suffix arrays and their common-prefix interval trees.

Texts are cut into overlapping segments: successive windows of `length` bytes whose smallest hashed SEED-gram is the same
occurrence form one segment. Equal windows have equal SEED-grams at equal offsets, so all occurrences of a repeated window
lie in segments with one hash. Hashes that occur once are dropped; equal segments of a hash need no further look. For the
hashes with different segments, tasks build a suffix array with longest common prefixes over the segments, scan it with a
stack into the tree of common-prefix intervals, and keep the intervals of at least `length` bytes whose left extensions
differ: the maximal repeats with all their occurrences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import arrow_schema, mixed, pieces, stored, whole_text, written

LENGTH, SEED = 200, 32
HOT_SEGMENTS = 4096
SORT_BYTES = 1 << 19
NONE = -(1 << 63)


def seed_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each position on (SEED is a power of two)."""
    h, width, base = buf.astype(np.uint64) + np.uint64(1), 1, np.array([0x9E3779B97F4A7C55], np.uint64)
    while width < SEED:
        h = h[:-width] * base + h[width:]
        base, width = base * base, width * 2
    return mixed(h)


def window_seeds(h: np.ndarray, count: int) -> np.ndarray:
    """For each run of `count` hashes the position of its smallest (the first among equals of the upper 40 bits)."""
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= count:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < count:
        key = np.minimum(key[: len(key) - (count - width)], key[count - width :])
    return (key & low).astype(np.int64)


def segments(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(seed hash, segment hash, start, bytes) of every segment of one text, in order; none if it is shorter than a window."""
    out = []
    step = (1 << 22) - length
    for at in range(0, len(text) - length + 1, step):
        part = text[at : at + step + length - 1]
        if len(part) < length:
            break
        h = seed_hashes(np.frombuffer(part, np.uint8))
        seed = window_seeds(h, length - SEED + 1)
        first = np.flatnonzero(np.concatenate([[True], np.diff(seed) != 0]))
        last = np.append(first[1:], len(seed)) - 1
        view = memoryview(part)
        for k, s, e in zip((h[seed[first]]).view(np.int64).tolist(), first.tolist(), (last + length).tolist()):
            out.append((k, signed_hash(view[s:e]), at + s, e - s))
    return out


def signed_hash(data) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def segment_table(docs: DataFrame, length: int) -> DataFrame:
    """h, g, doc, th, start, size: all segments of `docs` (doc, th, text)."""
    schema = arrow_schema("h long, g long, doc long, th long, start int, size int")

    def run(batches):
        for b in batches:
            ids, hashes = b.column("doc").to_pylist(), b.column("th").to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in pieces(texts):
                rows = [(k, g, ids[i], hashes[i], s, n) for i in range(lo, hi) for k, g, s, n in segments(texts[i], length)]
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000]), schema)], schema=schema)

    return docs.mapInArrow(run, "h long, g long, doc long, th long, start int, size int")


def suffix_order(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Suffix array of the window starts of several segments, with lcp to the suffix before, its segment and offset, and the byte left of it.

    Ranks of the first 8, 16, 32, ... bytes by doubling; a suffix ends with its segment. The left byte at a segment's start is
    unknown and counts as unlike any other (a negative number of its own).
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    buf = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    rest = np.repeat(base + sizes, sizes) - np.arange(total)
    word = np.zeros(total, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | np.where(rest > k, buf[k : total + k], 0).astype(np.uint64)
    _, rank = np.unique(word, return_inverse=True)
    _, rank = np.unique(rank * 9 + np.minimum(rest, 8), return_inverse=True)
    levels, width = [(8, rank)], 8
    longest = int(sizes.max())
    while width < longest:
        nxt = np.zeros(total, np.int64)
        inside = rest > width
        nxt[inside] = rank[np.flatnonzero(inside) + width] + 1
        _, rank = np.unique(rank * (total + 2) + nxt, return_inverse=True)
        width *= 2
        levels.append((width, rank))
    windows = np.flatnonzero(rest >= length)
    order = windows[np.argsort(rank[windows], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for width, r in reversed(levels):
        ok = (rest[a] - lcp >= width) & (rest[b] - lcp >= width)
        i, j = np.minimum(a + lcp, total - 1), np.minimum(b + lcp, total - 1)
        lcp += np.where(ok & (r[i] == r[j]), width, 0)
    for _ in range(7):
        ok = (rest[a] > lcp) & (rest[b] > lcp)
        i, j = np.minimum(a + lcp, total - 1), np.minimum(b + lcp, total - 1)
        lcp += ok & (buf[i] == buf[j])
    start = order == base[owner[order]]
    left = np.where(start, -1 - owner[order], buf[np.maximum(order - 1, 0)].astype(np.int64))
    return owner[order], order - base[owner[order]], np.concatenate([[0], lcp]), left


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(common length, first, last) of the left-diverse common-prefix intervals of at least `length` bytes, inner ones first.

    Runs whose left bytes are all equal hold none and are skipped whole.
    """
    out = []
    n = len(lcp)
    if not n:
        return out
    starts = np.flatnonzero(lcp < length)
    low, high = np.minimum.reduceat(left, starts), np.maximum.reduceat(left, starts)
    ends = np.append(starts[1:], n)
    for s, e in zip(starts[(low != high)].tolist(), ends[(low != high)].tolist()):
        lcps, lefts = [*lcp[s + 1 : e].tolist(), 0], left[s:e].tolist()
        stack: list[list] = []  # [common length, first position, left byte or None if they differ]
        for i, byte in enumerate(lefts):
            here, begin, mark = lcps[i], i, byte
            while stack and stack[-1][0] > here:
                depth, first, seen = stack.pop()
                seen = seen if seen == mark else None
                if seen is None:
                    out.append((depth, s + first, s + i))
                begin, mark = first, seen
            if here >= length:
                if stack and stack[-1][0] == here:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == mark else None
                else:
                    stack.append([here, begin, mark])
    return out


def covers(owner, offset, lcp, left, count: int, length: int) -> dict[int, list[tuple[int, int]]]:
    """Per segment the byte ranges covered by its maximal repeats."""
    best = np.zeros(len(owner), np.int64)
    for depth, first, last in maximal_repeats(lcp, left, length):
        np.maximum(best[first : last + 1], depth, out=best[first : last + 1])
    at = np.flatnonzero(best)
    at = at[np.lexsort((offset[at], owner[at]))]
    out: dict[int, list[tuple[int, int]]] = {}
    for o, s, n in zip(owner[at].tolist(), offset[at].tolist(), best[at].tolist()):
        mine = out.setdefault(o, [])
        if mine and s <= mine[-1][1]:
            mine[-1] = (mine[-1][0], max(mine[-1][1], s + n))
        else:
            mine.append((s, s + n))
    return out


def by_hash(batches):
    """Rows (h, g, data) of streamed batches, whole hashes together, about SORT_BYTES at a time."""
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(b.column("h").to_pylist(), b.column("g").to_pylist(), b.column("data").to_pylist()):
            if size > SORT_BYTES and row[0] != rows[-1][0]:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield rows


def repeats_in(segs: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """Suffix arrays over segments (h, g, data; each once): covered ranges (h, g, lo, hi) or, with groups=True, every maximal
    repeat as rows (h, repeat, size, g, lo) of its occurrences."""
    ddl = "h long, repeat long, size int, g long, lo int" if groups else "h long, g long, lo int, hi int"
    schema = arrow_schema(ddl)

    def run(batches):
        for rows in by_hash(batches):
            owner, offset, lcp, left = suffix_order([r[2] for r in rows], length)
            out = []
            if groups:
                for depth, first, last in maximal_repeats(lcp, left, length):
                    text = rows[owner[first]][2][offset[first] : offset[first] + depth]
                    mark = signed_hash(text)
                    out += [(rows[o][0], mark, depth, rows[o][1], s) for o, s in zip(owner[first : last + 1].tolist(), offset[first : last + 1].tolist())]
            else:
                for o, ranges in covers(owner, offset, lcp, left, len(rows), length).items():
                    out += [(rows[o][0], rows[o][1], s, e) for s, e in ranges]
            for at in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 20_000]), schema)], schema=schema)

    return segs.select("h", "g", "data").repartition("h").sortWithinPartitions("h", "g").mapInArrow(run, ddl)


def repeats_of_hot(segs: DataFrame, length: int) -> DataFrame:
    """The ranges of `repeats_in` for hashes with very many different segments: windows are dealt out by their full hash,
    the deepest level of the tree, so that no task holds a hash whole."""
    ddl = "w long, h long, g long, lo int"

    def run(batches):
        for b in batches:
            for h, g, data in zip(b.column("h").to_pylist(), b.column("g").to_pylist(), b.column("data").to_pylist()):
                n, view = len(data) - length + 1, memoryview(data)
                yield pa.RecordBatch.from_arrays([
                    pa.array([signed_hash(view[s : s + length]) for s in range(n)], pa.int64()), pa.array([h] * n, pa.int64()),
                    pa.array([g] * n, pa.int64()), pa.array(range(n), pa.int32()),
                ], names=["w", "h", "g", "lo"])

    windows = segs.select("h", "g", "data").mapInArrow(run, ddl)
    many = windows.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    return windows.join(many, ["h", "w"]).select("h", "g", "lo", (F.col("lo") + length).alias("hi"))


def repeated_ranges(rows: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc, th, lo, hi: ranges of bytes covered by repeated strings, for `rows` (doc, th, text; see `dedup_substrings`)."""
    every = written(segment_table(rows, length))
    hashes = every.groupBy("h").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).where("n > 1")
    # written, so that the join below has plain exchanges on both sides, which Spark can split at a hot hash
    hashes = written(hashes.select("h", (F.col("low") != F.col("high")).alias("mixed")))
    again = written(every.join(hashes, "h"))
    equal = again.where("not mixed").select("doc", "th", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    unlike = again.where("mixed")
    distinct = stored(unlike.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "start", "size")).alias("at")))
    wide = stored(distinct.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot_segments).select("h"))
    cut = F.expr("substring(cast(text as binary), at.start + 1, at.size)")
    # one row for each (doc, th): of repeated rows any will do
    one = F.expr("row_number() over (partition by doc, th order by doc) = 1")
    texts = rows.withColumn("one", one).where("one").select("doc", "th", "text")
    data = written(distinct.select("h", "g", "at", F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).join(texts, ["doc", "th"]).select("h", "g", cut.alias("data")))
    found = repeats_in(data.join(wide, "h", "left_anti"), length)
    if not wide.isEmpty():
        found = found.unionByName(repeats_of_hot(data.join(wide, "h"), length))
    whole = distinct.where("n > 1").select("h", "g", F.lit(0).alias("lo"), F.col("at.size").alias("hi"))
    within = unlike.select("h", "g", "doc", "th", "start").join(found.unionByName(whole), ["h", "g"])
    return equal.unionByName(within.select("doc", "th", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))


def maximal_repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """repeat, size, doc_id, start: maximal repeats between different segments, one row per occurrence (bytes).

    A repeat longer than a segment comes as the pieces that segments hold; equal segments are one occurrence of the piece for
    each of their places.
    """
    rows = keyed(docs)
    every = written(segment_table(rows.select("doc", "th", "text"), length))
    hashes = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = written(every.join(hashes, "h"))
    first = again.groupBy("h", "g").agg(F.min(F.struct("doc", "th", "start", "size")).alias("at"), F.count("*").alias("n"))
    cut = F.expr("substring(cast(text as binary), at.start + 1, at.size)")
    texts = rows.dropDuplicates(["doc", "th"]).select("doc", "th", "text")
    data = written(first.select("h", "g", "n", "at", F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).join(texts, ["doc", "th"]).select("h", "g", "n", cut.alias("data")))
    groups = repeats_in(data, length, groups=True)
    whole = data.where("n > 1").select("h", F.col("g").alias("repeat"), F.length("data").alias("size"), "g", F.lit(0).alias("lo"))
    places = again.select("h", "g", "doc", "start")
    return groups.unionByName(whole).join(places, ["h", "g"]).select(
        "repeat", "size", F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id"), (F.col("start") + F.col("lo")).alias("start")
    ).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row of `docs` (doc_id, text).

    Every byte covered by a `length`-byte string that also starts anywhere else in the table goes, in all its places. Bytes are
    those of UTF-8, so what is kept may start inside a character. Null texts are empty; texts shorter than `length` stay
    whole; repeated rows are copies of each other; columns of other names are left aside; an empty table gives an empty one.
    """
    rows = keyed(docs)
    ranges = repeated_ranges(rows.select("doc", "th", "text"), length, hot_segments)
    spans = ranges.groupBy("doc", "th").agg(F.collect_set(F.col("lo").cast("long") * (1 << 31) + F.col("hi")).alias("spans"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            out = []
            for d, t, s in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                out.append((d, len(t), *removed(t, s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.join(spans, ["doc", "th"], "left").select("doc_id", "text", "spans").mapInArrow(run, ddl)


def removed(text: bytes, spans: list[int] | None) -> tuple[int, int, bytes, str]:
    """Bytes and runs removed, what is kept, and its digest."""
    runs: list[list[int]] = []
    for v in sorted(spans or ()):
        lo, hi = v >> 31, v & ((1 << 31) - 1)
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text) - len(rest), len(runs), rest, hashlib.sha256(rest).hexdigest()
