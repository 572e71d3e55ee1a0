"""Quartile bucket digests of texts.

Every window of five bytes gives six hashed byte triplets (the newest byte with each pair of the other four), counted in 128
buckets. The digest keeps, per bucket, the quartile its count falls into, and the logarithm of the length. Two digests
differ by the sum of their quartile steps (a step of three counts twice) and of the difference in length, at most LIMIT.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.common import stored, whole_text

BUCKETS, LENGTH_STEPS = 128, 64
LIMIT = 6 * BUCKETS + LENGTH_STEPS
STEP = np.array([0, 1, 2, 6])
CHUNK = 1 << 18
MOST_RANGES = 20_000  # bounds the list of cuts; ranges are streamed, so their length costs no memory


def pair_tables() -> list[np.ndarray]:
    """Six tables of 65,536 16-bit numbers, one per pair of older bytes, from a fixed seed."""
    rng = np.random.default_rng(20)
    return [rng.integers(0, 1 << 16, 1 << 16, dtype=np.uint16) for _ in range(6)]


TABLES = pair_tables()
PAIRS = list(combinations((1, 2, 3, 4), 2))
NEWEST = np.random.default_rng(21).integers(0, 1 << 16, 256, dtype=np.uint16)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many of the text's triplets fall into each bucket; texts under five bytes have none."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 4, 0), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 4, len(data) - at), at)
        n = len(b) - 4
        wide = b.astype(np.uint16)
        new = NEWEST[b[4:]]
        for table, (i, j) in zip(TABLES, PAIRS):
            pair = (wide[4 - i : 4 - i + n] << np.uint16(8)) | wide[4 - j : 4 - j + n]
            total += np.bincount(((table[pair] ^ new) * np.uint16(40503)) >> np.uint16(9), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """66 hex digits: one byte of length, 32 bytes of quartiles (four buckets a byte). Equal texts have equal digests."""
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    q1, q2, q3 = (ranked[BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    level = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = level[0::4] << 6 | level[1::4] << 4 | level[2::4] << 2 | level[3::4]
    length = min(255, int(round(12 * np.log2(1 + len(data))))) if len(data) else 0
    return bytes([length]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Steps between two digests, from 0 to LIMIT."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8).astype(np.int64) for s in (a, b))
    shifts = np.array([6, 4, 2, 0])
    steps = np.abs(((x[1:, None] >> shifts) & 3) - ((y[1:, None] >> shifts) & 3))
    return int(STEP[steps].sum() + min(LENGTH_STEPS, abs(x[0] - y[0])))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    return 1.0 - difference(a, b) / LIMIT


def fingerprint_documents(docs: DataFrame, rows_per_range: int = 4000) -> DataFrame:
    """doc_id, n_chars, fingerprint, next_doc_id, edited (text), edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by the start of the next document's text (ascending doc_id; after
    the last the first; a table of one row follows itself). Null ids come first, equal ids by hash of their texts; null
    texts are empty. Documents are dealt out by ranges of doc_id between quantiles, sorted inside; the first document of
    each range is also given to the range before. Repeated rows stay; other columns are left aside.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    low = rows.agg(F.count("*").alias("n")).first().n
    parts = min(MOST_RANGES, max(1, -(-low // rows_per_range), docs.sparkSession.sparkContext.defaultParallelism * 2))
    at = [k / parts for k in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 10 * parts).alias("c")).first().c or []))
    placed = rows.withColumn("part", range_of(cuts)).withColumn("h", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("told"), "doc_id", "h")
    at_first = stored(placed.groupBy("part").agg(F.min(order).alias("f")))  # at most MOST_RANGES small rows: broadcast
    at_first = at_first.select(F.col("part").alias("p"), F.col("f.doc_id").alias("d"), F.col("f.h").alias("x"))
    is_first = (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))
    firsts = stored(placed.join(F.broadcast(at_first), is_first, "left_semi").dropDuplicates(["part"]))
    turn = sorted(r.part for r in firsts.select("part").collect())
    before = {p: turn[i - 1] for i, p in enumerate(turn)}
    heads = firsts.replace(before, subset=["part"]) if len(turn) > 1 else firsts
    heads = heads.select("doc_id", "text", "part", "h", F.lit(1).alias("head"))
    both = placed.withColumn("head", F.lit(0)).select("doc_id", "text", "part", "h", "head").unionByName(heads)
    both = both.repartition(max(1, len(turn)), "part").sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_first(), "h")

    def compare(batches):
        held = None
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "head")]
            for d, t, part, head in zip(*cols):
                mark = None if head and held is None else digest(t.encode())
                if held is not None and held[2] == part:
                    out.append(described(held, d, t, mark))
                held = None if head else (d, t, part, mark)
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(OUT.names)}, schema=OUT)

    return both.mapInArrow(compare, DDL)


DDL = "doc_id long, n_chars long, fingerprint string, next_doc_id long, edited string, edited_fingerprint string, near_edited double, near_next double"
OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("next_doc_id", pa.int64()), ("edited", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def range_of(cuts: list[int]):
    """How many of the ascending cuts are at or below doc_id; 0 for a null id."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right").astype(np.int32))

    return of(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))


def described(row, next_id, next_text, next_mark):
    d, text, _, mark = row
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    other = digest(edited.encode())
    return d, len(text), mark, next_id, edited, other, likeness(mark, other), likeness(mark, next_mark)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
