"""Alignment of two tokenizations of the same bytes by a galloping intersection of their token ends.

The shorter list of ends drives: each of its ends is looked for in the longer list by doubling steps from where the last one was
found, then by binary search. Ends found in both cut the tokens into groups, and the ranks of two neighbouring ends tell which
tokens of the longer list overlap the token between them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.llm.bpe import TextEncoder, Vocabulary, file_bytes, vocabulary
from tracelattice.llm.common import arrow_schema, written

BLOCK_BYTES = 2 << 20
LANE = 64  # ends that one lane of the galloping search looks up, one after the other

ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, at array<int>, times array<int>, pairs array<long>, held array<long>"
DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def gallop(short: np.ndarray, long: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every entry of `short` how many entries of `long` are below it.

    Both are ascending and the last entry of `long` is no smaller than any of `short`. `first` are the positions in `short` where a
    list begins, `start` those in `long` where its counterpart does. All lists advance side by side in lanes of at most LANE entries.
    """
    rank = np.zeros(len(short), np.int64)
    size = np.diff(np.append(first, len(short)))
    lanes = -(-size // LANE)
    at = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(at + LANE, np.repeat(first + size, lanes))
    low, last = np.repeat(start, lanes), len(long) - 1
    while len(at):
        value, reach, width = short[at], np.zeros(len(at), np.int64), 1
        going = np.arange(len(at))
        while len(going):  # entries low .. low + reach - 1 are below the value
            going = going[long[np.minimum(low[going] + (width - 1), last)] < value[going]]
            reach[going] = width
            width *= 2
        left, right = low + reach, np.minimum(low + np.maximum(2 * reach, 1) - 1, last)
        wide = np.flatnonzero(left < right)
        while len(wide):
            middle = (left[wide] + right[wide]) // 2
            below = long[middle] < value[wide]
            left[wide] = np.where(below, middle + 1, left[wide])
            right[wide] = np.where(below, right[wide], middle)
            wide = wide[left[wide] < right[wide]]
        rank[at] = left
        at, low = at + 1, left + (long[left] == value)
        more = at < stop
        at, stop, low = at[more], stop[more], low[more]
    return rank


class Aligned:
    """Groups and overlaps of the two token lists of several texts, both given as one array of token sizes in bytes and the number
    of tokens of every text. The sizes of a text have the same sum in both lists; none is zero.

    of_a, of_b: for each A and B token the number of its group; doc_groups: groups of every text; a, b: overlapping tokens.
    """

    def __init__(self, sizes_a: np.ndarray, n_a: np.ndarray, sizes_b: np.ndarray, n_b: np.ndarray):
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        a_drives = n_a <= n_b
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        place_a, place_b = np.arange(len(ends_a)), np.arange(len(ends_b))
        # Of every text the shorter list, then the longer one, as one array each.
        short, short_from = self.woven(a_drives, n_a, n_b, doc_a, doc_b, ends_a, ends_b, place_a, place_b)
        long, long_from = self.woven(~a_drives, n_a, n_b, doc_a, doc_b, ends_a, ends_b, place_a, place_b)
        n_short, n_long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        full = n_short > 0
        first, start = (np.cumsum(n) - n for n in (n_short, n_long))
        rank = gallop(short, long, first[full], start[full]) if len(short) else np.zeros(0, np.int64)
        found = long[rank] == short if len(short) else np.zeros(0, bool)
        common = np.zeros(len(long), bool)
        common[rank[found]] = True
        group_short, group_long = np.cumsum(found) - found, np.cumsum(common) - common
        drives = a_drives[np.repeat(np.arange(len(n_a)), n_short)]
        long_is_a = ~a_drives[np.repeat(np.arange(len(n_a)), n_long)]
        self.of_a, self.of_b = np.zeros(len(ends_a), np.int64), np.zeros(len(ends_b), np.int64)
        self.of_a[short_from[drives]], self.of_b[short_from[~drives]] = group_short[drives], group_short[~drives]
        self.of_a[long_from[long_is_a]], self.of_b[long_from[~long_is_a]] = group_long[long_is_a], group_long[~long_is_a]
        sums = np.concatenate([[0], np.cumsum(found)])
        bounds = np.append(first, len(short))
        self.doc_groups = np.diff(sums[bounds])
        # From the entry after those below or at the last end, up to the one that reaches this end.
        low = np.concatenate([[0], (rank + found)[:-1]]) if len(rank) else rank
        many = rank - low + 1
        i = np.repeat(np.arange(len(short)), many)
        j = np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(i))
        flip = ~drives[i]
        self.a = np.where(flip, long_from[j], short_from[i])
        self.b = np.where(flip, short_from[i], long_from[j])

    @staticmethod
    def woven(takes_a, n_a, n_b, doc_a, doc_b, ends_a, ends_b, place_a, place_b):
        """Text after text either its A or its B ends, and where each stands in its own array."""
        sizes = np.where(takes_a, n_a, n_b)
        from_a, from_b = takes_a[doc_a], ~takes_a[doc_b]
        ends, place = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), np.int64)
        side = np.repeat(takes_a, sizes)
        ends[side], ends[~side] = ends_a[from_a], ends_b[from_b]
        place[side], place[~side] = place_a[from_a], place_b[from_b]
        return ends, place


@lru_cache(2)
def pieces_of(model: bytes):
    """A piece model's processor and the bytes of each of its pieces, once in each Python worker."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return processor, out


class Labels:
    """Decimal token numbers with what follows them: a comma, or the mark at the end of their part of a group."""

    def __init__(self, n: int, mark: str):
        self.table = np.array([f"{i}{end}" for i in range(n) for end in (",", mark)], dtype=object)

    def of(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.table[2 * ids + last]


class BlockAligner:
    """Encodes and aligns the texts of a block."""

    def __init__(self, json_bytes: bytes, model: bytes):
        self.vocab: Vocabulary = vocabulary(json_bytes)
        self.encoder = TextEncoder(self.vocab, special=False)
        self.processor, b_bytes = pieces_of(model)
        self.bytes_b = np.array(b_bytes, dtype=object)
        self.size_a, self.size_b = np.array(list(map(len, self.vocab.bytes_of))), np.array(list(map(len, b_bytes)))
        self.labels_a, self.labels_b = Labels(len(self.size_a), "|"), Labels(len(self.size_b), ";")

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Token numbers of both vocabularies; none for texts that are null or empty, or whose tokens are not space + text."""
        full = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        got_a = self.encoder.encode([" " + texts[i] for i in full])
        got_b = self.processor.encode([texts[i] for i in full], num_threads=1)
        for i, x, y in zip(full, got_a, got_b):
            x, y = np.frombuffer(x, "<u4").astype(np.int64), np.array(y, np.int64)
            # A keeps every byte by construction: its words are the text, and a word's tokens are its bytes.
            if self.size_b[y].all() and b"".join(self.bytes_b[y]) == (" " + texts[i]).encode():
                a[i], b[i] = x, y
        return a, b

    def rows(self, block: int, ids: list, texts: list[str | None], digests: bool) -> pa.RecordBatch:
        a, b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = Aligned(self.size_a[a], n_a, self.size_b[b], n_b)
        doc = np.repeat(np.arange(len(ids)), n_a)[pairs.a]
        codes, at = np.unique(a[pairs.a] * len(self.size_b) + b[pairs.b], return_inverse=True)
        held, times = np.unique(doc * max(len(codes), 1) + at, return_counts=True)
        held_doc, held_at = held // max(len(codes), 1), held % max(len(codes), 1)
        cut = np.searchsorted(held_doc, np.arange(len(ids) + 1))
        groups = self.group_texts(a, b, n_a, n_b, pairs)
        if digests:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        n = len(ids)
        lists = pa.array(np.append(cut, cut[-1]).astype(np.int32))

        def per_doc(values):
            got = pa.ListArray.from_arrays(lists, pa.array(values.astype(np.int32)))
            return pa.concat_arrays([got.slice(0, n), pa.nulls(1, got.type)])

        one = lambda values: pa.array([*values, None], pa.int64())  # noqa: E731 (the last row of a block is its list of pairs)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, block)), pa.array([*ids, None], pa.int64()), one(n_a.tolist()), one(n_b.tolist()),
            one(pairs.doc_groups.tolist()), one(np.bincount(doc, minlength=n).tolist()), pa.array([*groups, None], pa.string()),
            per_doc(held_at), per_doc(times),
            pa.array([None] * n + [codes], pa.list_(pa.int64())),
            pa.array([None] * n + [np.bincount(held_at, minlength=len(codes))], pa.list_(pa.int64())),
        ], schema=arrow_schema(ROWS))

    def group_texts(self, a, b, n_a, n_b, pairs: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2,b3`: the groups of every text, empty without tokens."""
        out = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = (np.append(of[1:] != of[:-1], True)[: len(of)] for of in (pairs.of_a, pairs.of_b))
        before_a, before_b = np.searchsorted(pairs.of_a, pairs.of_b, "right"), np.searchsorted(pairs.of_b, pairs.of_a)
        out[np.arange(len(a)) + before_b] = self.labels_a.of(a, last_a)
        out[np.arange(len(b)) + before_a] = self.labels_b.of(b, last_b)
        ends = np.cumsum(n_a + n_b)
        return ["".join(out[s:e])[:-1] for s, e in zip(ends - n_a - n_b, ends)]


def aligned_rows(docs: DataFrame, json_path: str, model_path: str, digests: bool) -> DataFrame:
    """The rows of all texts and of all blocks, encoded and aligned once and stored in the shared folder."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((file_bytes(json_path), file_bytes(model_path)))

    def run(batches):
        aligner, part, n = BlockAligner(*files.value), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if ids and size + len(t or "") > BLOCK_BYTES:
                    yield aligner.rows((part << 32) + n, ids, texts, digests)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield aligner.rows((part << 32) + n, ids, texts, digests)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS), compression="zstd")


def block_pairs(rows: DataFrame) -> DataFrame:
    """block, i, pair, held: the distinct pairs of every block by their place there, and how many of its texts hold them linked."""
    lists = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("i", "p"))
    return lists.select("block", "i", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))


def pair_counts(rows: DataFrame, second: int) -> DataFrame:
    """pair, n, best: in how many documents each pair (A id * `second` + B id) is linked; is that the most of its A id, ties included."""
    totals = block_pairs(rows).groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.expr(f"pair div {second}"))
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    return totals.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def piece_count(model_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()


def linked_tokens(docs: DataFrame, json_path: str, model_path: str) -> DataFrame:
    """a, b, n, best: every pair of tokens that overlap in some document, in how many documents they do, and whether that is the
    most of this A token. Cases as in `align_documents`."""
    second = piece_count(model_path)
    counts = pair_counts(aligned_rows(docs, json_path, model_path, True), second)
    return counts.select(F.expr(f"pair div {second}").alias("a"), (F.col("pair") % second).alias("b"), "n", "best")


def align_documents(docs: DataFrame, json_path: str, model_path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of `docs` (doc_id, text).

    A is a byte-level BPE file (JSON), B a piece model, both paths on the driver; special tokens are plain text. Both encode a
    space and the text. Byte places where tokens of both end cut them into groups, written `a1,a2|b1;a3|b2,b3` (with `digests`
    as SHA-256 of that). A link is a pair of token occurrences whose bytes overlap; its count is the number of rows of `docs` that
    hold this pair of tokens linked, n_best counts links whose count is the highest of their A token, ties included. Null and
    empty texts, and those that a vocabulary does not keep byte by byte, have no tokens: zeros and an empty string. Repeated rows
    are documents of their own; null ids and other columns do no harm; an empty table gives an empty result.

    Blocks of 2 MB of text (or one longer text) are encoded and aligned once and stored, with the distinct pairs of each block. Their
    counts, summed over all blocks, come back to the blocks that hold them.
    """
    rows = aligned_rows(docs, json_path, model_path, digests)
    answers = block_pairs(rows).join(pair_counts(rows, piece_count(model_path)), "pair").select(F.col("block").alias("to"), "i", "n", "best")
    texts = rows.where("pairs is null").drop("pairs", "held")

    def answered(block: pa.Table, reply: pa.Table) -> pa.Table:
        i, n, best = (reply.column(c).to_numpy(zero_copy_only=False) for c in ("i", "n", "best"))
        count, top = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        count[i], top[i] = n, best
        at, times = (block.column(c).combine_chunks() for c in ("at", "times"))
        cut, held, many = at.offsets.to_numpy(), at.values.to_numpy(), times.values.to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(many * x[held])])[cut] for x in (top, count)]
        out = block.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(np.diff(sums[0]))).append_column("count_sum", pa.array(np.diff(sums[1])))
        return out.append_column("groups", block.column("groups")).cast(arrow_schema(DDL))

    return texts.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(answered, DDL)
