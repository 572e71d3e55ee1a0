"""TF-IDF over messages or documents, and its low-rank projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.functions.scalars import WHITE_SPACE, clean_text
from tracelattice.functions.vectors import l2_normalise, vector_sum
from tracelattice.operators.packed import matrix, nested, offsets
from tracelattice.operators.propagate import dense
from tracelattice.session import brief_shuffles, remove_table, stored_table

OVERSAMPLE, SEED = 10, 42


def messages(log: DataFrame, column: str = "message") -> DataFrame:
    """Distinct messages."""
    return log.select(F.col(column).cast("string").alias("text")).distinct()


def tokens(texts: DataFrame, key: str, text: str = "text", stop: Sequence[str] | None = None) -> DataFrame:
    """Words of at least two letters that are no stop words, one row per occurrence.
    The default stop words are Spark's English list."""
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    words = F.filter(
        F.split(clean_text(F.col(text)), rf"(?U)[{WHITE_SPACE}]+"),
        lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2,
    )
    return texts.select(key, F.explode(words).alias("term"))


def term_counts(token_rows: DataFrame, key: str) -> DataFrame:
    return token_rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, size: int | None = None) -> DataFrame:
    """All terms, or the ``size`` most frequent of the corpus, with smooth idf ``ln((1+n)/(1+df)) + 1``."""
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if size is not None:
        per_term = per_term.orderBy(F.desc("total"), "term").limit(size)
    return per_term.select("term", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(
    texts: DataFrame, key: str, text: str = "text", size: int | None = None, stop: Sequence[str] | None = None
) -> DataFrame:
    """``key, term, weight`` with rows of unit length over all terms, or over the ``size`` most frequent."""
    n_docs = texts.count()
    # Counted once and stored: tokenising the texts again for the vocabulary would cost more.
    with brief_shuffles(texts.sparkSession):
        counts = stored_table(term_counts(tokens(texts, key, text, stop), key))
    words = vocabulary(counts, n_docs, size)
    weighted = counts.join(words, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.where(F.col(key).isNotNull()).select(key, "term", (F.col("w") / norm).alias("weight"))


def grams(rows: DataFrame, width: int, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """For each pair of vector columns the ``width`` x ``width`` sum of their outer products, in one pass."""
    sums = [
        vector_sum(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: a * b)))).alias(f"{left}_{right}")
        for left, right in pairs
    ]
    return [np.array(g).reshape(width, width) for g in rows.agg(*sums).first()]


def whitening(g: np.ndarray) -> np.ndarray:
    """The matrix that makes vectors of gram matrix ``g`` orthonormal; dependent directions are left out."""
    spread, axes = np.linalg.eigh((g + g.T) / 2)
    kept = spread > spread[-1] * 1e-12
    return axes[:, kept] / np.sqrt(spread[kept])


BLOCK_WEIGHTS = 1 << 21
"""Weights in a block of texts, from which on the next text opens another block."""
LETTER = "block long, text int, id long, v array<double>"
"""What a block of texts keeps, a row per ``text``, and what it adds to the row of a term, by the term's hash ``id``."""


def text_blocks(weights: DataFrame, key: str) -> DataFrame:
    """Blocks of whole texts, stored: the ``keys`` of the texts; where each ``starts`` in ``at`` and ``w``, which have the place of
    every weight's term in the block and the weight; the ``terms`` of the block and their hashes ``ids``. Texts without key are left out."""
    texts = weights.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("e"))
    schema = f"block long, keys array<{texts.schema[key].dataType.simpleString()}>, starts binary, at binary, w binary, terms array<string>"

    def run(batches):
        held: list[pa.RecordBatch] = []
        number, size = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            load = np.cumsum(np.diff(offsets(whole.column("e")))) // BLOCK_WEIGHTS
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), whole.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                held.append(whole.slice(start, end - start))
                size += int(offsets(held[-1].column("e"))[-1])
                if size >= BLOCK_WEIGHTS:
                    yield block(number, held)
                    held, number, size = [], number + 1, 0
        if size:
            yield block(number, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        entries = [b.column("e").flatten() for b in held]
        coded = pa.concat_arrays([e.field("term") for e in entries]).dictionary_encode()
        sizes = np.concatenate([np.diff(offsets(b.column("e"))) for b in held])
        arrays = np.append(0, np.cumsum(sizes)), coded.indices.to_numpy().astype(np.int32), np.concatenate([e.field("weight").to_numpy() for e in entries])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.concat_arrays([b.column(key) for b in held]), coded.dictionary)]
        packed = [pa.array([v.tobytes()], pa.binary()) for v in arrays]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], *packed, lists[1]], ["block", "keys", "starts", "at", "w", "terms"])

    return stored_table(texts.mapInArrow(run, schema).withColumn("ids", F.transform("terms", lambda t: F.xxhash64(t))))


class Block:
    """The weights of a block: a matrix of texts and terms."""

    def __init__(self, row: pa.Table | pa.RecordBatch):
        self.number = row.column("block")[0].as_py()
        starts, self.at, self.w = (np.frombuffer(row.column(c)[0].as_py(), t) for c, t in (("starts", np.int64), ("at", np.int32), ("w", np.float64)))
        self.text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.ids, self.n_texts = row.column("ids")[0].values.to_numpy(), len(starts) - 1

    def of_texts(self, q: np.ndarray) -> np.ndarray:
        """The matrix times rows of terms."""
        return np.stack([np.bincount(self.text, self.w * c[self.at], minlength=self.n_texts) for c in np.ascontiguousarray(q.T)], axis=1)

    def of_terms(self, z: np.ndarray) -> np.ndarray:
        """The transposed matrix times rows of texts."""
        return np.stack([np.bincount(self.at, self.w * c[self.text], minlength=len(self.ids)) for c in np.ascontiguousarray(z.T)], axis=1)

    def places(self, ids: np.ndarray) -> np.ndarray:
        order = np.argsort(self.ids)
        return order[np.searchsorted(self.ids[order], ids)]

    def letters(self, texts: np.ndarray, ids: np.ndarray, terms: np.ndarray) -> pa.Table:
        """Rows of all texts and of some terms."""
        n, m = len(texts), len(ids)
        number = pa.chunked_array([pa.array(np.arange(n, dtype=np.int32)), pa.nulls(m, pa.int32())])
        known = pa.chunked_array([pa.nulls(n, pa.int64()), pa.array(ids)])
        return pa.table({"block": np.full(n + m, self.number), "text": number, "id": known, "v": pa.chunked_array([nested(texts), nested(terms)])})

    def read(self, mail: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the texts as they were sent, of the terms summed over all blocks, and hashes and places of those terms that
        other blocks have too."""
        own = mail.column("text").is_valid()
        rows, sums = mail.filter(own).combine_chunks(), mail.filter(pc.invert(own)).combine_chunks()
        z = matrix(rows.column("v").combine_chunks())[np.argsort(rows.column("text").to_numpy())]
        z = z[:, : z.shape[1] // 2]
        y, ids = self.of_terms(z), sums.column("id").to_numpy()
        at = self.places(ids)
        if len(ids):
            y[at] = matrix(sums.column("v").combine_chunks())
        return z, y, ids, at


def leading_texts(blocks: DataFrame, k: int, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """Texts times the leading right singular vectors of stored blocks, by randomised subspace iteration: block, text, v, and the map
    from the first numbers of ``v`` to the projection.

    A round multiplies the transposed matrix and the matrix with a block of columns. A block of texts does this by itself for the
    terms that only it has; of the others it sends its sums and gets back those of all blocks. What blocks send is stored for one round;
    the driver sees gram matrices only. The entry of a direction that is largest in size (first term on ties) is positive.
    """
    spark = blocks.sparkSession

    def first(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(row := batch.slice(i, 1))
                z = block.of_texts(row.column("q")[0].values.to_numpy().reshape(len(block.ids), -1))
                ids = row.column("common")[0].values.to_numpy()
                yield from block.letters(np.concatenate([z, np.zeros_like(z)], axis=1), ids, block.of_terms(z)[block.places(ids)]).to_batches()

    def answered(letters: DataFrame, width: int, columns: Sequence[str], fn, schema: str) -> DataFrame:
        sent = letters.where("id is not null")
        sums = sent.groupBy("id").agg(vector_sum(F.col("v"), dims=width).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
        reply = sent.select("block", "id").join(sums, "id").select("block", F.lit(None).cast("int").alias("text"), "id", "v")
        mail = letters.where("text is not null").unionByName(reply)
        return blocks.select("block", "starts", "at", "w", "ids", *columns).groupBy("block").cogroup(mail.groupBy("block")).applyInArrow(fn, schema)

    def next_round(turn: np.ndarray, last: bool):
        def run(row: pa.Table, mail: pa.Table) -> pa.Table:
            block = Block(row)
            z, y, ids, at = block.read(mail)
            new = block.of_texts(y @ turn)
            terms = np.zeros((0, new.shape[1])) if last else block.of_terms(new)[at]
            return block.letters(np.concatenate([new, z @ turn], axis=1), ids[: len(terms)], terms)

        return run

    def largest(change: np.ndarray):
        """Of every direction the entry of a block that is largest in size."""

        def run(row: pa.Table, mail: pa.Table) -> pa.Table:
            basis, terms = Block(row).read(mail)[1] @ change, row.column("terms")[0].values
            size, found = np.round(np.abs(basis), 9), []
            for i in range(change.shape[1]):
                term, at = min((terms[j].as_py(), j) for j in np.flatnonzero(size[:, i] == size[:, i].max()).tolist())
                found.append((i, size[at, i], term, np.sign(basis[at, i])))
            return pa.table(list(zip(*found)), names=["i", "size", "term", "s"])

        return run

    def products(letters: DataFrame, width: int) -> list[np.ndarray]:
        """Gram matrix of the texts' rows, and products of the rows before and these."""
        new, old = F.slice("v", 1, width), F.slice("v", width + 1, width)
        return grams(letters.where("text is not null").select(new.alias("new"), old.alias("old")), width, ("new", "new"), ("old", "new"))

    def formula(term):
        return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.xxhash64(term, i, F.lit(SEED)) / F.lit(2.0**63))

    width = k + OVERSAMPLE
    start = F.flatten(F.transform("terms", formula)).alias("q")
    known = blocks.select("block", F.explode("ids").alias("id"))
    common = known.join(known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "id")
    common = common.groupBy("block").agg(F.collect_list("id").alias("common"))
    none = F.array().cast("array<bigint>")
    with brief_shuffles(spark):
        opened = blocks.join(common, "block", "left").select("block", "starts", "at", "w", "ids", F.coalesce("common", none).alias("common"), start)
        letters = stored_table(opened.mapInArrow(first, LETTER))
        for left in reversed(range(max(1, rounds - 1))):
            turn, before = whitening(products(letters, width)[0]), letters
            letters = stored_table(answered(before, width, (), next_round(turn, not left), LETTER))
            width, sent = turn.shape[1], width
            if left:
                remove_table(before)
        inner, outer = products(letters, width)
        whiten = whitening(outer)
        axes = whiten @ np.linalg.eigh(whiten.T @ inner @ whiten)[1][:, ::-1][:, :k]
        entries = answered(before, sent, ("terms",), largest(turn @ axes), "i long, size double, term string, s double")
        signs = entries.groupBy("i").agg(F.min_by("s", F.struct(-F.col("size"), "term")).alias("s")).collect()
        remove_table(before)
    return letters.where("text is not null"), axes * np.array([r["s"] for r in sorted(signs)])


def svd_embedding(weights: DataFrame, texts: DataFrame, key: str, k: int, rounds: int = 6) -> DataFrame:
    """Unit vectors ``vec`` of length k: texts projected on the leading singular directions, without
    centring. A text without terms gets zeros, and so do directions beyond the rank of the matrix."""
    zero = F.array(*[F.lit(0.0)] * k)
    with brief_shuffles(texts.sparkSession):
        blocks = text_blocks(weights, key)
    if blocks.isEmpty():
        return texts.select(key, zero.alias("vec"))
    rows, change = leading_texts(blocks, k, rounds)
    rows = rows.select("block", "text", dense(change)(F.slice("v", 1, len(change))).alias("vec"))
    projected = blocks.select("block", F.posexplode("keys").alias("text", key)).join(rows, ["block", "text"]).select(key, "vec")
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), k - change.shape[1]))
    return texts.select(key).join(projected, key, "left").select(
        key, l2_normalise(F.coalesce(padded, zero)).alias("vec")
    )
