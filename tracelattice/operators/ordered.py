"""Ordered work inside groups (next row, position, running sum) that survives one huge group.

A plain window puts each group into one task. Groups that are too large for that are cut into
chunks of consecutive rows; windows then run per (group, chunk) and a small table of *seams*, one
row per chunk, carries the first row and the sums over to the neighbouring chunk. The result equals
the plain window's. Without large groups the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.session import cut_lineage, spread

HOT_ROWS = 2_000_000
"""A group above this many rows is cut into chunks."""

SAMPLES_PER_CHUNK = 32
MOST_CUTS_LOG = 24  # a binary search over up to 2^25 - 1 cuts of one group
CHUNK = "__chunk"
CUTS = "__cuts"


@dataclass(frozen=True)
class Ordered:
    """Rows of ``df`` ordered by ``order`` inside ``keys``; ``cuts`` is None when no group is large."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None
    hot_rows: int = HOT_ROWS
    rows: int = 0  # of df, if a group is large

    @property
    def is_hot(self) -> bool:
        return self.cuts is not None

    def scan(
        self,
        lead: Mapping[str, str] | None = None,
        running: Mapping[str, Column] | None = None,
        position: str | None = None,
        has_next: str | None = None,
    ) -> DataFrame:
        """Add, in one pass over the order: ``lead`` {new: column} next-row values, ``running``
        {new: expression} inclusive sums, ``position`` the 0-based row number, ``has_next`` whether
        a next row exists."""
        lead, running = dict(lead or {}), dict(running or {})
        if self.cuts is None:
            return self._scan_plain(lead, running, position, has_next)
        return self._scan_chunked(lead, running, position, has_next)

    def _windowed(self, parts: Sequence[str], lead, running, position, has_next) -> list[Column]:
        rows = Window.partitionBy(*parts).orderBy(*self.order)
        upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = [F.lead(source).over(rows).alias(name) for name, source in lead.items()]
        new += [F.sum(expr).over(upto).alias(name) for name, expr in running.items()]
        if position:
            new.append((F.row_number().over(rows) - 1).cast("bigint").alias(position))
        if has_next:
            new.append(F.lead(F.lit(True), 1, False).over(rows).alias(has_next))
        return new

    def _scan_plain(self, lead, running, position, has_next) -> DataFrame:
        return self.df.select("*", *self._windowed(self.keys, lead, running, position, has_next))

    def _scan_chunked(self, lead, running, position, has_next) -> DataFrame:
        chunked = self.chunked()
        parts = [*self.keys, CHUNK]
        follows = has_next or "__has_next"
        inside = spread(chunked, self.rows, parts).select("*", *self._windowed(parts, lead, running, position, follows))

        first = F.struct(F.lit(True).alias("__present"), *[F.col(c) for c in dict.fromkeys(lead.values())])
        seams = (
            chunked.where(F.col(CHUNK).isNotNull())
            .groupBy(*parts)
            .agg(
                F.min_by(first, F.struct(*self.order)).alias("__first"),
                F.count(F.lit(1)).alias("__rows"),
                *[F.sum(expr).alias(f"__sum_{name}") for name, expr in running.items()],
            )
        )
        # One row per chunk of hot_rows rows, so these windows are small; Spark sizes the join.
        order = Window.partitionBy(*self.keys).orderBy(CHUNK)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        seams = seams.select(
            *parts,
            F.lead("__first").over(order).alias("__next"),
            F.sum("__rows").over(before).alias("__before"),
            *[F.sum(f"__sum_{name}").over(before).alias(f"__before_{name}") for name in running],
        )
        joined = inside.join(seams, parts, "left")
        out = [F.col(c) for c in self.df.columns]
        for name, source in lead.items():
            out.append(F.when(F.col(follows), F.col(name)).otherwise(F.col("__next")[source]).alias(name))
        for name in running:
            out.append((F.col(name) + F.coalesce(F.col(f"__before_{name}"), F.lit(0))).alias(name))
        if position:
            out.append((F.col(position) + F.coalesce(F.col("__before"), F.lit(0))).alias(position))
        if has_next:
            out.append((F.col(has_next) | F.col("__next").isNotNull()).alias(has_next))
        return joined.select(*out)

    def chunked(self) -> DataFrame:
        """``df`` with the chunk number; null in groups that are not cut."""
        if self.cuts is None:
            return self.df.withColumn(CHUNK, F.lit(None).cast("int"))
        key = F.struct(*self.order)
        chunk = F.when(F.col(CUTS).isNotNull(), _cuts_not_above(F.col(CUTS), key))
        return self.df.join(self.cuts, list(self.keys), "left").withColumn(CHUNK, chunk).drop(CUTS)

    def large_keys(self) -> DataFrame:
        """Keys of all groups above ``hot_rows``. Not bounded: join it."""
        sizes = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"))
        return sizes.where(F.col("__n") > self.hot_rows).select(*self.keys)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("seq",),
    hot_rows: int | None = None,
) -> Ordered:
    """Prepare ordered work. ``order`` must be a total order inside each group."""
    keys, order = tuple(keys), tuple(order)
    hot_rows = hot_rows or HOT_ROWS
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = sizes.agg(F.sum("__n").alias("rows"), F.max("__n").alias("largest")).first()
    rows = found["rows"] or 0
    if not rows or found["largest"] <= hot_rows:
        return Ordered(spread(df, rows, keys), keys, order, None, hot_rows)
    return Ordered(df, keys, order, _find_cuts(df, sizes, keys, order, hot_rows), hot_rows, rows)


def plain(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ordered:
    """Ordered work where every group is known to be small."""
    return Ordered(df, tuple(keys), tuple(order), None)


def _find_cuts(df: DataFrame, sizes: DataFrame, keys, order, hot_rows: int) -> DataFrame:
    """Cut points of every group above ``hot_rows``, as a stored table."""
    chunks = F.ceil(F.col("__n") / hot_rows).cast("int").alias("__chunks")
    targets = cut_lineage(sizes.where(F.col("__n") > hot_rows).select(*keys, chunks))
    # A hash sample is the same on every retry; its expected size is SAMPLES_PER_CHUNK per chunk.
    buckets = max(1, hot_rows // SAMPLES_PER_CHUNK)
    point = F.struct(*order)
    sample = (
        df.select(*keys, *[c for c in order if c not in keys])
        .where(F.pmod(F.xxhash64(*order), F.lit(buckets)) == 0)
        .join(targets, list(keys))
        .groupBy(*keys, "__chunks")
        .agg(F.sort_array(F.collect_set(point)).alias("__points"))
    )
    size = F.size("__points")
    picked = F.transform(
        F.sequence(F.lit(1), F.col("__chunks") - 1),
        lambda i: F.get(F.col("__points"), F.floor(i * size / F.col("__chunks")).cast("int")),
    )
    return cut_lineage(sample.where(F.col("__chunks") > 1).select(*keys, F.array_distinct(picked).alias(CUTS)))


def _cuts_not_above(cuts: Column, key: Column) -> Column:
    """Binary search: how many of the sorted cut points are <= key."""
    steps = F.array(*[F.lit(2**i) for i in range(MOST_CUTS_LOG, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= key), at + step
        ).otherwise(at),
    )
