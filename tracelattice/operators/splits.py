"""Seeded samples and train/validation/test splits that every run and engine can repeat.

The order of a class is the text order of ``md5(seed:group_id)``; sizes are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelattice.operators.checks import fail_if_any
from tracelattice.operators.graphs import GROUP

SPLITS = ("train", "validation", "test")
TRAIN_SHARE = 0.70
VALIDATION_SHARE = 0.05


def hash_key(seed: int, column: str = GROUP) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


BUCKET_DIGITS = 3
"""Leading hex digits of the hash that share a bucket: 4096 buckets a class."""


def hash_order(labels: DataFrame, seed: int) -> DataFrame:
    """``labels`` with the 0-based place of every group in its class's random order.

    No class is sorted: hashes fall evenly into buckets by their first digits, a running count over the buckets tells where each
    begins, and only inside a bucket are groups ordered.
    """
    hashed = labels.withColumns({"__hash": hash_key(seed), "__class": F.coalesce(F.col("label").cast("string"), F.lit("null"))})
    hashed = hashed.withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS))
    counts = hashed.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__class", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__class", "__bucket").orderBy("__hash", GROUP)) - 1
    placed = hashed.withColumn("__inside", inside).join(starts, ["__class", "__bucket"])
    return placed.select(*labels.columns, (F.col("__start") + F.col("__inside")).alias("place"))


def class_sizes(labels: DataFrame) -> tuple[int, int]:
    """Normal and anomalous group counts."""
    counts = {row["label"]: row["n"] for row in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get(0, 0), counts.get(1, 0)


def class_sample(labels: DataFrame, n: int, share: float, seed: int) -> DataFrame:
    """Exactly ``int(n * share)`` anomalous and ``int(n * (1 - share))`` normal groups."""
    anomalies, normals = int(n * share), int(n * (1 - share))
    have_normal, have_anomalous = class_sizes(labels)
    if normals > have_normal or anomalies > have_anomalous:
        raise ValueError("sample larger than a class")
    size = F.when(F.col("label") == 1, anomalies).otherwise(normals)
    return hash_order(labels, seed).where(F.col("place") < size).drop("place")


def all_groups(labels: DataFrame) -> DataFrame:
    """All groups, anomalous ones first."""
    return labels.orderBy(F.desc("label"), GROUP)


def bernoulli_split(labels: DataFrame, fraction: float = 0.7, seed: int = 1213) -> DataFrame:
    """About ``fraction`` of the normal groups to train; the rest and all anomalies to test."""
    unit = F.conv(F.substring(hash_key(seed), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    chosen = (F.col("label") == 0) & (unit < fraction)
    return labels.withColumn("split", F.when(chosen, "train").otherwise("test"))


@dataclass(frozen=True)
class SplitSizes:
    normal: int
    anomalous: int
    train: int
    validation: int
    validation_anomalous: int


def protocol_sizes(n_normal: int, n_anomalous: int, n: int = 10000) -> SplitSizes:
    """Sizes that keep the class ratio; halves round to even."""
    normal = round(n * (n_normal / (n_normal + n_anomalous)))
    validation = round(VALIDATION_SHARE * normal)
    return SplitSizes(normal, n - normal, round(TRAIN_SHARE * normal), validation, validation)


def capped_sizes(n_normal: int, n_anomalous: int, n: int = 10000) -> SplitSizes:
    """Sizes that keep the class ratio of all groups, or of as many as there are if ``n`` asks for more."""
    if not n_normal or not n_anomalous:
        raise ValueError("capped sizes need groups of either label")
    everything = n_normal + n_anomalous
    asked = min(n, everything)
    # The anomalies are rounded, halves to even, and the normals fill up; neither can pass what there is.
    anomalous = round(asked * n_anomalous / everything)
    normal = asked - anomalous
    validation = round(VALIDATION_SHARE * normal)
    return SplitSizes(normal, anomalous, round(TRAIN_SHARE * normal), validation, min(validation, anomalous))


def _assign(labels: DataFrame, sizes: SplitSizes, seed: int) -> DataFrame:
    place, normal = F.col("place"), F.col("label") == 0
    split = (
        F.when(normal & (place < sizes.train), "train")
        .when(normal & (place < sizes.train + sizes.validation), "validation")
        .when(normal & (place < sizes.normal), "test")
        .when(~normal & (place < sizes.validation_anomalous), "validation")
        .when(~normal & (place < sizes.anomalous), "test")
    )
    assigned = hash_order(labels, seed).select(GROUP, "label", split.alias("split"))
    return assigned.where(F.col("split").isNotNull())


def protocol_splits(labels: DataFrame, n: int = 10000, seed: int = 42) -> DataFrame:
    """Down-sample to ``n`` groups and split 70/5/25 of the normal ones; validation gets as many
    anomalies as normals, test the rest, train none."""
    n_normal, n_anomalous = class_sizes(labels)
    sizes = protocol_sizes(n_normal, n_anomalous, n)
    if sizes.normal > n_normal or sizes.anomalous > n_anomalous:
        raise ValueError("sample larger than a class")
    return _assign(labels, sizes, seed)


def protocol_splits_from_log(
    log: DataFrame, n: int = 10000, seed: int = 42, label: str = "label"
) -> DataFrame:
    """The same protocol from labelled log rows; a class that is too small gives all it has."""
    from tracelattice.operators.graphs import group_labels
    from tracelattice.operators.checks import clean_labels

    labels = group_labels(clean_labels(log, label), label)
    sizes = capped_sizes(*class_sizes(labels), n)
    return _assign(labels, sizes, seed)


def contaminate(splits: DataFrame, k: int, seed: int) -> DataFrame:
    """Move k anomalies from test to train, to probe robustness."""
    movable = splits.where("split = 'test' AND label = 1").select(GROUP, "label")
    moved = hash_order(movable, seed).where(F.col("place") < k).select(GROUP, F.lit(True).alias("__moved"))
    return splits.join(moved, GROUP, "left").select(
        GROUP, "label", F.when(F.col("__moved"), "train").otherwise(F.col("split")).alias("split")
    )


def union_splits(*parts: DataFrame) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def complement(everything: DataFrame, train: DataFrame) -> DataFrame:
    """Groups that are not in ``train``."""
    return everything.join(train.select(GROUP), GROUP, "left_anti")


def split_leakage(splits: DataFrame) -> DataFrame:
    """Groups in common for every pair of splits."""
    sets = splits.groupBy(GROUP).agg(
        *[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    )
    both = [F.sum(F.col(a) * F.col(b)).cast("bigint").alias(f"{a}_{b}")
            for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))]
    return sets.agg(*both)


def require_no_leakage(splits: DataFrame) -> DataFrame:
    shared = splits.groupBy(GROUP).agg(F.count_distinct("split").alias("n")).where("n > 1")
    fail_if_any(shared, "groups in more than one split")
    return splits


def split_audit(splits: DataFrame) -> DataFrame:
    """Graphs, normals, anomalies and anomaly share per split, and in total (split null)."""
    return (
        splits.rollup("split")
        .agg(
            F.count(F.lit(1)).alias("n_graphs"),
            F.sum((F.col("label") == 0).cast("bigint")).alias("normal"),
            F.sum((F.col("label") == 1).cast("bigint")).alias("anomalous"),
        )
        .withColumn("anomaly_share", F.col("anomalous") / F.col("n_graphs"))
    )


def class_counts(splits: DataFrame) -> DataFrame:
    """Split by label cross table."""
    table = splits.groupBy("split").pivot("label", [0, 1]).agg(F.count(F.lit(1)))
    return table.select(
        "split", F.coalesce("0", F.lit(0)).alias("label_0"), F.coalesce("1", F.lit(0)).alias("label_1")
    )


def train_normal(graphs: DataFrame) -> DataFrame:
    return graphs.where("label = 0")


def take_split(graphs: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """Graphs of one split; ids without a graph drop out."""
    return graphs.join(splits.where(F.col("split") == name).select(GROUP), GROUP)
