"""Tie-exact ranking metrics over (score, label) rows, for any number of models at once.

Rows are first counted per distinct score; cumulative counts then come from ordered running sums, so
neither a popular score nor one large model lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelattice.operators.ordered import ordered

ALL = "__all"


def _keyed(scores: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (scores, list(by)) if by else (scores.withColumn(ALL, F.lit(0)), [ALL])


def _unkeyed(df: DataFrame, by: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(*by, *columns)


def _ties(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scores.groupBy(*keys, "score").agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum((1 - F.col("label")).cast("bigint")).alias("neg")
    )


def tie_ranks(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Average rank (1-based, ascending) of every distinct score."""
    scores, keys = _keyed(scores, by)
    ties = _ties(scores, keys).withColumn("n", F.col("pos") + F.col("neg"))
    ranked = ordered(ties, keys, ["score"], hot_rows).scan(running={"upto": F.col("n")})
    rank = F.col("upto") - (F.col("n") - 1) / 2
    return _unkeyed(ranked, by, "score", "pos", "neg", rank.alias("avg_rank"))


def cumulative_counts(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """True and false positives at every distinct threshold, by descending score, with class totals."""
    scores, keys = _keyed(scores, by)
    ties = _ties(scores, keys).withColumn("__down", -F.col("score"))
    counted = ordered(ties, keys, ["__down"], hot_rows).scan(
        running={"tp": F.col("pos"), "fp": F.col("neg")}, position="step"
    )
    totals = ties.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return counted.join(totals, keys).select(
        *keys, "step", F.col("score").alias("threshold"), "pos", "neg", "tp", "fp", "positives", "negatives"
    )


def roc_auc(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Area under the ROC curve; ties count one half. Null when a class is missing."""
    keyed, keys = _keyed(scores, by)
    counts = cumulative_counts(keyed, keys, hot_rows)
    # Negatives scored below a tie block = all negatives minus those at or above it.
    below = F.col("negatives") - F.col("fp") + F.col("neg") / 2
    pairs = F.sum(F.col("pos") * below)
    wanted = F.first("positives").cast("double") * F.first("negatives")
    return _unkeyed(counts.groupBy(*keys).agg(F.try_divide(pairs, wanted).alias("roc_auc")), by, "roc_auc")


def average_precision(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Step-wise sum of precision over recall gains."""
    keyed, keys = _keyed(scores, by)
    counts = cumulative_counts(keyed, keys, hot_rows)
    gain = F.try_divide(F.col("pos").cast("double"), F.col("positives"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    ap = counts.groupBy(*keys).agg(F.sum(gain * precision).alias("average_precision"))
    return _unkeyed(ap, by, "average_precision")


def metric_table(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Both metrics for every combination of ``by``, from one pass over the ordered counts."""
    keyed, keys = _keyed(scores, by)
    counts = cumulative_counts(keyed, keys, hot_rows)
    below = F.col("negatives") - F.col("fp") + F.col("neg") / 2
    gain = F.try_divide(F.col("pos").cast("double"), F.col("positives"))
    table = counts.groupBy(*keys).agg(
        F.first("positives").alias("positives"),
        F.first("negatives").alias("negatives"),
        F.try_divide(
            F.sum(F.col("pos") * below), F.first("positives").cast("double") * F.first("negatives")
        ).alias("roc_auc"),
        F.sum(gain * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
    )
    return _unkeyed(table, by, "positives", "negatives", "roc_auc", "average_precision")


def roc_points(
    scores: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """Points of the ROC curve from (0, 0), numbered by ``step``; the first threshold is infinite.

    ``drop_intermediate`` leaves out points on the line between their neighbours.
    """
    keyed, keys = _keyed(scores, by)
    counts = cumulative_counts(keyed, keys, hot_rows)
    if drop_intermediate:
        nexts = counts.select(*keys, "step", "pos", "neg")
        following = ordered(nexts, keys, ["step"], hot_rows).scan(
            lead={"next_pos": "pos", "next_neg": "neg"}, has_next="more"
        )
        corner = ~F.col("more") | (F.col("pos") * F.col("next_neg") != F.col("neg") * F.col("next_pos"))
        counts = counts.join(following.where(corner).select(*keys, "step"), [*keys, "step"], "left_semi")
    points = counts.select(
        *keys,
        (F.col("step") + 1).alias("step"),
        F.try_divide(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("tpr"),
        F.col("threshold").cast("double").alias("threshold"),
    )
    start = keyed.groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("step"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"),
    )
    return _unkeyed(start.unionByName(points), by, "step", "fpr", "tpr", "threshold")


def pr_points(scores: DataFrame, by: Sequence[str] = (), hot_rows: int | None = None) -> DataFrame:
    """Precision and recall at every threshold, with the closing point (recall 0, precision 1) first."""
    keyed, keys = _keyed(scores, by)
    counts = cumulative_counts(keyed, keys, hot_rows)
    points = counts.select(
        *keys,
        (F.col("step") + 1).alias("step"),
        F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.col("threshold").cast("double").alias("threshold"),
    )
    close = keyed.groupBy(*keys).agg(
        F.lit(0).cast("bigint").alias("step"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return _unkeyed(close.unionByName(points), by, "step", "recall", "precision", "threshold")


def trapezoid(
    points: DataFrame, x: str, y: str, by: Sequence[str] = (), step: str = "step", hot_rows: int | None = None
) -> DataFrame:
    """Area under stored curve points by the trapezoid rule."""
    keyed, keys = _keyed(points, by)
    rows = keyed.select(*keys, F.col(step).alias("step"), F.col(x).alias("x"), F.col(y).alias("y"))
    following = ordered(rows, keys, ["step"], hot_rows).scan(lead={"next_x": "x", "next_y": "y"})
    area = F.sum((F.col("next_x") - F.col("x")) * (F.col("next_y") + F.col("y")) / 2)
    return _unkeyed(following.groupBy(*keys).agg(area.alias("area")), by, "area")


def most_anomalous(scores: DataFrame, k: int = 1) -> DataFrame:
    """The k highest scores."""
    return scores.orderBy(F.desc("score"), "group_id").limit(k)


def best_epoch(history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The epoch of least loss; epoch 0 only sets the centre and does not count."""
    return history.where("epoch > 0").groupBy(*by).agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss")
    )


def seed_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("config",)) -> DataFrame:
    """Mean, population and sample deviation and peak of every metric over the seeds."""
    return results.groupBy(*by).agg(
        *[
            fn(m).alias(f"{m}_{name}")
            for m in metrics
            for name, fn in (("mean", F.avg), ("std_pop", F.stddev_pop), ("std_samp", F.stddev_samp), ("peak", F.max))
        ]
    )


def best_config(results: DataFrame, by: Sequence[str] = ("seed",), metric: str = "val_roc") -> DataFrame:
    """Per seed the configuration with the highest validation metric; ties go to the first name."""
    rest = [c for c in results.columns if c not in by]
    best = results.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(metric), F.col("config"))).alias("best")
    )
    return best.select(*by, "best.*")
