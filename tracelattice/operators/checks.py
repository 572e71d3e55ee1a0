"""Integrity checks. Each raises with a few examples, or returns its input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelattice.functions.scalars import checked_binary


def fail_if_any(bad: DataFrame, what: str) -> None:
    examples = bad.limit(5).collect()
    if examples:
        raise RuntimeError(f"{what}, for example {[row.asDict() for row in examples]}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def resolve_columns(df: DataFrame, spec: Mapping[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """Rename columns by candidate lists, ignoring case and outer blanks. ``spec`` maps our name to the
    names tried in turn; an optional name that is not found becomes null."""
    lookup = {name.strip().lower(): name for name in df.columns}
    chosen = []
    for target, choices in spec.items():
        found = next((lookup[c.lower()] for c in choices if c.lower() in lookup), None)
        if found is not None:
            chosen.append(F.col(f"`{found}`").alias(target))
        elif target in optional:
            chosen.append(F.lit(None).cast("string").alias(target))
        else:
            raise ValueError(f"none of the columns {list(choices)} found for {target}")
    return df.select(*chosen)


def clean_labels(df: DataFrame, label: str = "label", key: str = "group_id") -> DataFrame:
    """Numeric 0/1 labels; rows without a key or a numeric label are dropped, other values fail."""
    numeric = df.withColumn(label, F.col(label).cast("string").try_cast("double")).dropna(subset=[key, label])
    return numeric.where(~F.isnan(label)).withColumn(label, checked_binary(F.col(label)))


def require_unique(df: DataFrame, key: str = "group_id") -> DataFrame:
    fail_if_any(df.groupBy(key).count().where("count > 1"), f"duplicate {key}")
    return df


def require_complete(left: DataFrame, right: DataFrame, key: str = "group_id") -> DataFrame:
    """Every key of ``left`` must occur in ``right``."""
    fail_if_any(left.select(key).join(right.select(key), key, "left_anti"), f"{key} without a match")
    return left


def with_labels(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by key; groups without a label drop out."""
    return graphs.join(labels, "group_id")


def with_summary(graphs: DataFrame, summary: DataFrame) -> DataFrame:
    """Graphs with their timing summary; every graph must have one."""
    require_complete(graphs, summary)
    return graphs.join(summary, "group_id")
