"""The given tables read as event logs, labels, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.functions.scalars import epoch_seconds
from tracelattice.functions.vectors import vector_mean

# The event types in alphabetical order; the i-th takes the mean vector of label i,
# further labels name further entries of the vector dictionary.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_ORDER = ("ts", "event_id")
LINE_ORDER = ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day_key() -> Column:
    return F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))


def event_log(spark: SparkSession, folder: str, by: str = "day") -> DataFrame:
    """Events per user (``user``) or per user and day (``day``)."""
    key = day_key() if by == "day" else F.col("user_id").cast("string")
    return table(spark, folder, "events").select(
        key.alias("group_id"),
        "ts",
        "event_id",
        F.col("event_type").alias("event"),
        epoch_seconds(F.col("ts")).alias("ts_s"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("event_type").alias("component"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        "value",
        "props",
    )


def line_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per order, in line order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("group_id"),
        *LINE_ORDER,
        F.concat("l_returnflag", "l_linestatus").alias("event"),
        epoch_seconds(F.col("l_shipdate")).alias("ts_s"),
    )


def turn_log(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns, without times."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("group_id"), F.col("turn").alias("seq"), F.col("role").alias("event")
    )


def event_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """One vector per event type: the mean of a label's embeddings."""
    means = table(spark, folder, "embeddings").groupBy("label").agg(
        vector_mean(F.transform("embedding", lambda v: v.cast("double"))).alias("vec")
    )
    event = F.get(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("label"))
    return means.select(F.coalesce(event, F.concat(F.lit("label_"), F.col("label"))).alias("event"), "vec")


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with ties: label = toxic, score = length."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("group_id"),
        "lang",
        "source",
        F.col("toxic").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
    )
