"""Session settings and lineage cutting."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 1 << 17
"""Rows that one task of a stage of windows or joins sorts and aggregates; tables of more rows go over more tasks."""


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName("tracelattice")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Let the skew split win over saving one exchange: one group may hold a third of all rows.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints are removed when no table refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run where it is not installed."""
    root = Path(__file__).resolve().parent
    name = "tracelattice.zip"
    if any(path.endswith(f"/{name}") for path in spark.sparkContext.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="tracelattice-package-")) / name
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tracelattice-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored_table(df: DataFrame) -> DataFrame:
    """The same rows as a compressed Parquet table in the shared folder, read again: for tables of many rows."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in here are deleted with its end: for rounds that store what they give."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_tasks(spark: SparkSession, rows: int) -> int | None:
    """How many tasks ``rows`` rows need, or None if those that Spark takes by itself are enough."""
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = math.ceil(rows / TASK_ROWS)
    return tasks if tasks > usual else None


def spread(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """``df`` placed by ``keys`` over tasks in proportion to its ``rows``, as it is if these are few: Spark's own number of
    partitions is fixed, so that a task would grow with the table. Windows and aggregates by the keys stay there."""
    tasks = spread_tasks(df.sparkSession, rows)
    return df if tasks is None or not keys else df.repartition(tasks, *keys)
