"""Text bundle of a graph set: seven files aligned by line number, with global 1-based node numbers.

Lines carry no keys, so writing sorts globally and reading numbers the lines again. Both are spread
over the cluster: offsets come from running sums per chunk, and line numbers from per-block counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.operators.graphs import GROUP, prefix_offsets
from tracelattice.operators.ordered import ordered
from tracelattice.session import cut_lineage

# File names and number format of the bundle.
FILES = ("A", "edge_attributes", "graph_indicator", "graph_labels", "node_attributes", "A2", "edge_attributes2")
DELIMITER = ", "
NUMBER = "%.6f"


def _write_lines(df: DataFrame, order: list[str], line, path: str) -> None:
    sorted_rows = df.orderBy(*order)
    sorted_rows.select(line.alias("value")).write.mode("overwrite").text(path)


def write_text_bundle(
    graphs: DataFrame, nodes: DataFrame, adj: DataFrame, folder: str, name: str, adj2: DataFrame | None = None
) -> None:
    """``graphs``: group_id, label, n_nodes. ``nodes``: group_id, node_id, x. ``adj``: group_id, src, dst, w."""
    offsets = cut_lineage(prefix_offsets(graphs).select(GROUP, "label", "graph_no", "node_offset"))
    where = offsets.select(GROUP, "graph_no", "node_offset")
    _write_lines(offsets, ["graph_no"], F.col("label").cast("string"), f"{folder}/{name}_graph_labels")

    placed = nodes.join(where, GROUP)
    numbers = F.transform("x", lambda v: F.format_string(NUMBER, v))
    at = ["graph_no", "node_id"]
    _write_lines(placed, at, (F.col("graph_no") + 1).cast("string"), f"{folder}/{name}_graph_indicator")
    _write_lines(placed, at, F.array_join(numbers, DELIMITER), f"{folder}/{name}_node_attributes")

    for edges, suffix in ((adj, ""), (adj2, "2")):
        if edges is None:
            continue
        located = edges.join(where, GROUP)
        # The weight too, so that both files list repeated edges alike.
        at = ["graph_no", "src", "dst", "w"]
        ends = [(F.col(c) + F.col("node_offset") + 1).cast("string") for c in ("src", "dst")]
        _write_lines(located, at, F.concat_ws(DELIMITER, *ends), f"{folder}/{name}_A{suffix}")
        _write_lines(located, at, F.format_string(NUMBER, F.col("w")), f"{folder}/{name}_edge_attributes{suffix}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder with their 0-based number, in the order of the part numbers in their
    names, of the names where there are none."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # A block is read in one run, so ids inside it are consecutive.
    blocks = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    part = F.coalesce(F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint"), F.lit(0))
    keyed = blocks.withColumns({"__all": F.lit(0), "__part": part})
    placed = ordered(keyed, ["__all"], ["__part", "file", "start"]).scan(running={"upto": F.col("n")})
    before = placed.select("file", "start", "first", (F.col("upto") - F.col("n")).alias("before"))
    return lines.join(before, ["file", "start"]).select(
        (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value"
    )


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: F.trim(v).cast("double"))


def read_text_bundle(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """``graphs`` (group_id, label), ``nodes`` (group_id, node_id, x), ``adj`` and, if present, ``adj2``.
    ``group_id`` is the graph number in the bundle; node numbers are 0-based inside their graph."""

    def lines(suffix: str) -> DataFrame:
        return numbered_lines(spark, f"{folder}/{name}_{suffix}")

    graphs = lines("graph_labels").select(
        (F.col("line") + 1).cast("string").alias(GROUP), F.trim("value").cast("int").alias("label")
    )
    owner = lines("graph_indicator").select("line", F.trim("value").alias(GROUP))
    first = owner.groupBy(GROUP).agg(F.min("line").alias("first"))
    located = cut_lineage(owner.join(first, GROUP))
    nodes = located.join(lines("node_attributes"), "line").select(
        GROUP, (F.col("line") - F.col("first")).cast("int").alias("node_id"), _numbers(F.col("value")).alias("x")
    )
    out = {"graphs": graphs, "nodes": nodes}
    for key, suffix in (("adj", ""), ("adj2", "2")):
        if suffix and not _exists(spark, f"{folder}/{name}_A2"):
            continue
        weight = lines(f"edge_attributes{suffix}").select("line", F.trim("value").cast("double").alias("w"))
        ends = lines(f"A{suffix}").select(
            "line", *[(F.trim(F.split("value", ",")[i]).cast("bigint") - 1).alias(c) for i, c in enumerate(("a", "b"))]
        )
        rows = ends.join(weight, "line").join(located.withColumnRenamed("line", "a"), "a")
        # Repeated edges are summed, as on writing.
        out[key] = (
            rows.select(
                GROUP,
                (F.col("a") - F.col("first")).cast("int").alias("src"),
                (F.col("b") - F.col("first")).cast("int").alias("dst"),
                "w",
            )
            .groupBy(GROUP, "src", "dst")
            .agg(F.sum("w").alias("w"))
        )
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True
