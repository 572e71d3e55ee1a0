"""Fitting on training groups alone, and line numbers of many files."""

import pytest
from pyspark.sql import functions as F

from tracelattice.operators import propagate, temporal
from tracelattice.plans.queries import FITTED
from tracelattice.session import shared_folder
from tracelattice.sources.bundle import numbered_lines, read_text_bundle, write_text_bundle


def test_test_groups_change_neither_scaler_nor_centre(spark):
    rows = [("a", "train", 0, 1.0), ("b", "train", 0, 3.0), ("c", "test", 0, 9.0), ("d", "train", 1, 50.0)]
    schema = "group_id string, split string, label int, v double"
    one, other = (spark.createDataFrame([(g, s, n, v * (k if s == "test" else 1)) for g, s, n, v in rows], schema) for k in (1, 100))
    scalers = [temporal.fit_scaler(df, ["v"], FITTED) for df in (one, other)]
    assert scalers[0] == scalers[1] and scalers[0].means == (2.0,)
    centres = [propagate.centre(df.select("split", "label", F.array("v").alias("z")), FITTED) for df in (one, other)]
    assert centres[0] == centres[1] == [2.0]


def test_part_numbers_beyond_five_digits_keep_their_order(spark, tmp_path):
    for number in (99999, 100000, 7):
        (tmp_path / f"part-{number:05d}-x.txt").write_text(f"{number}\n")
    lines = {r["line"]: r["value"] for r in numbered_lines(spark, str(tmp_path)).collect()}
    assert lines == {0: "7", 1: "99999", 2: "100000"}


def test_repeated_edges_of_a_bundle_keep_their_weights(spark):
    graphs = spark.createDataFrame([("g", 0, 2)], "group_id string, label int, n_nodes int")
    nodes = spark.createDataFrame([("g", i, [float(i)]) for i in range(2)], "group_id string, node_id int, x array<double>")
    adj = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 0, 1, 0.25), ("g", 1, 0, 2.0)], "group_id string, src int, dst int, w double")
    path = shared_folder(spark)
    write_text_bundle(graphs, nodes, adj, path, "few")
    read = {(r["src"], r["dst"]): r["w"] for r in read_text_bundle(spark, path, "few")["adj"].collect()}
    assert read == pytest.approx({(0, 1): 0.75, (1, 0): 2.0})
