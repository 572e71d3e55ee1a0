import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracelattice.functions import scalars as S
from tracelattice.functions import vectors as V
from tracelattice.operators import checks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("level, message, want", [
    ("warning", "", "WARN"), ("critical", "", "FATAL"), (None, "x ERROR y", "ERROR"), (None, "a warning b", "WARN"),
    (None, "nothing", "UNKNOWN"), ("strange", "ERROR", "UNKNOWN"), (" ", "FATAL", "FATAL"), (None, "INFOrmation", "UNKNOWN"),
])
def test_severity(spark, level, message, want):
    assert one(spark, S.severity(text(level), text(message))) == want


@pytest.mark.parametrize("comp, sub, message, want", [
    ("Kernel", None, "", "kernel"), ("Kernel", "KERNEL", "", "kernel"), ("App", "Kernel", "", "app::kernel"),
    (None, "Disk", "", "disk"), (None, None, "x [Mem.ctl] y", "mem.ctl"), (None, None, "plain", "unknown"),
])
def test_component(spark, comp, sub, message, want):
    assert one(spark, S.component(text(comp), text(sub), text(message))) == want


def test_numbers(spark):
    assert one(spark, S.numbers_in(F.lit("a 1.5 b -3e2 x9 10.0.0.1"))) == [1.5, -300.0, 10.0]
    assert one(spark, S.numbers_in(F.lit("1e999 7e13 .5"))) == [1e12, 0.5]
    both = S.numeric_params(F.array(F.lit("a 2 3"), F.lit("x")), F.lit("9"))
    assert one(spark, both) == [2.0, 3.0]
    assert one(spark, S.numeric_params(F.lit(None).cast("array<string>"), F.lit("9"))) == [9.0]
    assert one(spark, S.numeric_params(F.array().cast("array<string>"), F.lit("9"))) == []


def test_keys_labels_and_times(spark):
    assert one(spark, S.group_key(F.lit("x blk_-12 blk_3"))) == "blk_-12"
    assert one(spark, S.group_key(F.lit("none"))) is None
    assert [one(spark, S.label_to_int(F.lit(v))) for v in ("Normal", "Anomaly", "?")] == [0, 1, None]
    assert one(spark, S.parse_time(F.lit("2005-06-03-15.42.50.363779"))) == pytest.approx(1117813370.363779)
    assert one(spark, S.parse_time(F.lit("2005-06-03 15:42:50"))) == 1117813370.0
    with pytest.raises(PySparkException):
        one(spark, S.parse_time(F.lit("no time")))
    assert one(spark, S.time_or_index(F.lit("x"), F.lit(4))) == 4.0
    assert one(spark, S.event_or_message(F.lit("NaN"), F.lit("m"))) == "m"
    assert one(spark, S.event_or_message(F.lit(""), None)) == "UNKNOWN"


def test_small_expressions(spark):
    assert one(spark, S.clean_text(F.lit("  Disk 7 Failed! "))) == "disk  failed"
    assert one(spark, S.clean_text(F.lit("\u00a0A\u2003b\x1c"))) == "a\u2003b"
    assert one(spark, S.signed_log(F.lit(-1.0))) == pytest.approx(-0.693147, abs=1e-6)
    assert one(spark, S.finite_or(F.lit(float("nan")), 1.0)) == 1.0
    assert one(spark, S.first_nonblank(F.lit(" "), text(None), F.lit("c"))) == "c"
    assert one(spark, S.node_label(text(None), F.lit(3))) == "3"
    assert one(spark, S.concat_features(F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), F.array(F.lit(2)))) == [1.0, 2.0]
    assert one(spark, S.take_dims(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [1, 2]
    assert sum(one(spark, S.severity_onehot(F.lit("WARN")))) == 1 and one(spark, S.severity_onehot(F.lit("WARN")))[3] == 1
    assert sum(one(spark, S.component_onehot(F.lit("kernel")))) == 1
    assert one(spark, V.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.l2(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)))) == 5.0


def test_checks(spark):
    df = spark.createDataFrame([("a", "1", 1), ("b", None, 2), ("c", "x", 3), (None, "0", 4)], "group_id string, label string, n int")
    assert [tuple(r)[:2] for r in checks.clean_labels(df).collect()] == [("a", 1)]
    with pytest.raises(PySparkException):
        checks.clean_labels(spark.createDataFrame([("a", "2")], "group_id string, label string")).collect()
    with pytest.raises(ValueError):
        checks.require_columns(df, ["missing"])
    found = checks.resolve_columns(df.toDF(" Group_ID ", "Label", "n"), {"group_id": ("node", "group_id"), "x": ("y",)}, ["x"])
    assert found.columns == ["group_id", "x"]
    with pytest.raises(ValueError):
        checks.resolve_columns(df, {"k": ("nope",)})
    with pytest.raises(RuntimeError):
        checks.require_unique(df.unionByName(df))
    with pytest.raises(RuntimeError):
        checks.require_complete(df, df.where("n = 1"))


def test_white_space_of_any_kind_is_blank(spark):
    assert one(spark, S.severity(F.lit("\t"), F.lit("x ERROR y"))) == "ERROR"
    assert one(spark, S.severity(F.lit("\twarning\n"), F.lit("x ERROR y"))) == "WARN"
    assert one(spark, S.component(F.lit("\n"), F.lit("\tNet\t"), F.lit("m"))) == "net"


def test_parameters_of_other_types(spark):
    from tracelattice.operators.features import parsed_fields

    for kind, value, want in (("map<string,string>", {"k": "3 x 4"}, [3.0, 4.0]), ("array<double>", [5.5], [5.5]), ("string", "9", [7.0]), ("array<string>", ["1", "b 2"], [1.0, 2.0])):
        df = spark.createDataFrame([("e", "m 7", value)], f"event string, message string, params {kind}")
        assert sorted(parsed_fields(df).first()["params"]) == want, kind
