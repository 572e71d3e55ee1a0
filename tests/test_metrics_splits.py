import random

import pytest
from pyspark.sql import functions as F

from tracelattice.operators import metrics as M
from tracelattice.operators import splits as P

SCORES = "group_id string, label int, score double"


def test_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.5), ("c", 1, 0.5), ("d", 0, 0.1)], SCORES)
    assert M.roc_auc(df).first()[0] == 0.875
    assert M.average_precision(df).first()[0] == pytest.approx(0.8333333333)
    assert [tuple(r) for r in M.roc_points(df).orderBy("step").select("fpr", "tpr").collect()] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]
    assert tuple(M.pr_points(df).orderBy("step").first())[1:3] == (0.0, 1.0)
    assert M.trapezoid(M.roc_points(df), "fpr", "tpr").first()[0] == 0.875
    assert {r["score"]: r["avg_rank"] for r in M.tie_ranks(df).collect()} == {0.1: 1.0, 0.5: 2.5, 0.9: 4.0}


def test_auc_by_pairs_and_reversal(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.randrange(2), float(rng.randrange(15))) for i in range(120)]
    df = spark.createDataFrame(rows, SCORES)
    pos, neg = [s for _, l, s in rows if l], [s for _, l, s in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = M.roc_auc(df).first()[0]
    assert got == pytest.approx(want)
    assert M.roc_auc(df.withColumn("score", -F.col("score"))).first()[0] == pytest.approx(1 - got)
    assert M.trapezoid(M.roc_points(df, drop_intermediate=True), "fpr", "tpr").first()[0] == pytest.approx(want)
    one_class = df.where("label = 0")
    assert M.roc_auc(one_class).first()[0] is None


def test_reports(spark):
    rows = [("x", 1, 0.9, 0.7), ("x", 2, 0.7, 0.8), ("y", 1, 0.8, 0.9), ("y", 2, 0.7, 0.6)]
    results = spark.createDataFrame(rows, "config string, seed int, val_roc double, test_roc double")
    s = M.seed_summary(results, ["val_roc"]).where("config = 'x'").first()
    assert (s["val_roc_mean"], s["val_roc_peak"]) == pytest.approx((0.8, 0.9))
    assert (s["val_roc_std_pop"], s["val_roc_std_samp"]) == pytest.approx((0.1, 0.1 * 2**0.5))
    assert {(r["seed"], r["config"]) for r in M.best_config(results).collect()} == {(1, "x"), (2, "x")}
    history = spark.createDataFrame([(0, -1.0), (1, 5.0), (2, 3.0), (3, 3.0)], "epoch int, loss double")
    assert tuple(M.best_epoch(history).first()) == (2, 3.0)


def labels(spark, normal, anomalous):
    rows = [(f"n{i}", 0) for i in range(normal)] + [(f"a{i}", 1) for i in range(anomalous)]
    return spark.createDataFrame(rows, "group_id string, label int")


def test_sizes_round_half_to_even():
    s = P.protocol_sizes(5470, 4530)
    assert (s.normal, s.train, s.validation, s.normal - s.train - s.validation) == (5470, 3829, 274, 1367)
    assert P.capped_sizes(100, 3, 10000).anomalous == 3
    with pytest.raises(ValueError):
        P.capped_sizes(5, 0)


def test_protocol(spark):
    df = labels(spark, 120, 80)
    out = P.protocol_splits(df, 100, 7)
    counts = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    assert counts == {("train", 0): 42, ("validation", 0): 3, ("test", 0): 15, ("validation", 1): 3, ("test", 1): 37}
    assert tuple(P.split_leakage(out).first()) == (0, 0, 0)
    P.require_no_leakage(out)
    with pytest.raises(RuntimeError):
        P.require_no_leakage(out.unionByName(out.withColumn("split", F.lit("other"))))
    again = P.protocol_splits(df.repartition(5), 100, 7)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    audit = {r["split"]: tuple(r)[1:] for r in P.split_audit(out).collect()}
    assert audit[None] == (100, 60, 40, 0.4)
    with pytest.raises(ValueError):
        P.protocol_splits(df, 1000)


def test_samples(spark):
    df = labels(spark, 50, 30)
    sample = P.class_sample(df, 40, 0.45, 1)
    assert [sample.where(f"label = {c}").count() for c in (0, 1)] == [22, 18]
    with pytest.raises(ValueError):
        P.class_sample(df, 80, 0.45, 1)
    coin = P.bernoulli_split(df, 0.7, 5)
    assert coin.where("label = 1 AND split = 'train'").count() == 0
    assert 20 <= coin.where("split = 'train'").count() <= 48
    dirty = P.contaminate(coin, 4, 1)
    assert dirty.where("label = 1 AND split = 'train'").count() == 4 and dirty.count() == 80
    assert P.complement(df, coin.where("split = 'train'")).count() == coin.where("split = 'test'").count()
    assert P.all_groups(df).first()["label"] == 1
