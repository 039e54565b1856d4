import random
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from rillflow.operators import groups as G


def rows(spark, data):
    return spark.createDataFrame(data, "uid long, i long, score double, len double")


SMALL = [(0, 0, 1.0, 2.0), (1, 1, 2.0, 3.0), (0, 2, 3.0, 4.0)]


def by_ordinal(df, column="advantage"):
    return {r["i"]: r[column] for r in df.collect()}


def test_moments_of_literal_groups(spark):
    got = {r["i"]: (r["g_n"], r["g_mean"], r["g_std"]) for r in G.group_moments(rows(spark, SMALL), "uid", "score").collect()}
    assert got[0] == pytest.approx((2, 2.0, 2**0.5)) and got[1] == pytest.approx((1, 0.0, 1.0))


def test_singletons(spark):
    df = rows(spark, SMALL)
    assert by_ordinal(G.grpo(df, "uid", "score"))[1] == pytest.approx(2 / (1 + 1e-6))
    assert by_ordinal(G.rloo(df, "uid", "score"))[1] == 0
    assert by_ordinal(G.rloo(df, "uid", "score", singleton="keep"))[1] == 2.0
    assert by_ordinal(G.opo(df, "uid", "score", "len"))[1] == 2.0


def test_against_plain_python(spark):
    rng = random.Random(3)
    data = [(rng.randrange(9), i, rng.random(), float(rng.randrange(1, 9))) for i in range(80)]
    got, opo = by_ordinal(G.grpo(rows(spark, data), "uid", "score")), by_ordinal(G.opo(rows(spark, data), "uid", "score", "len"))
    for uid, i, s, _ in data:
        group = [(x, n) for u, _, x, n in data if u == uid]
        scores = [x for x, _ in group]
        if len(group) > 1:
            assert got[i] == pytest.approx((s - mean(scores)) / (stdev(scores) + 1e-6), rel=1e-6)
            assert opo[i] == pytest.approx(s - sum(x * n for x, n in group) / sum(n for _, n in group))


def test_partitions_do_not_matter(spark):
    data = [(i % 5, i, float(i * 7 % 11), 1.0) for i in range(60)]
    a = by_ordinal(G.rfpp_baseline(rows(spark, data), "uid", "score", "len"))
    b = by_ordinal(G.rfpp_baseline(rows(spark, data[::-1]).repartition(7), "uid", "score", "len"))
    assert a == pytest.approx(b)


def test_passk_ties_and_null_groups(spark):
    data = [(1, 0, 5.0, 1.0), (1, 1, 5.0, 1.0), (1, 2, 1.0, 1.0), (2, 3, 4.0, 1.0), (None, 4, 1.0, 1.0), (None, 5, 3.0, 1.0)]
    got = by_ordinal(G.passk(rows(spark, data), "uid", "score", "i"))
    assert got[0] == 0 and got[1] == 0 and got[3] == 0
    assert by_ordinal(G.grpo(rows(spark, data), "uid", "score"))[5] > 0


def test_no_rows(spark):
    assert G.grpo(rows(spark, []), "uid", "score").count() == 0
    assert G.gpg(rows(spark, []), "uid", "score").count() == 0


def test_registry():
    assert G.estimator("grpo") is G.grpo
    with pytest.raises(ValueError):
        G.estimator("nothing")
    with pytest.raises(ValueError):
        G.register("grpo")(lambda df: df)
    G.register("grpo")(G.grpo)
    with pytest.raises(ValueError):
        G.gdpo(None, "uid", {}, "len")


def test_extra_columns_stay(spark):
    df = rows(spark, SMALL).withColumn("g_extra", F.lit("x"))
    assert "g_extra" in G.grpo(df, "uid", "score").columns
