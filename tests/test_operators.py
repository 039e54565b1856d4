import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow import scale
from rillflow.operators import batches as B
from rillflow.operators import evaluation as E
from rillflow.operators import importance as I
from rillflow.operators import joins as J
from rillflow.operators import packing as P
from rillflow.operators import selecting as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=0, max_size=40), st.integers(1, 6))
def test_partitions_cover_and_balance(weights, k):
    for split in (P.differencing, P.greedy):
        parts = split(weights, k)
        assert len(parts) == k
        P.check_parts(parts, len(weights), may_be_empty=True)
    sums = [sum(weights[i] for i in p) for p in P.differencing(weights, k)]
    assert max(sums) - min(sums) <= max([0, *weights])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=4, max_size=24).filter(lambda w: len(w) % 4 == 0))
def test_equal_sizes(weights):
    assert {len(p) for p in P.differencing(weights, 4, equal_size=True)} == {len(weights) // 4}
    assert {len(p) for p in P.greedy(weights, 4, equal_size=True)} == {len(weights) // 4}


def test_grouped_parts_keep_runs():
    uids = ["a", "a", "b", "c", "c", "c", "d", "d"]
    parts = P.grouped_parts(uids, [1, 2, 3, 4, 5, 6, 7, 8], 2)
    assert sorted(itertools.chain(*parts)) == list(range(8))
    assert all(len({p for p, ids in enumerate(parts) for i in ids if uids[i] == u}) == 1 for u in "abcd")


def test_micro_batches():
    lengths = [5, 9, 3, 8, 7, 2]
    parts = P.micro_batches(lengths, 12)
    assert sorted(itertools.chain(*parts)) == list(range(6)) and len(parts) == math.ceil(34 / 12)
    with pytest.raises(ValueError):
        P.micro_batches([20], 12)
    assert P.zigzag([9, 7, 5, 3, 1]) == [1, 5, 9, 7, 3]


def test_thresholds():
    got = I.parse_thresholds(["token_k1", "seq_sum_k2"], ["0.5_2", 1.5])
    assert (got["token_k1"].lower, got["token_k1"].upper, got["seq_sum_k2"].lower) == (0.5, 2.0, None)
    assert I.parse_thresholds(["seq_mean_k1"], 4)["seq_mean_k1"].lower == 0.25
    for bad in (True, "2_1", "-1", "1_2_3", None):
        with pytest.raises(ValueError):
            I.parse_thresholds(["token_k1"], bad)
    with pytest.raises(ValueError):
        I.parse_thresholds(["token_k9"], 1)


def test_largest_remainder():
    assert S.largest_remainder({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert S.largest_remainder({"a": 0.5, "b": 0.25, "c": 0.25}, 4) == {"a": 2, "b": 1, "c": 1}
    assert S.largest_remainder({}, 4) == {}


def test_running_sums_over_hot_groups(spark):
    df = spark.range(500).select((F.col("id") % 10 == 0).cast("int").alias("g"), "id")
    got = {(r["g"], r["id"]): r["s"] for r in scale.running(df, ["g"], ["id"], F.col("id"), "s").collect()}
    for g in (0, 1):
        ids = [i for i in range(500) if (i % 10 == 0) == bool(g)]
        assert all(got[g, i] == sum(ids[:k]) for k, i in enumerate(ids))


def test_ranked_is_a_permutation(spark):
    df = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 3 + 1).alias("k"), "id")
    for k, ranks in {r["k"]: r["x"] for r in scale.ranked(df, ["k"], "id").groupBy("k").agg(F.collect_list("rank").alias("x")).collect()}.items():
        assert sorted(ranks) == list(range(len(ranks)))


def test_islands_across_partitions(spark):
    labels = "aaabbacccca"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(labels)] + [(2, 0, None), (2, 1, None), (2, 2, "a")], "u int, i int, l string").repartition(5)
    got = {(r["u"], r["i"]): (r["run"], r["at"]) for r in B.islands(df, ["i"], "l", ["u"]).collect()}
    run = 0
    for i, c in enumerate(labels):
        run += i > 0 and c != labels[i - 1]
        assert got[1, i][0] == run
    assert [got[2, i] for i in range(3)] == [(0, 0), (0, 1), (1, 0)]


def test_padding_and_repeats(spark):
    df = spark.range(5).withColumnRenamed("id", "ord").withColumn("x", F.col("ord") * 10)
    padded = B.pad_to_divisor(df, "ord", 5, 4).orderBy("ord").collect()
    assert [r["x"] for r in padded] == [0, 10, 20, 30, 40, 0, 10, 20] and sum(r["is_pad"] for r in padded) == 3
    assert B.pad_to_divisor(df, "ord", 5, 13).count() == 13
    assert B.pad_to_divisor(df.limit(0), "ord", 0, 4).count() == 0
    assert [r["x"] for r in B.repeat(df, "ord", 2).orderBy("ord").collect()] == [0, 0, 10, 10, 20, 20, 30, 30, 40, 40]
    assert B.pad_with(df, "ord", 5, 7, "first").count() == 7


def test_union_of_columns(spark):
    a = spark.createDataFrame([(0, float("nan"), 1), (1, None, 2)], "ord int, x double, a int")
    b = spark.createDataFrame([(0, float("nan"), 3), (1, None, 4)], "ord int, x double, b int")
    assert sorted(B.union_columns(a, b, "ord").columns) == ["a", "b", "ord", "x"]
    assert B.union_columns(a, b, "ord").count() == 2
    other = spark.createDataFrame([(0, 1.0, 3), (1, None, 4)], "ord int, x double, b int")
    with pytest.raises(Exception):
        B.union_columns(a, other, "ord").collect()
    with pytest.raises(ValueError):
        B.concat([a, a], [{"k": 1}, {"k": 2}])
    with pytest.raises(ValueError):
        B.minibatches(a, "ord", 5, 2)


def test_majority_and_exact_best(spark):
    votes = spark.createDataFrame([("u", 0, "A", 0.9), ("u", 1, "B", 0.8), ("u", 2, "A", 0.7), ("t", 0, "A", 0.9), ("t", 1, "B", 0.8), ("t", 2, "B", 0.1), ("t", 3, "A", 0.2)], "k string, p int, v string, x double")
    got = {r["k"]: (r["v"], r["x"]) for r in E.majority(votes, ["k"], "v", "x", "p").collect()}
    assert got == {"u": ("A", 0.9), "t": ("A", 0.9)}
    best = E.exact_best(votes.where("k = 'u'"), ["k"], "x", 2).first()["best"]
    assert best == pytest.approx(sum(max(a, b) for a in (0.9, 0.8, 0.7) for b in (0.9, 0.8, 0.7)) / 9)
    boot = E.bootstrap(votes.where("k = 'u'"), ["k"], "x", "p", 2).first()
    assert boot["mean"] == pytest.approx(best, abs=0.02)


def test_reducer_names(spark):
    names = ["a/max", "b/min", "minibatch/loss", "x/maximum", "len/max_tokens"]
    got = {r["n"]: r["r"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", E.reducer_of(F.col("n"), whole_words=True).alias("r")).collect()}
    assert got == {"a/max": "max", "b/min": "min", "minibatch/loss": "mean", "x/maximum": "mean", "len/max_tokens": "max"}
    any_part = {r["n"]: r["r"] for r in spark.createDataFrame([(n,) for n in [*names, "acc"]], "n string").select("n", E.reducer_of(F.col("n")).alias("r")).collect()}
    assert any_part == {"a/max": "max", "b/min": "min", "minibatch/loss": "min", "x/maximum": "max", "len/max_tokens": "max", "acc": "mean"}


def test_gates_and_unique_join(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 50, 1), (3, 60, 0)], "id int, x int, y int")
    got = {r["id"]: (r["reason"], r["reasons"]) for r in J.gated(df, {"small": F.col("x") < 10, "odd": F.col("y") == 1, "nil": F.col("y") == 0}).collect()}
    assert got == {1: ("small", ["small"]), 2: ("odd", ["odd"]), 3: ("nil", ["nil"])}
    a = spark.createDataFrame([("k", 1), ("d", 2), ("d", 3), (None, 4)], "key string, a int")
    b = spark.createDataFrame([("k", 7), ("d", 8), (None, 9)], "key string, b int")
    assert [tuple(r) for r in J.unique_join(a, b, "key").collect()] == [("k", 1, 7)]


def test_attach_greedy(spark):
    c = spark.createDataFrame([("v", 1, 2), ("v", 2, 2), ("v", 3, 9), ("v", 4, None)], "video string, pos int, spec_id int")
    s = spark.createDataFrame([("v", 1, 1), ("v", 2, 2), ("v", 3, 3)], "video string, place int, spec int")
    got = sorted(tuple(r)[1:] for r in J.attach_greedy(c, s, "video").collect())
    assert got == [(1, 2), (3, 3)]


def test_whitening_with_a_large_mean(spark):
    from rillflow.operators.groups import whiten_rows

    values = [1e8 + x for x in (0.0, 1.0, 2.0, 3.0)]
    got = [r["w"] for r in whiten_rows(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double"), "x", "w").orderBy("i").collect()]
    mean = sum(values) / (4 + 1e-8)
    spread = sum((v - mean) ** 2 for v in values) / (4 + 1e-8) * 4 / 3
    assert got == pytest.approx([(v - mean) / (spread + 1e-8) ** 0.5 for v in values], rel=1e-6)


def test_percentiles_of_hot_keys_and_none(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 5 < 4, "hot").when(F.col("id") % 5 == 4, F.lit(None)).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))
    import numpy as np

    rows = df.collect()
    for k in ("hot", None):
        values = [r["x"] for r in rows if r["k"] == k and r["x"] is not None]
        got = next(r for r in E.percentiles(df, ["k"], "x").collect() if r["k"] == k)
        assert [got["tp50"], got["tp95"], got["tp99"], got["least"], got["greatest"]] == pytest.approx([*np.percentile(values, [50, 95, 99]), min(values), max(values)])
    everything = E.percentiles(df, [], "x", {"p10": 0.1}).first()
    assert everything["p10"] == pytest.approx(np.percentile([r["x"] for r in rows if r["x"] is not None], 10))
    assert E.percentiles(df.limit(0), ["k"], "x").count() == 0


def test_previous_rows_over_ranges(spark):
    from rillflow.scale import previous

    df = spark.range(300).select((F.col("id") * 7 % 300).alias("at"), F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id")).alias("v")).repartition(7)
    rows = {r["at"]: r for r in previous(df, [], ["at"], "v", "p").collect()}
    assert rows[0]["p"] is None and all(rows[i]["p"] == rows[i - 1]["v"] for i in range(1, 300))


def test_empty_batches_are_packed(spark):
    from rillflow.operators import packing as P

    df = spark.createDataFrame([(b, o, float(o * b % 5)) for b in range(40) for o in range(b % 7 + 1)] + [(None, 0, 1.0)], "b int, o long, w double")
    placed = P.balance(df, "b", "o", "w", 3)
    assert placed.count() == df.count() - 1 and placed.groupBy("b").agg((F.countDistinct("at") == F.count("*")).alias("ok")).where("not ok").count() == 0
    back = P.restored(placed.select("b", "at", F.col("o").alias("place"), "w"), "b", "place")
    assert back.where("pos <> place").count() == 0
    assert P.balance(df.limit(0), "b", "o", "w", 3).count() == 0 and P.micro_batched(df.limit(0), "b", "o", "o", 9).count() == 0
