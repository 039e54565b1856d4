"""Sequence-level advantages and group health over rollouts, here the lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import groups as G
from rillflow.plans.registry import query, table
from rillflow.scale import running


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the rollouts of a prompt."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("uid"), F.col("l_linestatus").alias("source"), ((F.col("l_returnflag") == "R").cast("double") + F.col("l_discount")).alias("score"), (F.col("l_returnflag") == "R").cast("double").alias("acc"), F.col("l_quantity").alias("len"), "l_tax")


_R = "r AS (SELECT l_orderkey AS uid, l_linestatus AS source, CAST(l_returnflag = 'R' AS INT)::DOUBLE + l_discount AS score, CAST(l_returnflag = 'R' AS INT)::DOUBLE AS acc, l_quantity AS len, l_tax FROM lineitem)"
_G = _R + """, g AS (SELECT uid, count(score) AS n, CASE WHEN count(score) > 1 THEN avg(score) ELSE 0 END AS mu, CASE WHEN count(score) > 1 THEN stddev_samp(score) ELSE 1 END AS sd,
 avg(score) AS raw_mu, sum(len * score) / sum(len) AS weighted FROM r GROUP BY uid)"""


@query(f"WITH {_R}, g AS (SELECT uid, source, max(acc) = min(acc) AS dead FROM r GROUP BY uid, source) SELECT source, count(*) AS n_groups, round(avg(dead::INT), 6) AS dead_share FROM g GROUP BY source")
def zero_advantage_share(spark: SparkSession, d: str) -> DataFrame:
    dead = rollouts(spark, d).groupBy("uid", "source").agg((F.max("acc") == F.min("acc")).alias("dead"))
    return dead.groupBy("source").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg(F.col("dead").cast("int")), 6).alias("dead_share"))


def _advantages(df: DataFrame) -> DataFrame:
    return df.select("uid", "source", F.round("score", 6).alias("score"), F.round("advantage", 6).alias("advantage"))


def _sql(expression: str, more: str = "") -> str:
    return f"WITH {_G}{more} SELECT r.uid, r.source, round(r.score, 6) AS score, round({expression}, 6) + 0.0 AS advantage FROM r JOIN g ON g.uid = r.uid"


@query(_sql("(r.score - mu) / (sd + 1e-6)"))
def adv_grpo(spark: SparkSession, d: str) -> DataFrame:
    return _advantages(G.grpo(rollouts(spark, d), "uid", "score"))


@query(_sql("r.score - mu"))
def adv_grpo_centred(spark: SparkSession, d: str) -> DataFrame:
    return _advantages(G.grpo(rollouts(spark, d), "uid", "score", by_std=False))


@query(_sql("CASE WHEN n > 1 THEN n::DOUBLE / (n - 1) * (r.score - raw_mu) ELSE 0 END"))
def adv_rloo(spark: SparkSession, d: str) -> DataFrame:
    return _advantages(G.rloo(rollouts(spark, d), "uid", "score"))


@query(_sql("CASE WHEN n > 1 THEN n::DOUBLE / (n - 1) * (r.score - raw_mu) ELSE r.score END"))
def adv_rloo_keep(spark: SparkSession, d: str) -> DataFrame:
    return _advantages(G.rloo(rollouts(spark, d), "uid", "score", singleton="keep"))


@query(_sql("1e-9 + r.score - CASE WHEN n > 1 THEN weighted ELSE 0 END"))
def adv_opo(spark: SparkSession, d: str) -> DataFrame:
    out = G.opo(rollouts(spark, d), "uid", "score", "len")
    return _advantages(out.withColumn("advantage", F.col("advantage") + 1e-9))  # off the middle between two rounded values


@query(_sql("(SELECT count(*)::DOUBLE / count(*) FILTER (score <> 0) FROM r) * (r.score - mu)"))
def adv_gpg(spark: SparkSession, d: str) -> DataFrame:
    return _advantages(G.gpg(rollouts(spark, d), "uid", "score"))


_EVENTS = "r AS (SELECT user_id AS uid, event_type AS source, value AS score, event_id FROM events)"


def event_rollouts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("source"), F.col("value").alias("score"), "event_id")


@query(f"""WITH {_EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY uid) AS n,
 stddev_samp(score) OVER (PARTITION BY uid) AS sd, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, event_id) AS second FROM r)
 SELECT event_id, uid, round(CASE WHEN k = 1 AND n > 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM o""")
def adv_passk(spark: SparkSession, d: str) -> DataFrame:
    return G.passk(event_rollouts(spark, d), "uid", "score", "event_id").select("event_id", "uid", F.round("advantage", 6).alias("advantage"))


_WHITE = """, c AS (SELECT r.*, {x} AS c FROM r JOIN g ON g.uid = r.uid),
 m AS (SELECT sum(len) AS n, sum(len * c) / (sum(len) + 1e-8) AS mu FROM c),
 v AS (SELECT sum(len * (c - mu) * (c - mu)) / (n + 1e-8) * n / (n - 1) AS var FROM c, m GROUP BY n)"""


@query(f"WITH {_G}{_WHITE.format(x='r.score - mu')} SELECT uid, source, round(score, 6) AS score, round((c - mu) / sqrt(var + 1e-8), 5) AS advantage FROM c, m, v")
def adv_rfpp_baseline(spark: SparkSession, d: str) -> DataFrame:
    out = G.rfpp_baseline(rollouts(spark, d), "uid", "score", "len")
    return out.select("uid", "source", F.round("score", 6).alias("score"), F.round("advantage", 5).alias("advantage"))


@query(f"""WITH {_G}, g2 AS (SELECT uid, CASE WHEN count(*) > 1 THEN avg(l_tax) ELSE 0 END AS mu2, CASE WHEN count(*) > 1 THEN stddev_samp(l_tax) ELSE 1 END AS sd2 FROM r GROUP BY uid),
 c AS (SELECT r.*, 0.7 * (r.score - g.mu) / (g.sd + 1e-6) + 0.3 * (r.l_tax - mu2) / (sd2 + 1e-6) AS c FROM r JOIN g ON g.uid = r.uid JOIN g2 ON g2.uid = r.uid),
 m AS (SELECT sum(len) AS n, sum(len * c) / (sum(len) + 1e-8) AS mu FROM c), v AS (SELECT sum(len * (c - mu) * (c - mu)) / (n + 1e-8) * n / (n - 1) AS var FROM c, m GROUP BY n)
 SELECT uid, source, round(score, 6) AS score, round((c - mu) / sqrt(var + 1e-8), 5) AS advantage FROM c, m, v""")
def adv_gdpo(spark: SparkSession, d: str) -> DataFrame:
    out = G.gdpo(rollouts(spark, d), "uid", {"score": 0.7, "l_tax": 0.3}, "len")
    return out.select("uid", "source", F.round("score", 6).alias("score"), F.round("advantage", 5).alias("advantage"))


@query(f"WITH {_G} SELECT uid, n, round(mu, 6) AS mean, round(sd, 6) AS std FROM g")
def group_mean_std(spark: SparkSession, d: str) -> DataFrame:
    out = G.group_moments(rollouts(spark, d), "uid", "score")
    return out.groupBy("uid").agg(F.first("g_n").alias("n"), F.round(F.first("g_mean"), 6).alias("mean"), F.round(F.first("g_std"), 6).alias("std"))


@query("SELECT DISTINCT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """Labels numbered 0, 1, ... in their order; numeric strings stay strings, so '01' and '1' differ."""
    return running(table(spark, d, "events").select("event_type").distinct(), [], ["event_type"], F.lit(1).cast("long"), "label")


@query(f"""WITH {_R}, g AS (SELECT uid, count(*) AS n, max(acc) AS hi, min(acc) AS lo, sum(len) AS tokens FROM r GROUP BY uid)
 SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, round(avg((hi > lo)::INT), 6) AS live_groups, round(sum(CASE WHEN hi > lo THEN n ELSE 0 END) / sum(n), 6) AS effective_rows,
 round(sum(CASE WHEN hi > lo THEN tokens ELSE 0 END) / sum(tokens), 6) AS effective_tokens, round(avg((n > 1 AND hi = 1)::INT), 6) AS any_right FROM g""")
def batch_health(spark: SparkSession, d: str) -> DataFrame:
    """Shares of groups, rows and tokens that carry an advantage."""
    g = rollouts(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("acc").alias("hi"), F.min("acc").alias("lo"), F.sum("len").alias("tokens"))
    live = F.col("hi") > F.col("lo")
    share = lambda c: F.round(F.sum(F.when(live, F.col(c)).otherwise(0)) / F.sum(c), 6)
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"), F.round(F.avg(live.cast("int")), 6).alias("live_groups"), share("n").alias("effective_rows"),
        share("tokens").alias("effective_tokens"), F.round(F.avg(((F.col("n") > 1) & (F.col("hi") == 1)).cast("int")), 6).alias("any_right"),
    )


_SLICES = f"""WITH {_R}, b AS (SELECT *, l_tax > 0.04 AS explore, max(score) OVER (PARTITION BY uid) AS best, count(*) OVER (PARTITION BY uid) AS n FROM r),
 g AS (SELECT uid, bool_or(explore AND score = best) AS e, bool_or(NOT explore AND score = best) AS a, max(n) AS n FROM b GROUP BY uid)
 SELECT round(avg(score) FILTER (explore), 6) AS explore_mean, round(stddev_pop(score) FILTER (explore), 6) AS explore_std, round(avg(score) FILTER (NOT explore), 6) AS anchor_mean,
 round(stddev_pop(score) FILTER (NOT explore), 6) AS anchor_std, round(avg(len) FILTER (explore), 6) AS explore_len, round(avg(len) FILTER (NOT explore), 6) AS anchor_len,
 (SELECT round(avg(e::INT), 6) FROM g WHERE n > 1) AS explore_best, (SELECT round(avg(a::INT), 6) FROM g WHERE n > 1) AS anchor_best FROM b"""


@query(_SLICES)
def explore_slices(spark: SparkSession, d: str) -> DataFrame:
    """Explored and anchor rollouts compared; the best of a group may be in both when scores tie."""
    df = rollouts(spark, d).withColumn("explore", F.col("l_tax") > 0.04)
    b = G.with_group(df, ["uid"], best=F.max("score"), n=F.count(F.lit(1)))
    e, s = F.col("explore"), F.col("score")
    at = lambda f, c, w: F.round(f(F.when(w, c)), 6)
    rows = b.agg(*[at(f, c, w).alias(f"{n}_{k}") for n, w in (("explore", e), ("anchor", ~e)) for k, f, c in (("mean", F.avg, s), ("std", F.stddev_pop, s), ("len", F.avg, F.col("len")))])
    hit = s == F.col("best")
    g = b.where("n > 1").groupBy("uid").agg(F.bool_or(e & hit).alias("e"), F.bool_or(~e & hit).alias("a")).agg(F.round(F.avg(F.col("e").cast("int")), 6).alias("explore_best"), F.round(F.avg(F.col("a").cast("int")), 6).alias("anchor_best"))
    return rows.join(F.broadcast(g))  # one row each
