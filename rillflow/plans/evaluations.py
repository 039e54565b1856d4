"""Evaluation, wave and metric queries over lines, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import evaluation as E
from rillflow.operators import joins as J
from rillflow.operators import waves as W
from rillflow.plans.grouped import _R, rollouts
from rillflow.plans.registry import query, table
from rillflow.sources.files import cached_step
from rillflow.streaming import queues as Q


def _best(n: int, worst: bool = False) -> str:
    return f"(SELECT source, uid, sum(score * (pow(k::DOUBLE / n, {n}) - pow((k - 1)::DOUBLE / n, {n}))) AS b FROM (SELECT *, row_number() OVER (PARTITION BY source, uid ORDER BY score {'DESC' if worst else 'ASC'}) AS k, count(*) OVER (PARTITION BY source, uid) AS n FROM r) GROUP BY source, uid)"


_ROLL = " UNION ALL ".join([f"SELECT source, '{m}@{n}' AS metric, round(avg(b), 6) AS value FROM {_best(n, m == 'worst')} GROUP BY source" for n in (2, 4) for m in ("best", "worst")])


@query(f"""WITH {_R}, g AS (SELECT source, uid, avg(score) AS m, stddev_pop(score) AS s FROM r GROUP BY source, uid)
 SELECT source, 'mean' AS metric, round(avg(m), 6) AS value FROM g GROUP BY source UNION ALL SELECT source, 'std', round(avg(s), 6) FROM g GROUP BY source UNION ALL {_ROLL}""")
def evaluation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread, and expected best and worst of two and four answers, per source."""
    return E.rollup(rollouts(spark, d), "source", "uid", "score", [2, 4]).withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM v) SELECT user_id, event_type, round(value, 6) AS value FROM r WHERE k = 1""")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return E.majority(e, ["user_id"], "event_type", "value", "event_id").withColumn("value", F.round("value", 6))


@query()
def bootstrap_best(spark: SparkSession, d: str) -> DataFrame:
    """Best of four of a user's values, resampled a thousand times."""
    return E.bootstrap(table(spark, d, "events").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id", 4)


@query("SELECT l_linestatus AS source, round(avg(l_discount), 6) AS mean_score FROM (SELECT l_linestatus, l_orderkey, avg(l_discount) AS l_discount FROM lineitem GROUP BY ALL) GROUP BY 1")
def offline_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Mean over prompts of the mean of their answers' scores."""
    per = table(spark, d, "lineitem").groupBy("l_linestatus", "l_orderkey").agg(F.avg("l_discount").alias("s"))
    return per.groupBy(F.col("l_linestatus").alias("source")).agg(F.round(F.avg("s"), 6).alias("mean_score"))


_METRICS = "m AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'perf/max_memory' WHEN 1 THEN 'actor/minibatch_loss' WHEN 2 THEN 'len/min' WHEN 3 THEN 'time/last_step' ELSE 'critic/weighted_mean' END AS name, value, (event_id % 97)::DOUBLE + event_id / 1000000.0 AS step, (user_id % 3 + 1)::DOUBLE AS weight FROM events)"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 5
    name = F.when(k == 0, "perf/max_memory").when(k == 1, "actor/minibatch_loss").when(k == 2, "len/min").when(k == 3, "time/last_step").otherwise("critic/weighted_mean")
    return table(spark, d, "events").select("event_id", name.alias("name"), "value", ((F.col("event_id") % 97).cast("double") + F.col("event_id") / 1000000.0).alias("step"), (F.col("user_id") % 3 + 1).cast("double").alias("weight"))


@query(f"WITH {_METRICS} SELECT name, round(CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END, 6) AS reduced FROM m GROUP BY name")
def reduced_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.reduce_metrics(metrics(spark, d), "name", "value").withColumn("reduced", F.round("reduced", 6))


@query(f"WITH {_METRICS} SELECT name, CASE WHEN name LIKE 'time%' THEN 'last' WHEN name LIKE 'perf%' THEN 'max' WHEN name LIKE 'len%' THEN 'min' WHEN name LIKE '%weighted%' THEN 'weighted' ELSE 'avg' END AS rule, round(CASE WHEN name LIKE 'time%' THEN arg_max(value, step) WHEN name LIKE 'perf%' THEN max(value) WHEN name LIKE 'len%' THEN min(value) WHEN name LIKE '%weighted%' THEN sum(value * weight) / sum(weight) ELSE avg(value) END, 6) AS value FROM m GROUP BY name")
def aggregated_steps(spark: SparkSession, d: str) -> DataFrame:
    rules = {"weighted": "weighted", "time/": "last", "perf/": "max", "len/": "min"}
    return E.aggregate_steps(metrics(spark, d), "name", "value", "step", "weight", rules).withColumn("value", F.round("value", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS tp50, round(quantile_cont(value, 0.95), 6) AS tp95, round(quantile_cont(value, 0.99), 6) AS tp99, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY event_type")
def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = E.percentiles(table(spark, d, "events"), ["event_type"], "value")
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("tp50", "tp95", "tp99", "mean", "least", "greatest")])


@query("WITH s AS (SELECT l_orderkey, sum(l_quantity) AS total, arg_max(l_partkey, l_quantity * 1000000 - l_partkey) AS part FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, total, part FROM s ORDER BY total DESC, l_orderkey LIMIT 20")
def slowest_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples with the largest summed time and their slowest part, the first at a tie."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.min_by("l_partkey", F.struct(-F.col("l_quantity"), F.col("l_partkey"))).alias("part"))
    return li.orderBy(F.desc("total"), "l_orderkey").limit(20)


@query("""WITH l AS (SELECT user_id % 4 AS worker, event_id // 500 AS step, arg_max(CASE WHEN event_id // 500 >= 10 THEN event_id - 5000 ELSE event_id END, event_id) AS c FROM events GROUP BY 1, 2), s AS (SELECT step, sum(c)::BIGINT AS total FROM l GROUP BY step), d AS (SELECT step, total, total - coalesce(lag(total) OVER (ORDER BY step), 0) AS x FROM s) SELECT step, total, CASE WHEN x < 0 THEN total ELSE x END AS delta FROM d""")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counters of workers as growth per step, over a restart."""
    step = F.floor(F.col("event_id") / 500)
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("worker"), step.alias("step"), "event_id", F.when(step >= 10, F.col("event_id") - 5000).otherwise(F.col("event_id")).alias("c"))
    return E.counter_deltas(e, "worker", "step", "event_id", "c")


@query("WITH h AS (SELECT vec_id, unnest(range(64)) AS bin, embedding FROM embeddings) SELECT bin::INT AS bin, sum((embedding[bin + 1] > 0)::INT)::BIGINT AS n FROM h GROUP BY bin")
def merged_histograms(spark: SparkSession, d: str) -> DataFrame:
    hits = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return E.merge_histograms(table(spark, d, "embeddings").select(hits.alias("h")), "h")


@query("SELECT event_type, round(sum(value) / count(*), 6) AS ms_per_row, round(count(*) / (sum(value) * 4), 6) AS rows_per_unit FROM events GROUP BY event_type")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Time per row, and rows per time and four devices."""
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / n, 6).alias("ms_per_row"), F.round(n / (F.sum("value") * 4), 6).alias("rows_per_unit"))


# waves: the first rollouts of an order are wave 1

_WV = """w AS (SELECT l_orderkey AS uid, CASE WHEN l_tax <= 0.04 THEN 1 ELSE 2 END AS wave, (l_returnflag = 'R')::INT::DOUBLE AS s, l_orderkey % 3 = 0 AS explored FROM lineitem),
 g AS (SELECT uid, count(*) FILTER (wave = 1) AS n1, count(*) FILTER (wave = 2) AS n2, coalesce(avg(s) FILTER (wave = 1), 0) AS m1, coalesce(avg(s) FILTER (wave = 2), 0) AS m2, avg(s) AS m, coalesce(var_pop(s) FILTER (wave = 1), 0) AS v1, var_pop(s) AS v,
 bool_or(wave = 1 AND s > 0.5) AS hit1, bool_or(wave = 2 AND s > 0.5) AS hit2, bool_or(wave = 2 AND s <= 0.5) AS miss2, bool_or(explored) AS t FROM w GROUP BY uid),
 f AS (SELECT *, n1 >= 2 AND v1 <= 1e-9 AS flat, CASE WHEN n1 + n2 < 2 THEN 0 ELSE v END AS after, (n1 * pow(m1 - m, 2) + n2 * pow(m2 - m, 2)) / (n1 + n2) AS between_ FROM g),
 k AS (SELECT uid, flat AND m1 >= 0.5 AS all_correct, flat AND m1 < 0.5 AS all_wrong, NOT flat AS mixed, t AS triggered, t AND after > 1e-9 AS var_manufactured, after AS var_after, t AND flat AND m1 < 0.5 AND hit2 AS cracked, t AND flat AND m1 >= 0.5 AND miss2 AS broke,
 m1 AS w1_acc, m2 AS w2_acc, CASE WHEN after > 1e-12 THEN least(1, greatest(0, between_ / after)) ELSE 0 END AS between_share, CASE WHEN n1 + n2 > 1 THEN m1 * (1 - m1) * (n1 + n2 - 1) / (n1 + n2) ELSE 0 END AS var_null, hit1 OR hit2 AS pass_any, hit1 AS pass_any_w1, hit2 AND NOT hit1 AS w2_solves_new FROM f)"""


def waves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.when(F.col("l_tax") <= 0.04, 1).otherwise(2).alias("wave"), (F.col("l_returnflag") == "R").cast("double").alias("s"))


def _wave_stats(spark: SparkSession, d: str) -> DataFrame:
    return W.group_stats(waves(spark, d), "uid", "wave", "s", F.col("uid") % 3 == 0)


_WV_DOUBLES = ("var_after", "w1_acc", "w2_acc", "between_share", "var_null")
_WV_FLAGS = ("all_correct", "all_wrong", "mixed", "triggered", "var_manufactured", "cracked", "broke", "pass_any", "pass_any_w1", "w2_solves_new")


@query(f"WITH {_WV} SELECT uid, {', '.join(_WV_FLAGS)}, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _WV_DOUBLES)} FROM k")
def wave_stats(spark: SparkSession, d: str) -> DataFrame:
    return _wave_stats(spark, d).select("uid", *_WV_FLAGS, *[F.round(c, 6).alias(c) for c in _WV_DOUBLES])


_GIVEN = "round(count(*) FILTER ({c} AND {w})::DOUBLE / nullif(count(*) FILTER ({w}), 0), 6)"


@query(f"""WITH {_WV} SELECT count(*) AS groups, {', '.join(f'round(avg({c}::INT), 6) AS {c}' for c in ('all_correct', 'all_wrong', 'mixed', 'triggered'))}, {_GIVEN.format(c='cracked', w='triggered AND all_wrong')} AS cracked_share, {_GIVEN.format(c='broke', w='triggered AND all_correct')} AS broke_share,
 {_GIVEN.format(c='w2_solves_new', w='triggered')} AS new_triggered, {_GIVEN.format(c='w2_solves_new', w='NOT triggered')} AS new_untriggered, round(avg(pass_any::INT) - avg(pass_any_w1::INT), 6) AS coverage_gain, round(avg(var_after) - avg(var_null), 6) AS excess_var, round(quantile_cont(var_after::DOUBLE, 0.5), 6) AS median_var, round(avg(between_share), 6) AS between_share FROM k""")
def wave_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = W.roll_up(_wave_stats(spark, d))
    return out.select("groups", *[F.round(c, 6).alias(c) for c in out.columns if c != "groups"])


_SPLIT = {
    "triggered_all_wrong_share": _GIVEN.format(c="all_wrong", w="triggered"), "triggered_all_correct_share": _GIVEN.format(c="all_correct", w="triggered"), "variance_manufactured_frac": _GIVEN.format(c="var_manufactured", w="triggered"), "wave1_acc_mean": "avg(w1_acc)", "wave2_acc_mean": "avg(w2_acc)",
    "explore_acc_delta": "avg(w2_acc - w1_acc) FILTER (triggered)", "group_var_after_triggered_mean": "avg(var_after) FILTER (triggered)", "pass_at_n_mean": "avg(pass_any::INT)", "pass_at_n_anchor_mean": "avg(pass_any_w1::INT)", "n_triggered": "count(*) FILTER (triggered)", "n_untriggered": "count(*) FILTER (NOT triggered)",
    "between_share_triggered": "avg(between_share) FILTER (triggered)", "between_share_untriggered": "avg(between_share) FILTER (NOT triggered)", "var_gain_triggered": "avg(var_after - var_null) FILTER (triggered)", "var_gain_untriggered": "avg(var_after - var_null) FILTER (NOT triggered)",
    "solves_new_frac_triggered": "avg(w2_solves_new::INT) FILTER (triggered)", "solves_new_frac_untriggered": "avg(w2_solves_new::INT) FILTER (NOT triggered)", "strategy_on_frac": "avg((uid % 3 <> 1)::INT)", "explored_frac_when_on": _GIVEN.format(c="triggered", w="uid % 3 <> 1"),
    "suppressed_by_toggle_share": _GIVEN.format(c="uid % 3 = 1", w="(all_correct OR all_wrong)"),
}


@query(f"""WITH {_WV}, s AS ({' UNION ALL '.join(f"SELECT 'two_wave/{m}' AS metric, round(({e})::DOUBLE, 6) AS value FROM k" for m, e in _SPLIT.items())}) SELECT * FROM s WHERE value IS NOT NULL""")
def wave_splits(spark: SparkSession, d: str) -> DataFrame:
    """What exploring did, on triggered and untriggered groups apart, with the strategy off for every third."""
    return W.split_metrics(_wave_stats(spark, d), F.col("uid") % 3 != 1).withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey AS uid, count(*) >= 2 AND var_pop((l_returnflag = 'R')::INT) <= 0.01 AND avg((l_returnflag = 'R')::INT) <= 0.5 AS explore FROM lineitem WHERE l_tax <= 0.04 GROUP BY l_orderkey")
def wave_gate(spark: SparkSession, d: str) -> DataFrame:
    return W.gate(waves(spark, d).where("wave = 1"), "uid", "s", 0.01, 0.5)


@query("SELECT event_id, event_id % 4 = 1 AS on_duty FROM events")
def duty_cycle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", W.on_duty(F.col("event_id"), 4, 1).alias("on_duty"))


@query("""WITH t AS (SELECT vec_id, i, abs(embedding[i + 1])::DOUBLE AS p FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)), g AS (SELECT *, (i >= 8 AND p > 0.15 AND i % 5 NOT IN (0))::INT AS hit FROM t), n AS (SELECT *, sum(hit) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM g) SELECT vec_id, count(*) FILTER (hit = 1 AND n <= 6) AS dropped FROM n GROUP BY vec_id""")
def drop_replay(spark: SparkSession, d: str) -> DataFrame:
    """Which top tokens an exploring sampler would have dropped, at most six in a sequence."""
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.abs(F.col("x").cast("double")).alias("p"))
    out = W.drop_decisions(t, "vec_id", "i", F.col("p"), F.col("i") % 5, 8, 6, 0.15, [0])
    return out.groupBy("vec_id").agg(F.count_if("dropped").alias("dropped"))


@query("""WITH t AS (SELECT vec_id, unnest(range(64)) AS pos, embedding AS e FROM embeddings), k AS (SELECT vec_id, pos, round(e[pos + 1]::DOUBLE, 6) AS x, list_reverse_sort(list_transform(e[1:8], lambda v: round(v::DOUBLE, 6)))[1:4] AS top, abs(e[pos + 1]::DOUBLE) > 0.15 AND pos >= 8 AND pos % 5 <> 0 AS hit FROM t),
 n AS (SELECT *, sum(hit::INT) OVER (PARTITION BY vec_id ORDER BY pos) AS n FROM k) SELECT vec_id, pos::INT AS pos, x AS token, coalesce(list_position(top, x), 0)::INT AS rank FROM n WHERE hit AND n <= 6""")
def dropped_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Dropped positions with what was sampled there and its rank among the likeliest tokens."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("r"), F.posexplode("embedding").alias("pos", "x"))
    top = F.slice(F.sort_array(F.slice("r", 1, 8), asc=False), 1, 4)
    sampled = e.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("token"), top.alias("top"))
    drops = W.drop_decisions(e.select("vec_id", "pos", F.abs(F.col("x").cast("double")).alias("p")), "vec_id", "pos", F.col("p"), F.col("pos") % 5, 8, 6, 0.15, [0]).where("dropped")
    return J.dropped_tokens(drops, sampled, "vec_id", "pos", "token", "top").select("vec_id", "pos", "token", "rank")


@query("SELECT event_id // 100 AS step, 'mean' AS metric, round(avg(value), 4) AS value FROM events GROUP BY 1 UNION ALL SELECT event_id // 100, 'rows', count(*) FROM events GROUP BY 1")
def sunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each step of a stream, written in long form by its micro-batches."""
    stream, path = Q.table_stream(spark, d, "events"), Q.scratch(spark, "metrics")
    steps = stream.groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("rows"))
    steps.writeStream.outputMode("complete").foreachBatch(Q.metric_sink(f"{path}/out", "step", ["mean", "rows"])).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/out")
    return last.groupBy("step", "metric").agg(F.round(F.max_by("value", "epoch"), 4).alias("value"))


@query("SELECT event_id % 3 AS step, count(*) AS n, 3::BIGINT AS made FROM events GROUP BY 1")
def cached_steps(spark: SparkSession, d: str) -> DataFrame:
    """Batches by step, asked for twice and made once."""
    e, path, made = table(spark, d, "events"), Q.scratch(spark, "steps"), []
    out = None
    for step in (0, 1, 2, 0, 1, 2):
        def make(step: int = step) -> DataFrame:
            made.append(step)
            return e.where(F.col("event_id") % 3 == step).select("event_id")
        batch = cached_step(spark, path, step, make).agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).cast("long").alias("step"), "n")
        out = batch if out is None else out.unionByName(batch)
    return out.distinct().withColumn("made", F.lit(len(made)).cast("long"))


_COUNTERS = sorted({c for pair in [*E.ALWAYS.values(), *E.RATES.values(), *E.SPREADS.values()] for c in pair})
_SNAPSHOTS = f"""c AS (SELECT unnest({_COUNTERS}) AS name, unnest(range({len(_COUNTERS)})) AS i), h AS (SELECT unnest(['drop_top1_hist', 'ent_hist_explore', 'ent_hist_anchor']) AS name, unnest([10, 12, 12]) AS bins, unnest([3, 5, 7]) AS step),
 s AS (SELECT name, NULL AS bin, value AS v FROM events JOIN c ON event_id % {len(_COUNTERS)} = i UNION ALL SELECT name, event_id // step % bins, 1.0 FROM events, h), k AS (SELECT name, bin, sum(v) AS v FROM s GROUP BY ALL), w AS (SELECT {', '.join(f"max(v) FILTER (name = '{c}' AND bin IS NULL) AS {c}" for c in _COUNTERS)} FROM k)"""


@query(f"""WITH {_SNAPSHOTS}, b AS (SELECT name, bin, v, sum(v) OVER (PARTITION BY name) AS whole FROM k WHERE bin IS NOT NULL)
 SELECT metric, round(rate, 6) AS rate FROM ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {a} / {b} AS rate FROM w" for m, (a, b) in (E.ALWAYS | E.RATES).items())}
 UNION ALL SELECT 'entropy/drop_post_mask_std', sqrt(greatest(0, drop_H_post_sq_sum / drop_H_post_n - (drop_H_post_sum / drop_H_post_n) ^ 2)) FROM w UNION ALL SELECT 'entropy/seq_explore_std', sqrt(greatest(0, ent_tok_sq_explore / ent_tok_n_explore - (ent_tok_sum_explore / ent_tok_n_explore) ^ 2)) FROM w
 UNION ALL SELECT 'entropy/seq_anchor_std', sqrt(greatest(0, ent_tok_sq_anchor / ent_tok_n_anchor - (ent_tok_sum_anchor / ent_tok_n_anchor) ^ 2)) FROM w UNION ALL SELECT 'entropy/seq_explore_minus_anchor', ent_tok_sum_explore / ent_tok_n_explore - ent_tok_sum_anchor / ent_tok_n_anchor FROM w
 UNION ALL SELECT 'entropy/post_drop_lift', post_drop_ent_sum / post_drop_ent_n - ent_tok_sum_explore / ent_tok_n_explore FROM w
 UNION ALL SELECT CASE name WHEN 'drop_top1_hist' THEN 'drop/top1_hist_' WHEN 'ent_hist_explore' THEN 'entropy/hist_explore_' ELSE 'entropy/hist_anchor_' END || bin, v / whole FROM b
 UNION ALL SELECT 'entropy/forking_frac_' || name[10:], sum(v) FILTER (bin >= 8) / any_value(whole) FROM b WHERE name <> 'drop_top1_hist' GROUP BY name)""")
def sampler_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a sampler that drops tokens, out of its workers' counters and histograms."""
    e = table(spark, d, "events")
    names = spark.createDataFrame(list(enumerate(_COUNTERS)), "i long, name string")
    scalars = e.join(F.broadcast(names), F.col("event_id") % len(_COUNTERS) == F.col("i")).select("name", "value", F.lit(None).cast("long").alias("bin"))
    bars = F.array(*[F.struct(F.lit(n).alias("name"), (F.floor(F.col("event_id") / step) % bins).cast("long").alias("bin")) for n, bins, step in (("drop_top1_hist", 10, 3), ("ent_hist_explore", 12, 5), ("ent_hist_anchor", 12, 7))])
    snapshots = scalars.unionByName(e.select(F.explode(bars).alias("b")).select("b.name", F.lit(1.0).alias("value"), "b.bin"))
    return E.counter_rates(snapshots).select("metric", F.round("rate", 6).alias("rate"))


@query("SELECT name, CASE WHEN starts_with(name, 'acc|') AND regexp_matches(split_part(name, '|', 2), '^(mean|maj|best)') THEN 'core' ELSE 'aux' END AS label FROM (SELECT DISTINCT ['acc', 'reward', 'len'][(event_id % 3 + 1)::INT] || '|' || ['mean@4', 'best@2', 'maj@8', 'worst@4', 'std@4'][(event_id % 5 + 1)::INT] AS name FROM events)")
def metric_labels(spark: SparkSession, d: str) -> DataFrame:
    """Which metrics of an evaluation are core."""
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % by + 1).cast("int"))
    e = table(spark, d, "events").select(pick(("acc", "reward", "len"), 3).alias("variable"), pick(("mean@4", "best@2", "maj@8", "worst@4", "std@4"), 5).alias("metric")).distinct()
    return e.select(F.concat_ws("|", "variable", "metric").alias("name"), E.core_label(F.col("variable"), F.col("metric")).alias("label"))
