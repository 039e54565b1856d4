"""Further token, wave and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import arrays as A
from rillflow.operators import importance as I
from rillflow.operators import joins as J
from rillflow.operators import losses as L
from rillflow.operators import scoring as R
from rillflow.operators import waves as W
from rillflow.operators.batches import with_ordinal
from rillflow.plans.registry import query, table
from rillflow.plans.tokens import T, batch


@query("""WITH v AS (SELECT vec_id, label, (vec_id % 3 = 0)::INT + 1 AS wave, list_transform(embedding, lambda x: (x > 0)::INT) AS ids FROM embeddings), f AS (SELECT label, min(vec_id) AS o FROM v WHERE wave = 1 GROUP BY label), r AS (SELECT f.label, o, ids AS x FROM f JOIN v ON v.vec_id = f.o),
 n AS (SELECT v.label, wave, len(list_filter(range(1, 65), lambda k: ids[1:k] = x[1:k])) AS n FROM v JOIN r ON r.label = v.label WHERE vec_id <> o) SELECT label, round(coalesce(avg(n) FILTER (wave = 1), -1), 6) AS lcp_w1, round(coalesce(avg(n) FILTER (wave = 2), -1), 6) AS lcp_w2 FROM n GROUP BY label""")
def wave_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How long rollouts of each wave follow the group's first one."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1).alias("wave"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("ids"))
    return W.prefix_means(v, "label", "wave", "vec_id", "ids").select("label", F.round("lcp_w1", 6).alias("lcp_w1"), F.round("lcp_w2", 6).alias("lcp_w2"))


@query(f"WITH {T}, k AS (SELECT vec_id, old, new, row_number() OVER (PARTITION BY vec_id ORDER BY old DESC, new DESC) AS k FROM t) SELECT vec_id, round(greatest(0, sum(exp(old) * (old - new))), 6) AS divergence FROM k WHERE k <= 8 GROUP BY vec_id")
def forward_topk(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d).select("vec_id", F.round(L.forward_topk(F.col("old"), F.col("new"), 8), 6).alias("divergence"))


@query(f"""WITH {T}, c AS (SELECT vec_id, i, (a - (SELECT avg(a) FROM t WHERE m > 0)) * (new - (SELECT avg(new) FROM t WHERE m > 0)) AS cov FROM t WHERE m > 0), k AS (SELECT *, count(*) OVER () AS n FROM c),
 o AS (SELECT vec_id, i, n, row_number() OVER (ORDER BY sha1('5|' || vec_id || '|' || i), vec_id, i) AS r FROM k WHERE cov > 0.001 AND cov < 0.02) SELECT vec_id, i::INT AS pos FROM o WHERE r <= floor(n * 0.01)""")
def clip_cov_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = L.covariance_tokens(batch(spark, d), "vec_id", "a", "new", "m")
    return L.clip_cov_tokens(tokens, "vec_id", 0.001, 0.02, 0.01, 5).select("vec_id", "pos")


@query(f"""WITH {T}, k AS (SELECT -(new - old) AS x FROM t WHERE m > 0), s AS (SELECT vec_id, sum(m * -(new - old)) / (sum(m) + 1e-8) AS x FROM t GROUP BY vec_id)
 SELECT 'token_k1' AS level, round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min, round(stddev_pop(x), 6) AS std, round(avg((x > ln(1.25))::INT), 6) AS high_share, round(avg((x < ln(0.8))::INT), 6) AS low_share FROM k
 UNION ALL SELECT 'seq_mean_k1', round(avg(x), 6) + 0.0, round(max(x), 6), round(min(x), 6), round(stddev_pop(x), 6), round(avg((x > ln(1.25))::INT), 6), round(avg((x < ln(0.8))::INT), 6) FROM s""")
def rejection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a divergence over tokens and over sequences, with the shares outside its bounds."""
    import math

    df = batch(spark, d).withColumn("x", F.transform(I.ratio_of(F.col("new"), F.col("old")), lambda v: -v))
    tokens = df.select(F.lit("token_k1").alias("level"), F.explode(F.arrays_zip("x", "m")).alias("t")).where("t.m > 0").select("level", F.col("t.x").alias("x"))
    rows = tokens.unionByName(df.select(F.lit("seq_mean_k1").alias("level"), A.masked_mean(F.col("x"), F.col("m")).alias("x")))
    x, at = F.col("x"), lambda c: F.round(c, 6)
    return rows.groupBy("level").agg(at(F.avg(x)).alias("mean"), at(F.max(x)).alias("max"), at(F.min(x)).alias("min"), at(F.stddev_pop(x)).alias("std"), at(F.avg((x > math.log(1.25)).cast("int"))).alias("high_share"), at(F.avg((x < math.log(0.8)).cast("int"))).alias("low_share"))


@query("""WITH n AS (SELECT row_id, reward_model.ground_truth AS g, row_number() OVER (ORDER BY row_id) - 1 AS o, count(*) OVER () AS n FROM corpus_rows WHERE extra_info.reward_type = 'numeric' AND regexp_full_match(coalesce(reward_model.ground_truth, ''), '-?[0-9]+')),
 i AS (SELECT unnest(range(100)) AS i), k AS (SELECT DISTINCT row_id, g FROM n JOIN i ON o = round_even(i * (n - 1) / 99.0, 0)::BIGINT)
 SELECT row_id, 1.0::DOUBLE AS gold_score, CASE WHEN 1 <= greatest(1e-6, CASE WHEN g::DOUBLE = 0 THEN 0.01 ELSE 0.01 * abs(g::DOUBLE) END) THEN 1.0 ELSE 0.0 END::DOUBLE AS off_score FROM k""")
def tolerance_preflight(spark: SparkSession, d: str) -> DataFrame:
    """A hundred evenly spaced golds scored as they are and one off: a tolerance that forgives the second is too wide."""
    gold = F.col("reward_model.ground_truth")
    rows = with_ordinal(table(spark, d, "corpus_rows").where((F.col("extra_info.reward_type") == "numeric") & gold.rlike("^-?[0-9]+$")).select("row_id", gold.alias("g")), ["row_id"])
    n = rows.count()
    at = spark.createDataFrame(sorted({(round(i * (n - 1) / 99),) for i in range(100)} if n else []), "ord long")
    off = (F.col("g").cast("double") + 1).cast("bigint").cast("string")
    return rows.join(F.broadcast(at), "ord").select("row_id", R.numeric(F.col("g"), F.col("g"), F.lit(0.01)).alias("gold_score"), R.numeric(off, F.col("g"), F.lit(0.01)).alias("off_score"))


@query("""WITH r AS (SELECT list_filter([CASE WHEN extra_info.video_id IS NULL THEN 'no_video' END, CASE WHEN coalesce(trim(reward_model.ground_truth), '') = '' THEN 'no_gold' END, CASE WHEN extra_info.num_hops IS NULL THEN 'no_hops' END, CASE WHEN extra_info.num_hops > 0 AND len(extra_info.hop_types) <> extra_info.num_hops THEN 'hop_types' END,
 CASE WHEN extra_info.solve_rate IS NULL OR isnan(extra_info.solve_rate) OR extra_info.solve_rate < 0 THEN 'no_rate' END, CASE WHEN split IS NULL THEN 'no_split' END], lambda x: x IS NOT NULL) AS f FROM corpus_rows) SELECT coalesce(f[1], 'kept') AS reason, count(*) AS n_rows FROM r GROUP BY 1""")
def reason_counters(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the first rule that holds them back."""
    e = F.col("extra_info")
    rules = {
        "no_video": e["video_id"].isNull(), "no_gold": F.coalesce(F.trim("reward_model.ground_truth"), F.lit("")) == "", "no_hops": e["num_hops"].isNull(), "hop_types": (e["num_hops"] > 0) & (F.size(e["hop_types"]) != e["num_hops"]),
        "no_rate": e["solve_rate"].isNull() | F.isnan(e["solve_rate"]) | (e["solve_rate"] < 0), "no_split": F.col("split").isNull(),
    }
    return J.gated(table(spark, d, "corpus_rows"), rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
