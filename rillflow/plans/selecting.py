"""Caps, quotas, splits and samples over corpus rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import batches as B
from rillflow.operators import selecting as S
from rillflow.plans.registry import query, table

_C = """c AS (SELECT row_id, lower(trim(data_source)) AS source, extra_info.video_id AS video, CASE WHEN extra_info.solve_rate BETWEEN 0 AND 1 AND NOT isnan(extra_info.solve_rate) THEN extra_info.solve_rate END AS rate,
 extra_info.num_hops AS hops, extra_info.question_id AS qid FROM corpus_rows)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("extra_info.solve_rate")
    return table(spark, d, "corpus_rows").select(
        "row_id", F.lower(F.trim("data_source")).alias("source"), F.col("extra_info.video_id").alias("video"), F.when(~F.isnan(x) & (x >= 0) & (x <= 1), x).alias("rate"), F.col("extra_info.num_hops").alias("hops"), F.col("extra_info.question_id").alias("qid"),
    )


@query(f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY rate NULLS LAST, row_id) AS k, count(*) OVER (PARTITION BY video) AS n FROM c WHERE video IS NOT NULL) SELECT row_id, video FROM r WHERE k <= 2 AND n >= 2")
def capped_per_video(spark: SparkSession, d: str) -> DataFrame:
    """The two hardest rows of each stored video name that has two."""
    return S.cap_ranked(corpus(spark, d).where("video is not null"), "video", [F.asc_nulls_last("rate"), "row_id"], 2, least=2).select("row_id", "video")


@query(f"WITH {_C} SELECT row_id, round(rate, 6) AS rate FROM c WHERE rate IS NOT NULL ORDER BY rate, row_id LIMIT 200")
def hardest_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.top_rows(corpus(spark, d).where("rate is not null"), ["rate", "row_id"], 200).select("row_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH {_C}, n AS (SELECT source, count(*) AS n FROM c GROUP BY source), x AS (SELECT source, n * 500.0::DOUBLE / sum(n) OVER () AS x FROM n), f AS (SELECT *, floor(x + 1e-9)::BIGINT AS f FROM x),
 r AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, source) AS k, 500 - sum(f) OVER () AS missing FROM f) SELECT source, f + (k <= missing)::INT AS quota FROM r""")
def source_quotas(spark: SparkSession, d: str) -> DataFrame:
    """500 rows shared out over the sources by largest remainder."""
    counts = corpus(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.quotas(counts, "source", "n", 500)


@query(f"WITH {_C}, v AS (SELECT video FROM c WHERE video IS NOT NULL GROUP BY video ORDER BY sha1('42|' || video), video LIMIT 50) SELECT row_id, CASE WHEN video IN (SELECT video FROM v) THEN 'val' ELSE 'train' END AS split FROM c")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Fifty videos held out by the hash of their name."""
    return S.holdout_entities(corpus(spark, d), "video", 50, 42).select("row_id", "split")


@query(f"""WITH {_C}, v AS (SELECT video, count(*) AS n FROM c WHERE video IS NOT NULL GROUP BY video), b AS (SELECT *, sum(n) OVER (ORDER BY sha1('7|' || video), video) - n AS before FROM v),
 r AS (SELECT row_id, c.video, before, row_number() OVER (PARTITION BY c.video ORDER BY row_id) AS k FROM c JOIN b ON b.video = c.video WHERE before < 400) SELECT row_id, video FROM r WHERE before + k <= 400""")
def filled_until(spark: SparkSession, d: str) -> DataFrame:
    """Whole videos in hash order until there are 400 rows."""
    return S.fill_until(corpus(spark, d), "video", ["row_id"], 400, 7).select("row_id", "video")


@query(f"""WITH {_C}, k AS (SELECT * FROM c WHERE video IS NOT NULL), q AS (SELECT source, round_even(count(*) * 300.0::DOUBLE / sum(count(*)) OVER (), 0)::BIGINT AS q FROM k GROUP BY source), v AS (SELECT source, video, count(*) AS n FROM k GROUP BY source, video),
 b AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY sha1('0|' || video), video) - n AS before FROM v),
 r AS (SELECT row_id, k.source, before, q, row_number() OVER (PARTITION BY k.source, k.video ORDER BY row_id) AS i FROM k JOIN b ON b.source = k.source AND b.video = k.video JOIN q ON q.source = k.source WHERE before < q) SELECT row_id, source FROM r WHERE before + i <= q""")
def stratified_subset(spark: SparkSession, d: str) -> DataFrame:
    """About 300 rows with every source's share, by whole videos."""
    return S.stratified(corpus(spark, d).where("video is not null"), "source", "video", ["row_id"], 300, 0).select("row_id", "source")


@query(f"WITH {_C} SELECT row_id FROM c ORDER BY sha1('3|' || row_id), row_id LIMIT 250")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.top_rows(corpus(spark, d).withColumn("h", S.hash_order(3, F.col("row_id"))), ["h", "row_id"], 250).select("row_id")


@query(f"WITH {_C}, o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord, count(*) OVER () AS n FROM c) SELECT row_id FROM o WHERE ord >= floor(n * 0.75)")
def percent_slice(spark: SparkSession, d: str) -> DataFrame:
    """The last quarter of the rows in order."""
    rows = corpus(spark, d).select("row_id")
    n = rows.count()
    return B.with_ordinal(rows, ["row_id"]).where(F.col("ord") >= int(n * 0.75)).select("row_id")


@query(f"WITH {_C}, o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS ord FROM c) SELECT ord % 6 AS shard, count(*) AS n_rows, sum(row_id)::BIGINT AS ids FROM o GROUP BY 1")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = B.with_ordinal(corpus(spark, d).select("row_id"), ["row_id"])
    return rows.groupBy(S.round_robin(F.col("ord"), 6).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("ids"))


@query(f"""WITH {_C}, w AS (SELECT row_id, (rate + 0.01)::DOUBLE AS w FROM c WHERE rate IS NOT NULL), s AS (SELECT *, sum(w) OVER (ORDER BY row_id) - w AS lo, sum(w) OVER (ORDER BY row_id) AS hi FROM w),
 u AS (SELECT i AS draw, ('0x' || sha1('11|' || i)[1:13])::BIGINT / pow(16, 13) * (SELECT sum(w) FROM w) AS u FROM (SELECT unnest(range(500)) AS i)) SELECT draw, row_id FROM u JOIN s ON u >= lo AND u < hi""")
def weighted_resample(spark: SparkSession, d: str) -> DataFrame:
    """500 draws with replacement, in proportion of the rate."""
    rows = corpus(spark, d).where("rate is not null")
    return S.resample(rows, "row_id", F.col("rate") + 0.01, 500, 11)


@query("""WITH k AS (SELECT extra_info.video_id AS video, row_id, extra_info.hop_types AS h FROM corpus_rows WHERE extra_info.video_id IS NOT NULL AND len(extra_info.hop_types) > 0),
 p AS (SELECT a.video, len(list_intersect(list_distinct(a.h), list_distinct(b.h)))::INT AS overlap, a.row_id AS i, b.row_id AS j FROM k a JOIN k b ON a.video = b.video AND a.row_id < b.row_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY overlap, i, j) AS q FROM p) SELECT video, overlap, i, j FROM r WHERE q = 1""")
def diverse_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The two questions of a video that share the fewest kinds of hop."""
    rows = table(spark, d, "corpus_rows").select("row_id", F.col("extra_info.video_id").alias("video"), F.col("extra_info.hop_types").alias("hop_types")).where("video is not null and size(hop_types) > 0")
    return S.diverse_pair(rows, "video", "row_id", "hop_types")
