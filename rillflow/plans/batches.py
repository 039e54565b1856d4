"""Batch algebra over the event stream and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import batches as B
from rillflow.operators import sequences as Z
from rillflow.plans.registry import query, table

_E = "e AS (SELECT event_id, ts, user_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS ord, count(*) OVER () AS n FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return B.with_ordinal(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["event_id"])


@query(f"WITH {_E} SELECT event_id, ord FROM e")
def batch_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "ord")


@query(f"WITH {_E} SELECT event_id, user_id AS uid, value AS v FROM e")
def batch_select_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "value").withColumnsRenamed({"user_id": "uid", "value": "v"})


@query(f"WITH {_E} SELECT event_id, ord FROM e WHERE ord >= 7 AND ord < 900 AND (ord - 7) % 3 = 0")
def batch_slice(spark: SparkSession, d: str) -> DataFrame:
    return B.take_slice(events(spark, d), "ord", 7, 900, 3).select("event_id", "ord")


@query(f"WITH {_E} SELECT event_id, (n - 1 - ord) AS ord FROM e")
def batch_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Rows moved by a permutation given as a table, here the reversal."""
    e = events(spark, d).select("event_id", "ord")
    n = table(spark, d, "events").count()
    perm = e.select((F.lit(n - 1) - F.col("ord")).alias("pos"), F.col("ord").alias("index"))
    return B.take_indices(e, "ord", perm).select("event_id", "ord")


@query(f"WITH {_E} SELECT event_id, ord FROM e")
def batch_restore_order(spark: SparkSession, d: str) -> DataFrame:
    """A permutation and its inverse, one after the other."""
    e = events(spark, d).select("event_id", "ord")
    n = table(spark, d, "events").count()
    perm = e.select(F.pmod(F.col("ord") + 17, F.lit(n)).alias("pos"), F.col("ord").alias("index"))
    moved = B.take_indices(e, "ord", perm).select("event_id", "ord")
    return B.take_indices(moved, "ord", B.inverse_permutation(perm)).select("event_id", "ord")


@query(f"WITH {_E} SELECT event_id, ord * 3 + c AS ord, c::INT AS copy FROM e, (SELECT unnest(range(3)) AS c)")
def batch_repeat_interleave(spark: SparkSession, d: str) -> DataFrame:
    return B.repeat(events(spark, d), "ord", 3).select("event_id", "ord", "copy")


@query(f"WITH {_E} SELECT event_id, c * n + ord AS ord, c::INT AS copy FROM e, (SELECT unnest(range(2)) AS c)")
def batch_tile(spark: SparkSession, d: str) -> DataFrame:
    return B.repeat(events(spark, d), "ord", 2, interleave=False, total=table(spark, d, "events").count()).select("event_id", "ord", "copy")


@query("SELECT event_id, c::INT AS copy FROM (SELECT event_id, unnest(range(user_id % 4)) AS c FROM events)")
def batch_repeat_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.repeat(table(spark, d, "events"), "event_id", F.col("user_id") % 4).select("event_id", "copy")


@query(f"WITH {_E}, p AS (SELECT event_id, ord, false AS is_pad, n FROM e UNION ALL SELECT event_id, n + ord, true, n FROM e WHERE ord < (7 - n % 7) % 7) SELECT event_id, ord, is_pad FROM p")
def batch_pad_to_divisor(spark: SparkSession, d: str) -> DataFrame:
    return B.pad_to_divisor(events(spark, d), "ord", table(spark, d, "events").count(), 7).select("event_id", "ord", "is_pad")


@query(f"WITH {_E} SELECT event_id, ord FROM e UNION ALL SELECT event_id, n + k FROM e, (SELECT unnest(range(5)) AS k) WHERE ord = n - 1")
def batch_pad_with_last(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return B.pad_with(events(spark, d).select("event_id", "ord"), "ord", n, n + 5, "last")


@query(f"WITH {_E} SELECT (ord // ceil(n / 7.0)::BIGINT)::BIGINT AS chunk, count(*) AS n_rows, min(event_id) AS first_id FROM e GROUP BY 1")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return events(spark, d).groupBy(B.chunk_of(F.col("ord"), n, 7).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_id").alias("first_id"))


@query(f"WITH {_E} SELECT floor(ord * 7 / n)::BIGINT AS chunk, count(*) AS n_rows FROM e GROUP BY 1")
def batch_equal_chunks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    return events(spark, d).groupBy(B.equal_chunk_of(F.col("ord"), n, 7).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_E} SELECT ord // 4 AS ord, max(event_id) FILTER (ord % 4 = 0) AS first_id, sum(user_id)::BIGINT AS users FROM e GROUP BY ord // 4")
def batch_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = B.fold(events(spark, d), "ord", 4, ["event_id", "user_id"])
    return folded.select("ord", F.col("event_id")[0].alias("first_id"), F.aggregate("user_id", F.lit(0).cast("long"), lambda s, x: s + x).alias("users"))


@query(f"WITH {_E} SELECT event_id, ord FROM e WHERE ord < n - n % 4")
def batch_unfold(spark: SparkSession, d: str) -> DataFrame:
    folded = B.fold(events(spark, d), "ord", 4, ["event_id"]).where(F.size("event_id") == 4)
    return B.unfold(folded, "ord", ["event_id"]).select("event_id", "ord")


@query("SELECT event_id, user_id, event_type FROM events")
def batch_union_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return B.union_columns(e.select("event_id", "user_id"), e.select("event_id", "event_type", "user_id"), "event_id")


@query("SELECT event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'click'")
def batch_concat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    parts = [e.where(F.col("event_type") == t).select("event_id", "value") for t in ("view", "click")]
    return B.concat(parts, [{"metrics": [1]}, {"metrics": [2]}])[0]


@query(f"WITH {_E} SELECT event_id, epoch::INT AS epoch, ord // 100 AS batch FROM e, (SELECT unnest(range(2)) AS epoch) WHERE ord < n - n % 100")
def batch_minibatches(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").count()
    whole = n - n % 100
    return B.minibatches(B.take_slice(events(spark, d), "ord", 0, whole), "ord", whole, 100, 2).select("event_id", "epoch", "batch")


@query("WITH h AS (SELECT event_id, row_number() OVER (ORDER BY sha1('7|' || event_id), event_id) - 1 AS rank, count(*) OVER () AS n FROM events) SELECT event_id, rank, rank // 64 AS batch FROM h WHERE rank // 64 < n // 64")
def batch_epoch_sampler(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return B.sampler_batches(e.select("event_id"), "event_id", e.count(), 64, seed=7)


_RUNS = "e AS (SELECT user_id, event_id, event_type, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT END AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)"


@query(f"WITH {_RUNS}, k AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY user_id, run) SELECT user_id, count(*) AS runs, max(n) AS longest FROM k GROUP BY user_id")
def run_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one event type per user, and the longest."""
    runs = B.islands(table(spark, d, "events"), ["event_id"], "event_type", ["user_id"]).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


@query(f"WITH {_RUNS} SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS rollout FROM r")
def rollout_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """A counter that starts again when the label changes from the row before."""
    return B.islands(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["event_id"], "event_type", ["user_id"]).select("event_id", F.col("at").cast("long").alias("rollout"))


_PAIR = "e AS (SELECT event_id, list_transform(range(user_id % 5 + 1), lambda i: i + 1) AS p, list_transform(range(event_id % 4), lambda i: 10 + i) AS c, list_transform(range(event_id % 7), lambda i: 20 + i) AS r FROM events), s AS (SELECT event_id, p, 'chosen' AS side, c AS a FROM e UNION ALL SELECT event_id, p, 'rejected', r FROM e), w AS (SELECT *, list_concat(p, a)[1:8] AS x FROM s)"


@query(f"WITH {_PAIR} SELECT event_id, side, array_to_string(list_concat(x, list_transform(range(8 - len(x)), lambda i: 0)), ',') AS tokens, len(x)::INT AS attended, list_sum(list_transform(range(8), lambda i: (i >= len(p) AND i < len(p) + len(a))::INT))::INT AS answered FROM w")
def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of one pair: the prompt with the chosen and with the rejected answer, cut and padded to eight tokens."""
    made = lambda n, first: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n), lambda i: i + first)
    e = table(spark, d, "events").select("event_id", made(F.col("user_id") % 5 + 1, 1).alias("p"), made(F.col("event_id") % 4, 10).alias("c"), made(F.col("event_id") % 7, 20).alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    rows = Z.pair_rows(e, "p", "c", "r", 8, keep=["event_id"])
    return rows.select("event_id", "side", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), total("attention").alias("attended"), total("answer_mask").alias("answered"))
