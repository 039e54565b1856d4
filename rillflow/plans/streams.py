"""Packing and queue queries over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.operators import packing as P
from rillflow.operators.batches import with_ordinal
from rillflow.plans.registry import query, table
from rillflow.streaming import queues as Q


def _batches(spark: SparkSession, d: str, size: int = 64) -> DataFrame:
    e = with_ordinal(table(spark, d, "events").select("event_id", "user_id", "value"), ["event_id"])
    return e.withColumn("batch", F.floor(F.col("ord") / size))


@query()
def packed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Every batch of 64 split over four workers by differencing, with each row's new place."""
    return P.balance(_batches(spark, d), "batch", "ord", "value", 4).select("batch", "event_id", "part", "at")


@query()
def packed_greedily(spark: SparkSession, d: str) -> DataFrame:
    return P.balance(_batches(spark, d), "batch", "ord", "value", 4, "greedy").select("batch", "event_id", "part", "at")


@query()
def packing_report(spark: SparkSession, d: str) -> DataFrame:
    return P.balance_report(_batches(spark, d), "batch", "ord", "value", 4)


_ORD = "o AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS ord FROM events)"


@query(f"WITH {_ORD} SELECT ord // 64 AS batch, (ord % 64)::INT AS pos, event_id FROM o")
def packing_restored(spark: SparkSession, d: str) -> DataFrame:
    """Balanced batches put back into their first order by the inverse permutation."""
    placed = P.balance(_batches(spark, d), "batch", "ord", "value", 4).select("batch", "at", "event_id", F.pmod("ord", F.lit(64)).alias("place"))
    return P.restored(placed, "batch", "place").select("batch", "pos", "event_id")


def _checked(placed: DataFrame) -> DataFrame:
    """Per batch: rows, distinct places, parts, all of the weight, and whether parts differ by no more than the heaviest row."""
    parts = placed.groupBy("batch", "part").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("at").alias("a"), F.max("at").alias("z"))
    whole = parts.groupBy("batch").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("parts"), F.round(F.sum("s"), 4).alias("weight"), (F.max("s") - F.min("s") <= F.max("top") + 1e-9).alias("even"), F.sum((F.col("z") - F.col("a") + 1 == F.col("n")).cast("int")).alias("unbroken"))
    places = placed.groupBy("batch").agg(F.countDistinct("at").alias("places"), F.max("at").alias("last_place"))
    return whole.join(places, "batch")


_CHECKED = f"WITH {_ORD} SELECT ord // 64 AS batch, count(*) AS n_rows, least(count(*), 4) AS parts, round(sum(value), 4) AS weight, true AS even, least(count(*), 4) AS unbroken, count(*) AS places, count(*) - 1 AS last_place FROM o GROUP BY 1"


@query(_CHECKED)
def packed_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of batches balanced by differencing."""
    return _checked(P.balance(_batches(spark, d), "batch", "ord", "value", 4))


@query(_CHECKED)
def greedy_checks(spark: SparkSession, d: str) -> DataFrame:
    return _checked(P.balance(_batches(spark, d), "batch", "ord", "value", 4, "greedy"))


@query(f"""WITH {_ORD}, k AS (SELECT ord // 64 AS batch, count(*) AS n, sum(user_id % 50 + 1) AS tokens FROM o GROUP BY 1)
 SELECT batch, n AS n_rows, tokens::BIGINT AS tokens, least(n, ceil(ceil(tokens / 400.0) / 2) * 2)::BIGINT AS micros, n AS places FROM k""")
def micro_batch_checks(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of about 400 tokens, an even number of them, that hold every row once."""
    lengths = _batches(spark, d).withColumn("length", F.col("user_id") % 50 + 1)
    m = P.micro_batched(lengths, "batch", "ord", "length", 400, multiple=2)
    return m.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("length").alias("tokens"), F.countDistinct("micro").alias("micros"), F.countDistinct("micro", "within").alias("places"))


@query(f"""WITH {_ORD}, r AS (SELECT *, CASE WHEN lag(user_id % 7) OVER (PARTITION BY ord // 64 ORDER BY ord) IS DISTINCT FROM user_id % 7 THEN 1 ELSE 0 END AS new FROM o)
 SELECT ord // 64 AS batch, count(*) AS n_rows, sum(new)::BIGINT AS runs, 0::BIGINT AS torn, CASE WHEN sum(new) % 4 = 0 THEN sum(new) // 4 ELSE -1 END::BIGINT AS groups_each FROM r GROUP BY 1""")
def grouped_part_checks(spark: SparkSession, d: str) -> DataFrame:
    """Parts in which runs of one uid stay whole, and each part has as many runs where that can be."""
    rows = _batches(spark, d).withColumn("uid", F.col("user_id") % 7)
    g = P.grouped(rows, "batch", "ord", "uid", "value", 4)
    order = Window.partitionBy("batch").orderBy("ord")  # a batch has 64 rows
    new = (~F.lag("uid").over(order).eqNullSafe(F.col("uid"))).cast("int")
    torn = (F.lag("uid").over(order).eqNullSafe(F.col("uid")) & ~F.lag("part").over(order).eqNullSafe(F.col("part"))).cast("int")
    per = g.withColumns({"new": new, "torn": torn}).groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("new").alias("runs"), F.sum("torn").alias("torn"))
    out = per.groupBy("batch").agg(F.sum("n").alias("n_rows"), F.sum("runs").alias("runs"), F.sum("torn").alias("torn"), F.max("runs").alias("m"))
    return out.select("batch", "n_rows", "runs", "torn", F.when(F.col("runs") % 4 == 0, F.col("m")).otherwise(-1).alias("groups_each"))


def queue_log(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Every fourth event takes from its user's queue, the others put."""
    return df.select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "get").otherwise("put").alias("op"), F.col("event_id").alias("item"))


_FIFO = """l AS (SELECT user_id AS q, event_id AS seq, CASE WHEN event_type = 'click' THEN 'get' ELSE 'put' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 r(q, n, seq, op, item, dropped_item, items, produced, consumed, dropped) AS (SELECT DISTINCT q, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, 0::BIGINT FROM l UNION ALL
  SELECT l.q, l.n, l.seq, l.op, CASE l.op WHEN 'put' THEN l.seq ELSE r.items[1] END, CASE WHEN l.op = 'put' AND len(r.items) >= 8 THEN r.items[1] END,
   CASE WHEN l.op = 'get' THEN r.items[2:] WHEN len(r.items) >= 8 THEN list_append(r.items[2:], l.seq) ELSE list_append(r.items, l.seq) END,
   r.produced + (l.op = 'put')::INT, r.consumed + (l.op = 'get' AND len(r.items) > 0)::INT, r.dropped + (l.op = 'put' AND len(r.items) >= 8)::INT FROM r JOIN l ON l.q = r.q AND l.n = r.n + 1)"""
_REPLAYED = f"WITH RECURSIVE {_FIFO} SELECT q AS queue, seq, op, coalesce(item, -1) AS item, coalesce(dropped_item, -1) AS dropped_item, len(items)::BIGINT AS size, produced, consumed, dropped FROM r WHERE n > 0"


@query(_REPLAYED)
def queue_replay(spark: SparkSession, d: str) -> DataFrame:
    return Q.queue_replay(queue_log(table(spark, d, "events"), spark), 8).na.fill(-1, ["item", "dropped_item"])


@query("SELECT user_id AS queue, count(*) AS produced, greatest(count(*) - 8, 0) AS dropped, least(count(*), 8) AS size FROM events WHERE event_type <> 'click' GROUP BY user_id")
def queue_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of queues that are only put into."""
    log = queue_log(table(spark, d, "events"), spark).where("op = 'put'")
    return Q.queue_replay(log, 8).groupBy("queue").agg(F.max("produced").alias("produced"), F.max("dropped").alias("dropped"), F.max("size").alias("size"))


@query(_REPLAYED)
def queue_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same log read as a stream, its answers written to files and read back."""
    stream = Q.table_stream(spark, d, "events")
    path = Q.scratch(spark, "queue")
    Q.run_to_files(Q.queue_stream(queue_log(stream, spark), 8), path)
    return spark.read.parquet(f"{path}/out").na.fill(-1, ["item", "dropped_item"])


@query("WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events), w AS (SELECT *, seq // 8 AS window_no, count(*) OVER (PARTITION BY user_id, seq // 8) AS n FROM o) SELECT event_id, user_id, window_no FROM w WHERE n = 8")
def count_windows(spark: SparkSession, d: str) -> DataFrame:
    """Groups of exactly eight events of a user."""
    o = with_ordinal(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], "seq", ["user_id"])
    return Q.count_windows(o, "user_id", "seq", 8).select("event_id", "user_id", "window_no")


@query("WITH s AS (SELECT user_id, event_id // 1000 AS step, min(event_id // 250) AS lo, max(event_id // 250) AS hi FROM events GROUP BY 1, 2) SELECT count(*) AS samples, round(avg(hi - lo), 6) AS mean_span, max(hi - lo) AS max_span, round(avg((hi > lo)::INT), 6) AS partial_share, count(DISTINCT hi) AS versions FROM s")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Spans of parameter versions in samples of a user's events."""
    e = table(spark, d, "events").withColumn("v", Q.version_of(F.col("event_id"), 250))
    s = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("step")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = Q.staleness_stats(s, "lo", "hi")
    return out.withColumns({"mean_span": F.round("mean_span", 6), "partial_share": F.round("partial_share", 6)})


@query("WITH l AS (SELECT user_id % 20 AS part, user_id AS key, arg_max(CASE event_type WHEN 'error' THEN 'running' WHEN 'purchase' THEN 'finished' ELSE event_type END, event_id) AS s FROM events GROUP BY 1, 2) SELECT part, count(*) AS keys, count(*) FILTER (s = 'finished') AS finished FROM l GROUP BY part HAVING NOT bool_or(s = 'running')")
def replay_ready(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of a replay buffer that wait for nobody."""
    state = F.when(F.col("event_type") == "error", "running").when(F.col("event_type") == "purchase", "finished").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("part"), F.col("user_id").alias("key"), "event_id", state.alias("state"))
    return Q.ready_partitions(e, "part", "key", "event_id", "state")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def popped_once(spark: SparkSession, d: str) -> DataFrame:
    return Q.pop_once(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream in complete mode: batches are merged by a last-written-wins read of its files."""
    stream = Q.table_stream(spark, d, "events")
    path = Q.scratch(spark, "hourly")
    counts = Q.windowed_counts(stream, "ts", "event_type", "1 hour")
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/latest")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/latest").withColumn("total", F.round("total", 4))


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, event_id::DOUBLE AS came, value AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 r(user_id, n, event_id, level, clock) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 100.0::DOUBLE, came FROM l WHERE n = 1 UNION ALL
  SELECT l.user_id, l.n, l.event_id, greatest(least(100.0, r.level + (greatest(r.clock, l.came) - r.clock) * 0.5), least(l.cost, 100.0)) - l.cost,
   greatest(r.clock, l.came) + greatest(0, least(l.cost, 100.0) - least(100.0, r.level + (greatest(r.clock, l.came) - r.clock) * 0.5)) / 0.5 FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1)
 SELECT user_id, event_id, round(clock, 4) AS start FROM r WHERE n > 0""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """When each user's requests may start under a token bucket."""
    log = table(spark, d, "events").withColumn("at", F.col("event_id").cast("double"))
    return Q.token_bucket(log, "user_id", "event_id", "at", "value", 0.5, 100.0).withColumn("start", F.round("start", 4))


@query("""WITH w AS (SELECT user_id, value / 100 AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id AS uid, count(*) AS n, round(var_pop(score), 6) AS variance, var_pop(score) <= 0.05 AND avg(score) <= 0.6 AS explore
 FROM w WHERE n <= 4 GROUP BY user_id HAVING count(*) = 4""")
def second_waves_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Whether a prompt's second wave explores, decided on a stream as soon as its four anchors have scores."""
    stream = Q.table_stream(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("seq"), (F.col("value") / 100).alias("score"))
    path = Q.scratch(spark, "waves")
    Q.run_to_files(Q.second_waves(stream, 4, 0.05, 0.6), path)
    return spark.read.parquet(f"{path}/out").select("uid", "n", F.round("variance", 6).alias("variance"), "explore")


@query(f"WITH {_ORD}, n AS (SELECT count(*) AS n FROM events) SELECT ord + e * n AS ordinal, e AS epoch, event_id FROM o, n, (SELECT unnest(range(3)) AS e) WHERE ord + e * n >= 777")
def feed_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Three epochs of a feed whose ordinal keeps growing, taken up again at an ordinal."""
    rows = with_ordinal(table(spark, d, "events").select("event_id"), ["event_id"])
    return Q.feed(rows, "ord", 3, start=777).select("ordinal", "epoch", "event_id")


_PAUSE = "o AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'sync' WHEN 'click' THEN 'finish' ELSE 'start' END AS op FROM events), v AS (SELECT *, sum((op = 'sync')::INT) OVER w AS version, sum(CASE op WHEN 'start' THEN 1 WHEN 'finish' THEN -1 ELSE 0 END) OVER w AS flying FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


@query(f"WITH {_PAUSE}, s AS (SELECT v.*, coalesce((SELECT max(flying) FROM v k WHERE k.user_id = v.user_id AND k.version = v.version AND k.op = 'sync'), 0) + sum((op = 'start')::INT) OVER (PARTITION BY user_id, version ORDER BY event_id) AS stale FROM v) SELECT user_id, event_id, version::BIGINT AS version, stale::BIGINT AS stale, stale >= 5 AS paused FROM s")
def paused_producer(spark: SparkSession, d: str) -> DataFrame:
    """Where a producer pauses because too many samples would be stale."""
    op = F.when(F.col("event_type") == "purchase", "sync").when(F.col("event_type") == "click", "finish").otherwise("start")
    log = table(spark, d, "events").select("user_id", "event_id", op.alias("op"))
    return Q.paused_steps(log, "user_id", "event_id", 5).select("user_id", "event_id", "version", "stale", "paused")
