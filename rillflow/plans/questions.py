"""Questions of hops: rendering, sums and lints; admission of captioned videos; draws of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import questions as H
from rillflow.operators import selecting as S
from rillflow.plans.registry import query, table
from rillflow.plans.scorers import expected, met

#: Seconds of a video from which it is admitted, share of its segments that must have a caption.
LEAST_SECONDS, LEAST_CAPTIONED = 180.0, 0.5


def _hops() -> Column:
    """Two hops of an event: one with a mapping and a scene, one with a description only as its condition."""
    value, user = F.col("event_id"), F.col("user_id")
    first = F.struct(F.concat(F.lit("If the "), F.col("event_type"), F.lit(" is red then "), (value % 5).cast("string"), F.lit(" else "), (value % 7).cast("string")).alias("mapping"), F.lit("no").alias("description"), F.lit("the kitchen..").alias("scene_ref"), (value % 5).cast("string").alias("value"))
    second = F.struct(F.concat(F.lit("count: then "), (user % 9).cast("string"), F.lit(" else -4")).alias("mapping"), F.lit("a cat waits. ").alias("description"), F.lit("").alias("scene_ref"), F.lit(" -4").alias("value"))
    return F.array(first, second)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'prose ' || event_id ELSE 'In the kitchen, if the ' || event_type || ' is red, let A be ' || event_id % 5 || '; otherwise let A be ' || event_id % 7 || '.' || chr(10) ||
 CASE WHEN event_id % 2 = 0 THEN 'Using check A, in the video' ELSE 'In the video' END || ', if a cat waits, let B be ' || user_id % 9 || '; otherwise let B be -4.' || chr(10) || 'Report A + B as a single integer.' END AS question, event_id % 5 - 4 AS answer, 'H1+H2' AS sums FROM events""")
def rendered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions in prose where there is some, else rendered from their hops, with the answer that the hops give."""
    e = table(spark, d, "events")
    prose = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" prose "), F.col("event_id").cast("string"))).otherwise("  ")
    routes = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit(2), F.lit(1))).otherwise(F.create_map().cast("map<int,int>"))
    df = e.select("event_id", _hops().alias("hops"), prose.alias("query"), routes.alias("routes"))
    return df.select("event_id", H.question_text(F.col("query"), F.col("hops"), F.col("routes")).alias("question"), H.answer_sum(F.transform("hops", lambda h: h["value"])).alias("answer"), H.sum_expression(F.size("hops")).alias("sums"))


LINTED = [
    ("If so, see check two.", 1, "check"), ("If so, see check two.", 2, ""), ("The second check and check 3", 3, ""), ("The second check and check 3", 2, "check"), ("check 0", 4, "check"), ("Let A be 1; otherwise let B be 2", 2, ""), ("Let A be 1; otherwise let A be 2", 2, "letters"),
    ("let A be 3, let C be 4", 1, "letters"), ("In hop 2 wait", 2, "hop"), ("Hop  12: check seven. let H be 9", 2, "check,letters,hop"), ("", 3, ""), (None, 3, ""), ("hopper 2 and checked two", 1, ""), ("seventh check", 6, "check"),
]


@query(expected(LINTED, {"faults": "VARCHAR"}))
def question_lints(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the prose of questions."""
    return met(spark, d, LINTED, "said string, n int").select("event_id", F.array_join(H.lints(F.col("said"), F.col("n")), ",").alias("faults"))


CONDITIONS = [
    ("If the door is open then 3 else 5", "d", "the door is open"), ("if a\nb... then -1 else 2 ", "d", "a\nb"), ("IF X THEN 1 ELSE 2", "d", "X"), ("maybe then 1 else 2", "the lamp is on.", "the lamp is on"), (None, " d. ", "d"), ("if x then 1", None, ""), ("if x then y then 1 else 2", "d", "x then y"),
]


@query(expected(CONDITIONS, {"condition": "VARCHAR"}))
def hop_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions out of mappings, or descriptions in their place."""
    return met(spark, d, CONDITIONS, "mapping string, description string").select("event_id", H.condition_text(F.col("mapping"), F.col("description")).alias("condition"))


@query(f"""WITH c AS (SELECT video_id, epoch_ms(captioned_at) AS at_ms, duration_s, len(timeline) AS n, len(list_filter(timeline, lambda s: trim(coalesce(s.text, '')) <> '')) AS filled FROM caption_docs)
 SELECT video_id, at_ms, CASE WHEN duration_s IS NULL THEN 'no duration' WHEN duration_s < {LEAST_SECONDS} THEN printf('%.1f', round(duration_s + 1e-9, 1)) || ' s is under 180 s' WHEN coalesce(n, 0) = 0 OR filled / n < {LEAST_CAPTIONED} THEN 'captions' END AS reason FROM c""")
def admitted_videos(spark: SparkSession, d: str) -> DataFrame:
    """Why a captioned video isn't admitted: too short, or too few captions; null for those that are."""
    n = F.size(F.coalesce("timeline", F.array().cast("array<struct<seg:int,start:double,end:double,text:string>>")))
    filled = F.size(F.filter("timeline", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    seconds = F.col("duration_s")
    short = F.concat(F.format_string("%.1f", F.round(seconds + 1e-9, 1)), F.lit(f" s is under {LEAST_SECONDS:.0f} s"))
    reason = F.when(seconds.isNull(), "no duration").when(seconds < LEAST_SECONDS, short).when((n == 0) | (filled / n < LEAST_CAPTIONED), "captions")
    return table(spark, d, "caption_docs").select("video_id", F.unix_millis("captioned_at").alias("at_ms"), reason.alias("reason"))


@query("WITH k AS (SELECT DISTINCT user_id, ('0x' || sha1('5|' || user_id)[1:13])::BIGINT / pow(16, 13) AS u, row_number() OVER (ORDER BY sha1('6|' || user_id), user_id) AS r FROM (SELECT DISTINCT user_id FROM events)) SELECT e.event_id, u < 0.3 AS explored, r <= 20 AS traced FROM events e JOIN k USING (user_id)")
def explored_and_traced(spark: SparkSession, d: str) -> DataFrame:
    """Prompts drawn for exploration, each with the same chance, and a fixed number of prompts that are traced, with all their rows."""
    e = table(spark, d, "events").select("event_id", "user_id").withColumn("explored", S.drawn(F.col("user_id"), 0.3, 5))
    return S.traced(e, "user_id", 20, 6).select("event_id", "explored", "traced")


@query("""WITH s AS (SELECT max(value) AS hi, min(value) AS lo FROM events) SELECT event_id, round(pow(abs(value), 2), 6) AS pow, (value = hi OR value = lo)::INT::DOUBLE AS max_min, CASE WHEN value = hi THEN 0.4 ELSE 0.1 END::DOUBLE AS max_random FROM events, s""")
def preference_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights by which a batch is drawn again, under each rule."""
    out = table(spark, d, "events").select("event_id", "value")
    for how in ("pow", "max_min", "max_random"):
        out = S.preference_weight(out, "value", how, how)
    return out.select("event_id", F.round("pow", 6).alias("pow"), "max_min", "max_random")
