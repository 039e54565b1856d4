"""Building and auditing the corpus: probes, live questions, joins, counters, audits and the shot splitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import numeric as N
from rillflow.functions import text as X
from rillflow.operators import audit as U
from rillflow.operators import joins as J
from rillflow.operators.segments import split_and_merge
from rillflow.plans.registry import query, table
from rillflow.plans.selecting import _C, corpus

_P = "p AS (SELECT lower(trim(question_id)) AS qid, sum(n_samples)::BIGINT AS n, sum(n_correct)::BIGINT AS c FROM probe_runs WHERE coalesce(error, '') = '' AND n_samples IS NOT NULL AND n_correct IS NOT NULL AND question_id IS NOT NULL GROUP BY 1)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Probes that ran: ``qid, n, c``."""
    ok = (F.coalesce("error", F.lit("")) == "") & F.col("n_samples").isNotNull() & F.col("n_correct").isNotNull() & F.col("question_id").isNotNull()
    return table(spark, d, "probe_runs").where(ok).select(F.lower(F.trim("question_id")).alias("qid"), F.col("n_samples").cast("long").alias("n"), F.col("n_correct").cast("long").alias("c"))


@query(f"WITH {_P} SELECT * FROM p")
def pooled_probes(spark: SparkSession, d: str) -> DataFrame:
    return probes(spark, d).groupBy("qid").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


@query(f"""WITH {_P}, r AS (SELECT row_id, lower(trim(extra_info.question_id)) AS qid, extra_info.solve_rate AS rate, extra_info.difficulty_band AS band FROM corpus_rows)
 SELECT row_id, round(CASE WHEN n > 0 THEN c::DOUBLE / n ELSE rate END, 6) AS rate, CASE WHEN n > 0 THEN CASE WHEN c <= 0 THEN 'dead_hard' WHEN c >= n THEN 'dead_easy' WHEN c::DOUBLE / n < 0.25 THEN 'hard' WHEN c::DOUBLE / n < 0.75 THEN 'medium' ELSE 'easy' END ELSE band END AS band FROM r LEFT JOIN p USING (qid)""")
def stamped_rates(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows with the rate and band of their probes."""
    rows = table(spark, d, "corpus_rows").select("row_id", F.lower(F.trim("extra_info.question_id")).alias("qid"), F.col("extra_info.solve_rate").alias("rate"), F.col("extra_info.difficulty_band").alias("band"))
    return J.stamp(rows, "qid", probes(spark, d), "c", "n", "rate", N.band5).select("row_id", F.round("rate", 6).alias("rate"), "band")


@query(f"""WITH {_P}, g AS (SELECT qid, n, c, CASE WHEN n < 16 THEN 'few' WHEN c <= 0 THEN 'never' WHEN c >= n THEN 'always' WHEN c::DOUBLE / n > 0.75 THEN 'easy' ELSE 'live' END AS state FROM p) SELECT state, count(*) AS n_questions FROM g GROUP BY state""")
def live_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the first reason that keeps them from being live."""
    pooled = probes(spark, d).groupBy("qid").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    n, c = F.col("n"), F.col("c")
    judged = J.gated(pooled, {"few": n < 16, "never": c <= 0, "always": c >= n, "easy": c / n > 0.75})
    return judged.groupBy(F.coalesce("reason", F.lit("live")).alias("state")).agg(F.count(F.lit(1)).alias("n_questions"))


@query(f"WITH {_C} SELECT source, count(*) AS n_rows, round(avg(rate), 6) AS mean_rate, round(avg((rate > 0 AND rate < 1)::INT), 6) AS live_share FROM c GROUP BY source")
def solve_rate_stats(spark: SparkSession, d: str) -> DataFrame:
    live = ((F.col("rate") > 0) & (F.col("rate") < 1)).cast("int")
    return corpus(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.avg(live), 6).alias("live_share"))


@query(f"WITH {_C} SELECT round(rate, 4) AS rate, count(*) AS n FROM c WHERE rate IS NOT NULL GROUP BY 1 ORDER BY n DESC, rate LIMIT 12")
def common_rates(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).where("rate is not null").groupBy(F.round("rate", 4).alias("rate")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rate").limit(12)


@query("""WITH r AS (SELECT lower(trim(data_source)) AS source, extra_info.num_hops AS hops, nullif(lower(trim(extra_info.difficulty_band)), '') AS band FROM corpus_rows)
 SELECT 'source' AS facet, source AS value, count(*) AS n FROM r GROUP BY source UNION ALL SELECT 'hops', hops::VARCHAR, count(*) FROM r GROUP BY hops UNION ALL SELECT 'band', band, count(*) FROM r GROUP BY band""")
def frequency_tables(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source, hops and band in one pass over the rows."""
    rows = table(spark, d, "corpus_rows").select(F.lower(F.trim("data_source")).alias("source"), F.col("extra_info.num_hops").cast("string").alias("hops"), F.nullif(F.lower(F.trim("extra_info.difficulty_band")), F.lit("")).alias("band"))
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source", "hops", "band")])
    return rows.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT count(*) AS tasks, count(*) FILTER (coalesce(error, '') <> '') AS failed, count(*) FILTER (coalesce(error, '') = '' AND n_samples IS NULL) AS skipped, count(*) FILTER (coalesce(error, '') = '' AND n_samples IS NOT NULL) AS ok FROM probe_runs) SELECT *, ok + skipped + failed = tasks AS closed FROM t""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """Probes that failed, were skipped or ran; together they are all."""
    bad, none = F.coalesce("error", F.lit("")) != "", F.col("n_samples").isNull()
    t = table(spark, d, "probe_runs").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(bad).alias("failed"), F.count_if(~bad & none).alias("skipped"), F.count_if(~bad & ~none).alias("ok"))
    return t.withColumn("closed", F.col("ok") + F.col("skipped") + F.col("failed") == F.col("tasks"))


_KEY = "substr(sha1(trim(regexp_replace(text, '[\\s\\x{A0}\\x{2028}\\x{2029}\\x{85}\\x{3000}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}]+', ' ', 'g'))), 1, 16)"


@query(f"""WITH a AS (SELECT {_KEY} AS key, min(doc_id) AS left_id FROM documents WHERE text IS NOT NULL AND source <> 'shot_captions' GROUP BY 1 HAVING count(*) = 1), b AS (SELECT {_KEY} AS key, min(doc_id) AS right_id FROM documents WHERE text IS NOT NULL AND lang <> 'en' GROUP BY 1 HAVING count(*) = 1) SELECT * FROM a JOIN b USING (key)""")
def unique_text_join(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two selections that each have just once."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("key", X.question_key(F.col("text")))
    a = docs.where("source <> 'shot_captions'").select("key", F.col("doc_id").alias("left_id"))
    b = docs.where("lang <> 'en'").select("key", F.col("doc_id").alias("right_id"))
    return J.unique_join(a, b, "key")


@query("""WITH f AS (SELECT DISTINCT path FROM video_files WHERE path LIKE '%/videos/%'), v AS (SELECT row_id, unnest(videos).video AS video, generate_subscripts(videos, 1) AS i FROM corpus_rows), m AS (SELECT row_id, i, video, regexp_replace(video, '^file:///pool/proxy_([a-z]+)_140f50k/(.*)\\.mp4$', '/pool/\\1/videos/\\2.webm') AS t FROM v)
 SELECT row_id, string_agg(CASE WHEN t IN (SELECT path FROM f) THEN t ELSE video END, '|' ORDER BY i) AS videos FROM m GROUP BY row_id""")
def repointed_videos(spark: SparkSession, d: str) -> DataFrame:
    """Paths inside the videos array moved to the raw file where there is one."""
    rows = table(spark, d, "corpus_rows").select("row_id", "videos").where(F.size("videos") > 0)
    files = table(spark, d, "video_files").where(F.col("path").contains("/videos/")).select(F.col("path").alias("target")).distinct()
    moved = files.select(F.regexp_replace("target", r"^/pool/([a-z]+)/videos/(.*)\.webm$", r"file:///pool/proxy_$1_140f50k/$2.mp4").alias("path"), "target")
    return J.repoint(rows, "row_id", "videos", "video", moved).select("row_id", F.array_join(F.transform("videos", lambda v: v["video"]), "|").alias("videos"))


@query("SELECT DISTINCT extra_info.video_id AS video FROM corpus_rows WHERE split = 'train' AND extra_info.video_id IN (SELECT extra_info.video_id FROM corpus_rows WHERE split IN ('val', 'validation', 'test'))")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus_rows").select(U.split_name(F.col("split")).alias("split"), F.col("extra_info.video_id").alias("video"))
    return J.leaks(rows.where("split = 'train'"), rows.where("split in ('val', 'test')"), "video")


@query("WITH a AS (SELECT DISTINCT extra_info.video_id AS video FROM corpus_rows), b AS (SELECT DISTINCT video_id AS video FROM caption_docs) SELECT video, 'left' AS side FROM a WHERE video IS NOT NULL AND video NOT IN (SELECT video FROM b WHERE video IS NOT NULL) UNION ALL SELECT video, 'right' FROM b WHERE video IS NOT NULL AND video NOT IN (SELECT video FROM a WHERE video IS NOT NULL)")
def missing_captions(spark: SparkSession, d: str) -> DataFrame:
    """Videos with rows but no captions, and the other way round."""
    a = table(spark, d, "corpus_rows").select(F.col("extra_info.video_id").alias("video")).where("video is not null")
    b = table(spark, d, "caption_docs").select(F.col("video_id").alias("video")).where("video is not null")
    return J.differing_keys(a, b, "video")


@query("SELECT row_id FROM corpus_rows WHERE extra_info.video_id IS NULL OR extra_info.video_id NOT IN (SELECT video_id FROM video_files WHERE n_bytes = 0 AND video_id IS NOT NULL)")
def without_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose video isn't on the list of failed copies."""
    failed = table(spark, d, "video_files").where("n_bytes = 0").select("video_id").distinct()
    rows = table(spark, d, "corpus_rows").select("row_id", F.col("extra_info.video_id").alias("video_id"))
    return rows.join(failed, "video_id", "left_anti").select("row_id")


@query("SELECT video_id, path, scanned FROM (SELECT video_id, path, epoch_ms(scanned_at) AS scanned, row_number() OVER (PARTITION BY video_id ORDER BY path LIKE '%/videos/%', path, scanned_at) AS k FROM video_files WHERE video_id IS NOT NULL) WHERE k = 1")
def first_root_wins(spark: SparkSession, d: str) -> DataFrame:
    """One file per video: the proxy's folder before the raw one."""
    f = table(spark, d, "video_files").where("video_id is not null")
    rank = F.struct(F.col("path").contains("/videos/").alias("raw"), "path", "scanned_at")
    return f.groupBy("video_id").agg(F.min(rank).alias("r")).select("video_id", "r.path", F.unix_millis("r.scanned_at").alias("scanned"))


@query("SELECT target, count(*) AS n FROM (SELECT DISTINCT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')) AS target FROM video_files WHERE path IS NOT NULL) GROUP BY target HAVING count(*) > 1")
def path_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Different files that would be written to one place, a folder of their name."""
    files = table(spark, d, "video_files").where("path is not null").select("path", F.lower(X.stem(F.col("path"))).alias("target")).distinct()
    return files.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH s AS (SELECT video_id, user_session, max_by(value, event_id) AS last_value FROM (SELECT user_id AS video_id, event_type AS user_session, event_id, value FROM events) GROUP BY ALL) SELECT e.event_id, round(s.last_value, 6) AS last_value FROM events e JOIN s ON s.video_id = e.user_id AND s.user_session = e.event_type""")
def session_last_value(spark: SparkSession, d: str) -> DataFrame:
    """The value of a session's last row on all its rows."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return J.last_of_session(e, ["user_id", "event_type"], "event_id", "value", "last_value").select("event_id", F.round("last_value", 6).alias("last_value"))


@query("SELECT event_id, user_id::VARCHAR AS who, NULL::DOUBLE AS value FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL::VARCHAR, round(value, 6) FROM events WHERE event_type = 'error'")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return J.merged(e.where("event_type = 'view'").select("event_id", F.col("user_id").cast("string").alias("who")), e.where("event_type = 'error'").select("event_id", F.round("value", 6).alias("value")))


# audits

_AUDIT = """a AS (SELECT row_id, list_filter([
  CASE WHEN len(list_filter(prompt, lambda m: m.role = 'user')) <> 1 THEN 'user_turns' END,
  CASE WHEN len(list_filter(prompt, lambda m: m.role = 'system')) = 0 THEN 'no_system' END,
  CASE WHEN (length(array_to_string(list_transform(prompt, lambda m: m.content), '')) - length(replace(array_to_string(list_transform(prompt, lambda m: m.content), ''), '<video>', ''))) / 7 <> len(videos) THEN 'marks' END,
  CASE WHEN coalesce(trim(reward_model.ground_truth), '') = '' THEN 'no_gold' END,
  CASE WHEN reward_model.ground_truth IS DISTINCT FROM extra_info.answer THEN 'answer' END,
  CASE WHEN coalesce(extra_info.reward_type, '') NOT IN ('numeric', 'multiple_choice') THEN 'reward_type' END], lambda x: x IS NOT NULL) AS faults FROM corpus_rows)"""


@query(f"WITH {_AUDIT} SELECT fault, count(*) AS n_rows FROM (SELECT unnest(faults) AS fault FROM a) GROUP BY fault")
def row_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults of all rows, counted."""
    return U.fault_counts(U.audit_rows(table(spark, d, "corpus_rows")))


@query(f"WITH {_AUDIT} SELECT row_id, coalesce(faults[1], 'ok') AS first_fault FROM a")
def row_audit_first(spark: SparkSession, d: str) -> DataFrame:
    """The first fault of every row, in the audits' order."""
    return U.audit_rows(table(spark, d, "corpus_rows")).select("row_id", F.coalesce(F.try_element_at("faults", F.lit(1)), F.lit("ok")).alias("first_fault"))


@query("SELECT * FROM (VALUES ('built_at', 'extra'), ('landed_at', 'extra'), ('row_id', 'extra'), ('split', 'extra')) t(field, fault)")
def schema_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fields that the corpus schema lacks, has too many of, or types otherwise."""
    return U.schema_faults(table(spark, d, "corpus_rows"), U.CORPUS_SCHEMA)


@query("""WITH k AS (SELECT extra_info.video_id AS v, split, reward_model.ground_truth AS gt, extra_info.answer AS a, extra_info.reward_type AS t, videos[1].max_frames AS f FROM corpus_rows)
 SELECT (SELECT count(DISTINCT v) FROM k WHERE split = 'train' AND v IN (SELECT v FROM k WHERE split IN ('val', 'validation'))) AS shared_videos, count(*) FILTER (t = 'numeric' AND NOT regexp_full_match(coalesce(a, ''), '-?[0-9]+')) AS not_whole, count(*) FILTER (a IS DISTINCT FROM gt) AS answer_differs, count(*) FILTER (t = 'numeric' AND f <> 140) AS frames,
 (SELECT max(length(array_to_string(list_transform(prompt, lambda m: m.content), ''))) FROM corpus_rows)::BIGINT AS longest_prompt FROM k""")
def release_gates(spark: SparkSession, d: str) -> DataFrame:
    """What must be zero before a release, and the longest prompt."""
    return U.release_gates(table(spark, d, "corpus_rows"))


@query("SELECT count(*) AS n_rows FROM orders")
def written_back(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a Parquet file has after it was written with a declared schema and read again."""
    from rillflow.sources.files import write_checked

    return write_checked(table(spark, d, "orders"), "o_orderkey bigint, o_totalprice double")


@query("SELECT row_id, split FROM (SELECT row_id, 'a' AS split FROM corpus_rows WHERE split = 'train') UNION ALL SELECT row_id, 'b' FROM corpus_rows WHERE split IN ('val', 'validation')")
def ordered_phases(spark: SparkSession, d: str) -> DataFrame:
    """Two phases one after the other; no source may be in both, no row twice."""
    rows = table(spark, d, "corpus_rows").withColumn("split", U.split_name(F.col("split")))
    return U.phases({"a": rows.where("split = 'train'").select("row_id"), "b": rows.where("split = 'val'").select("row_id")}, "row_id").select("row_id", F.col("phase").alias("split"))


# shots


@query("""WITH s AS (SELECT video_id, epoch_ms(captioned_at) AS at_ms, unnest(timeline) AS s, generate_subscripts(timeline, 1) AS i FROM caption_docs), k AS (SELECT video_id, at_ms, i, s.start AS a, s."end" AS b FROM s WHERE s."end" > s.start)
 SELECT video_id, at_ms, sum(CASE WHEN b - a > 4 THEN floor((b - a) / 4) + 1 ELSE 1 END)::BIGINT AS pieces FROM k GROUP BY video_id, at_ms""")
def shot_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Segments longer than four seconds in equal parts, counted before short ones are merged."""
    docs = table(spark, d, "caption_docs").select("video_id", F.unix_millis("captioned_at").alias("at_ms"), F.filter(F.transform("timeline", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), lambda s: s["end"] > s["start"]).alias("shots"))
    from rillflow.operators.segments import split_long

    return docs.where(F.size("shots") > 0).select("video_id", "at_ms", F.size(split_long(F.col("shots"), 4.0)).cast("long").alias("pieces"))


#: Two decimals by the exact value of a double, a tie to the even one.
_LEFT = "({x} * 100 - floor({x} * 100)) + ((({x} * 134217729 - ({x} * 134217729 - {x})) * 100 - {x} * 100) + ({x} - ({x} * 134217729 - ({x} * 134217729 - {x}))) * 100)"
_EXACT = "(floor({x} * 100) + CASE WHEN " + _LEFT + " > 0.5 OR " + _LEFT + " = 0.5 AND floor({x} * 100) % 2 = 1 THEN 1 ELSE 0 END) / 100"


@query(f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, video_id, epoch_ms(captioned_at) AS at_ms, timeline FROM caption_docs), k AS (SELECT id, generate_subscripts(timeline, 1) AS i, unnest(timeline) AS s FROM d),
 n AS (SELECT id, i, s.start AS a, s."end" AS b, CASE WHEN s."end" - s.start > 4 THEN floor((s."end" - s.start) / 4) + 1 ELSE 1 END::INT AS n FROM k WHERE s."end" > s.start), q AS (SELECT *, unnest(range(n)) AS j FROM n),
 o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) AS p, {{'a': CASE WHEN j = 0 THEN a ELSE {_EXACT.format(x='(a + (b - a) * j / n)')} END, 'b': CASE WHEN j + 1 = n THEN b ELSE {_EXACT.format(x='(a + (b - a) * (j + 1) / n)')} END}} AS x FROM q),
 r(id, p, x) AS (SELECT id, p, [x] FROM o WHERE p = 1 UNION ALL SELECT r.id, o.p, CASE WHEN r.x[-1].b - r.x[-1].a < 2 THEN list_concat(r.x[:-2], [{{'a': r.x[-1].a, 'b': o.x.b}}]) ELSE list_append(r.x, o.x) END FROM r JOIN o ON o.id = r.id AND o.p = r.p + 1),
 e AS (SELECT id, arg_max(x, p) AS x FROM r GROUP BY id), f AS (SELECT id, unnest(CASE WHEN len(x) > 1 AND x[-1].b - x[-1].a < 2 THEN list_concat(x[:-3], [{{'a': x[-2].a, 'b': x[-1].b}}]) ELSE x END) AS s FROM e)
 SELECT video_id, at_ms, round(s.a, 2) AS start, round(s.b, 2) AS "end" FROM f JOIN d USING (id)""")
def merged_shots(spark: SparkSession, d: str) -> DataFrame:
    """Shots of two to four seconds where the timeline allows it."""
    docs = table(spark, d, "caption_docs").select("video_id", F.unix_millis("captioned_at").alias("at_ms"), F.filter(F.transform("timeline", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), lambda s: s["end"] > s["start"]).alias("shots"))
    merged = split_and_merge(docs.where(F.size("shots") > 0), ["video_id", "at_ms"], "shots", 4.0, 2.0)
    return merged.select("video_id", "at_ms", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber AS spec_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
 r(l_orderkey, pos, free, pick) AS (SELECT l_orderkey, 0::BIGINT, list(pos + 1), NULL::BIGINT FROM l GROUP BY l_orderkey UNION ALL SELECT l.l_orderkey, l.pos, list_filter(r.free, lambda f: f IS DISTINCT FROM p.pick), p.pick FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.pos = r.pos + 1,
  LATERAL (SELECT CASE WHEN list_contains(r.free, l.spec_id) THEN l.spec_id WHEN list_contains(r.free, l.pos + 1) THEN l.pos + 1 END::BIGINT AS pick) p)
 SELECT l_orderkey, pos, pick AS spec FROM r WHERE pick IS NOT NULL""")
def attached_specs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order attached to its specifications (made from the line numbers), by id, else by place."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    from pyspark.sql import Window

    placed = li.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))  # an order has few lines
    return J.attach_greedy(placed.select("l_orderkey", "pos", F.col("l_linenumber").alias("spec_id")), placed.select("l_orderkey", F.col("pos").alias("place"), (F.col("pos") + 1).alias("spec")), "l_orderkey")
