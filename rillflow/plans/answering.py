"""Answers, adapters, sequences and files over events, captions and corpus rows."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import answers as Y
from rillflow.operators import groups as G
from rillflow.operators import sequences as Z
from rillflow.operators.batches import with_ordinal
from rillflow.operators.selecting import smallest_of_kinds
from rillflow.plans.registry import query, table
from rillflow.sources import files
from rillflow.streaming.queues import scratch


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN -1 ELSE 1 END::DOUBLE AS score FROM events")
def final_answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answer lines in several dresses; each fourth is wrong."""
    n = F.col("event_id")
    k, s = n % 4, n.cast("string")
    said = F.when(k == 0, F.concat(F.lit("Answer: $"), s, F.lit("$ dollars"))).when(k == 1, F.concat(F.lit("answer: x = \\text{"), s, F.lit("}"))).when(k == 2, F.concat(F.lit("Answer: 7\nAnswer: \\boxed{"), s, F.lit("} units"))).otherwise(F.concat(F.lit("Answer: "), s, F.lit("1")))
    return table(spark, d, "events").select("event_id", Y.signed_score(F.concat(F.lit("thinking\n"), said), s).alias("score"))


@query("SELECT p_partkey, '\\frac{' || p_size || '}{7}' AS normal FROM part")
def latex_normals(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(s, F.lit("/7"))).when(k == 1, F.concat(F.lit("x = \\dfrac{"), s, F.lit("}{7}"))).otherwise(F.concat(F.lit("\\left\\tfrac{"), s, F.lit("}{ 7 }\\right^\\circ\\text{ meters}")))
    return table(spark, d, "part").select("p_partkey", Y.latex_normal(said).alias("normal"))


@query("SELECT c_custkey, 'cafe 1234 ' || lower(c_mktsegment) AS normal FROM customer")
def match_normals(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("The Café, 1,234.0 — "), F.col("c_mktsegment"), F.lit("!"))
    return table(spark, d, "customer").select("c_custkey", Y.match_normal(said).alias("normal"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE chr((65 + event_id % 8)::INT) END AS letter FROM events")
def letter_cascades(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    k, x = n % 5, F.char((n % 8 + 65).cast("int"))
    said = F.when(k == 0, F.concat(x, F.lit(". because"))).when(k == 1, F.concat(F.lit("i pick "), x, F.lit(" then"))).when(k == 2, F.concat(F.lit("it must be ("), x, F.lit(") or so"))).when(k == 3, F.concat(F.lit("so: "), x)).otherwise("no idea")
    return table(spark, d, "events").select("event_id", Y.letter_cascade(said).alias("letter"))


@query("SELECT event_id, 1.0::DOUBLE AS format, CASE WHEN event_id % 2 = 0 THEN 3.0 ELSE round(6 * (1 + 1 + (event_id % 7 = 3)::INT) / 3.0 - 3, 6) END::DOUBLE AS correct FROM events")
def tool_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Calls that are right, or right but for their parameter's value."""
    call = lambda v: F.concat(F.lit("<think>t</think>\n<tool_call>\n{\"name\": \"f\", \"parameters\": {\"k\": "), v.cast("string"), F.lit("}}\n</tool_call>"))
    n = F.col("event_id")
    said = F.when(n % 2 == 0, n % 7).otherwise(F.lit(3))
    e = table(spark, d, "events").select("event_id", Y.tool_reward(call(said), F.when(n % 2 == 0, call(n % 7)).otherwise(F.replace(call(n % 7), F.lit("<think>t</think>\n"), F.lit("gold ")))).alias("r"))
    same = e.select("event_id", "r.format", F.round("r.correct", 6).alias("correct"))
    return same


@query("SELECT event_id, event_type AS data_source, 'user' AS role, 'How much is ' || user_id || '?' AS content, 'sum' AS ability, user_id::VARCHAR AS ground_truth, 'rule' AS style, 'train' AS split, event_id AS index FROM events")
def adapted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows in the training schema, flattened again for comparison."""
    gold = F.col("user_id").cast("string")
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("How much is "), gold, F.lit("?")).alias("content"))).alias("prompt"), F.lit("sum").alias("ability"),
        F.struct(gold.alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"), F.struct(F.lit("train").alias("split"), F.col("event_id").alias("index")).alias("extra_info"),
    )
    typed = files.to_schema(rows, "data_source string, prompt array<struct<role:string,content:string>>, ability string, reward_model struct<ground_truth:string,style:string>, extra_info struct<split:string,index:bigint>")
    return typed.select(F.col("extra_info.index").alias("event_id"), "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.*", "extra_info.*")


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"hops\":[{\"letter\":\"A\",\"value\":' || user_id || '},{\"letter\":\"B\",\"value\":7}]}' AS payload FROM events")
def request_payloads(spark: SparkSession, d: str) -> DataFrame:
    hops = F.array(F.struct(F.lit("A").alias("letter"), F.col("user_id").alias("value")), F.struct(F.lit("B").alias("letter"), F.lit(7).cast("bigint").alias("value")))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), hops.alias("hops"))).alias("payload"))


@query("WITH p AS (SELECT row_id, ceil(length(array_to_string(list_transform(prompt, lambda m: m.content), '')) / 4.0)::BIGINT AS tokens FROM corpus_rows) SELECT row_id, tokens FROM p WHERE tokens <= 250")
def short_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of at most 250 tokens at four characters each."""
    n = F.ceil(F.length(F.array_join(F.transform("prompt", lambda m: m["content"]), "")) / 4).alias("tokens")
    return table(spark, d, "corpus_rows").select("row_id", n).where("tokens <= 250")


_SESSION = "s AS (SELECT user_id AS uid, event_type AS session, event_id, value FROM events), f AS (SELECT uid, session, arg_max(value, event_id) AS score FROM s GROUP BY uid, session), g AS (SELECT uid, count(*) AS n, CASE WHEN count(*) > 1 THEN avg(score) ELSE 0 END AS mu, CASE WHEN count(*) > 1 THEN stddev_samp(score) ELSE 1 END AS sd FROM f GROUP BY uid)"


@query(f"WITH {_SESSION} SELECT s.event_id, round((f.score - mu) / (sd + 1e-6), 6) + 0.0 AS advantage FROM s JOIN f ON f.uid = s.uid AND f.session = s.session JOIN g ON g.uid = s.uid")
def adv_multi_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of several rows: only the last row's score enters its group, and all rows get what it earns."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("session"), "event_id", "value")
    final = rows.groupBy("uid", "session").agg(F.max_by("value", "event_id").alias("score"))
    earned = G.grpo(final, "uid", "score").select("uid", "session", "advantage")
    return rows.join(earned, ["uid", "session"]).select("event_id", F.round("advantage", 6).alias("advantage"))


@query("SELECT p_partkey, p_size % 9 AS prompt_len, array_to_string(list_concat(list_concat(list_transform(range(8 - p_size % 9), lambda i: 0), list_transform(range(p_size % 9), lambda i: 1)), list_concat(list_transform(range(p_size % 5), lambda i: 1), list_transform(range(4 - p_size % 5), lambda i: 0))), '') AS attention, array_to_string(list_transform(range(12), lambda i: greatest(0, i - (8 - p_size % 9))), ',') AS positions FROM part")
def attention_arrays(spark: SparkSession, d: str) -> DataFrame:
    p, r = (F.col("p_size") % 9).cast("int"), (F.col("p_size") % 5).cast("int")
    text = lambda c: c.cast("array<string>")
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).alias("prompt_len"), F.array_join(text(Z.attention(p, r, 8, 4)), "").alias("attention"), F.array_join(text(Z.positions(p, 8, 4)), ",").alias("positions"))


@query("SELECT vec_id, 16 + vec_id % 48 AS kept, 70::INT AS padded, round(embedding[(16 + vec_id % 48)::INT]::DOUBLE, 6) AS last_kept FROM embeddings")
def ragged_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Padding dropped by the mask and put back at the left."""
    df = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("r")).withColumn("m", F.transform("r", lambda _, i: (i < 16 + F.col("vec_id") % 48).cast("int")))
    df = df.withColumn("k", Z.to_ragged(F.col("r"), F.col("m"))).withColumn("p", Z.to_padded(F.col("k"), 70, F.lit(0.0), left=True))
    return df.select("vec_id", F.size("k").cast("long").alias("kept"), F.size("p").alias("padded"), F.round(Z.last_part(F.col("p"), 1)[0], 6).alias("last_kept"))


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT n + (64 - n % 64) % 64 AS n_rows, n::DOUBLE AS weight FROM n")
def weightless_padding(spark: SparkSession, d: str) -> DataFrame:
    e = with_ordinal(table(spark, d, "events").select("event_id"), ["event_id"])
    return Z.with_weightless_rows(e, "ord", table(spark, d, "events").count(), 64).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("weight").alias("weight"))


@query("""WITH k AS (SELECT row_id, extra_info.video_id AS video, list_sort(list_distinct(extra_info.hop_types)) AS h FROM corpus_rows WHERE extra_info.video_id IS NOT NULL AND len(extra_info.hop_types) > 0),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, h ORDER BY row_id) AS n FROM k) WHERE n <= 3), c AS (SELECT a.video, a.row_id AS i, b.row_id AS j, len(list_intersect(a.h, b.h)) AS o FROM f a JOIN f b ON a.video = b.video AND a.row_id < b.row_id),
 t AS (SELECT x.video, x.o + y.o + z.o AS overlap, x.i, x.j, y.j AS k FROM c x JOIN c y ON y.video = x.video AND y.i = x.j JOIN c z ON z.video = x.video AND z.i = x.i AND z.j = y.j)
 SELECT video, overlap::INT AS overlap, i || ',' || j || ',' || k AS row_ids FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY overlap, i, j, k) AS n FROM t) WHERE n = 1""")
def diverse_triples(spark: SparkSession, d: str) -> DataFrame:
    """The three questions of a video that share the fewest kinds of hop, smallest ids at a tie."""
    rows = table(spark, d, "corpus_rows").select("row_id", F.col("extra_info.video_id").alias("video"), F.col("extra_info.hop_types").alias("hop_types")).where("video is not null and size(hop_types) > 0")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kinds = {i: set(h) for i, h in zip(part["row_id"], part["hop_types"])}
        best = min(((sum(len(kinds[a] & kinds[b]) for a, b in itertools.combinations(ids, 2)), ids) for ids in itertools.combinations(sorted(kinds), 3)), default=None)
        return pd.DataFrame([] if best is None else [(part["video"].iat[0], best[0], list(best[1]))], columns=["video", "overlap", "row_ids"])

    return smallest_of_kinds(rows, "video", "row_id", "hop_types", 3).groupBy("video").applyInPandas(run, "video string, overlap int, row_ids array<long>").withColumn("row_ids", F.array_join(F.col("row_ids").cast("array<string>"), ","))


@query("SELECT count(*) + 1 AS lines, 1::BIGINT AS unreadable, count(*) FILTER (extra_info.question_id IS NULL OR trim(extra_info.question_id) IN ('', 'None')) AS without_id FROM corpus_rows")
def json_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Corpus rows written as JSON lines with a broken one among them, read by schema."""
    rows = table(spark, d, "corpus_rows").select(F.to_json(F.struct("row_id", F.col("extra_info.question_id").alias("question_id"))).alias("value"))
    path = scratch(spark, "lines")
    rows.unionByName(spark.createDataFrame([('{"row_id": 1, "question',), ("",)], "value string")).write.text(path)
    return files.line_counts(files.read_json_lines(spark, path, "row_id long, question_id string"), "question_id")


@query("SELECT user_id % 4 AS run, event_type AS key, count(*) AS n, count(*) FILTER (value > 50) AS c FROM events GROUP BY 1, 2")
def run_maps(spark: SparkSession, d: str) -> DataFrame:
    """Counters per run kept as JSON maps, a file each, and read back."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("run"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("c"))
    maps = e.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.array("n", "c"))))).alias("value"))
    path = scratch(spark, "runs")
    for run in range(4):  # a file with a name of its own for each run
        files.write_text(maps.where(F.col("run") == run).select("value"), f"{path}/run{run}.json")
    read = files.read_run_maps(spark, f"{path}/*.json", [f"run{run}" for run in range(4)])
    return read.select(F.regexp_extract("run", r"\d+", 0).cast("long").alias("run"), "key", "n", "c")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 2 END::INT AS file_no FROM orders")
def files_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A Parquet, a JSON and a JSON lines folder read one after the other by one schema."""
    orders, path = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), scratch(spark, "kinds")
    for i, (kind, end) in enumerate((("parquet", "parquet"), ("json", "json"), ("json", "jsonl"))):
        orders.where(F.col("o_orderkey") % 3 == i).write.format(kind).save(f"{path}/part{i}.{end}")
    return files.read_many(spark, [f"{path}/part{i}.{end}" for i, end in enumerate(("parquet", "json", "jsonl"))], "o_orderkey bigint, o_totalprice double")


@query("SELECT n_regionkey AS kind, count(*) AS n, 25::BIGINT AS first, 0::BIGINT AS again FROM nation GROUP BY n_regionkey")
def resumed_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities written a folder each, by a run that is repeated and then writes nothing."""
    nations, path = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("kind")), scratch(spark, "entities")
    first, again = (files.append_missing(nations, path, "nation") for _ in range(2))
    return spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"))


@query("SELECT 100::BIGINT AS lines, count(*) AS of_rows FROM customer")
def capped_dump(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of a bounded number of rows, with the number of all."""
    path = scratch(spark, "dump")
    counts = files.dump_json(table(spark, d, "customer"), path, 100)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.lit(counts["rows"]).cast("long").alias("of_rows"))


@query("SELECT r_name AS stem, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 1 END::INT AS root FROM region")
def listed_roots(spark: SparkSession, d: str) -> DataFrame:
    """Files under two roots, the first of which wins where both have one of a name."""
    path = scratch(spark, "roots")
    for r in table(spark, d, "region").select("r_regionkey", "r_name").collect():  # five rows
        for root in (0, 1):
            if root == 1 or r["r_regionkey"] % 2 == 0:
                files.write_text(spark.createDataFrame([(r["r_name"],)], "value string"), f"{path}/root{root}/{r['r_name']}.txt")
    return files.listing(spark, [f"{path}/root0", f"{path}/root1"]).select("stem", "root")


@query("SELECT video_id AS id, count(*) AS copies FROM video_files WHERE video_id IS NOT NULL GROUP BY 1")
def listed_ids(spark: SparkSession, d: str) -> DataFrame:
    """An id list with comments, endings and a second column, each id once."""
    path = scratch(spark, "ids")
    ids = table(spark, d, "video_files").where("video_id is not null").select(F.concat(F.col("video_id"), F.when(F.col("n_bytes") % 2 == 0, ".mp4").otherwise(""), F.lit("\t"), F.coalesce("corpus", F.lit(""))).alias("value"))
    ids.unionByName(spark.createDataFrame([("# made by hand",), ("  ",)], "value string")).write.text(path)
    return files.read_ids(spark, path)
