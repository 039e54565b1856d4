"""Text, number and scoring functions over corpus rows, documents, captions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import numeric as N
from rillflow.functions import text as X
from rillflow.operators import scoring as R
from rillflow.plans.registry import query, table


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A made answer for every event: right for two of three, in several wrappings."""
    n = F.col("event_id")
    said = F.when(n % 3 == 0, n + 1).otherwise(n).cast("string")
    think = F.concat(F.lit("<think>"), F.repeat(F.lit("step by step "), (n % 20).cast("int")), F.lit("</think>"))
    text = F.when(n % 5 == 0, F.concat(said, F.lit(" is what I get"))).when(n % 5 == 1, F.concat(think, F.lit("<answer>\\boxed{"), said, F.lit("}</answer>"))).when(n % 5 == 2, F.concat(F.lit("so #### "), said)).otherwise(F.concat(think, F.lit("<answer>"), said, F.lit("</answer>")))
    return table(spark, d, "events").select("event_id", "event_type", text.alias("response"), n.cast("string").alias("gold"))


_A = """a AS (SELECT event_id, event_type, event_id::VARCHAR AS gold, CASE event_id % 5 WHEN 0 THEN said || ' is what I get' WHEN 1 THEN think || '<answer>\\boxed{' || said || '}</answer>' WHEN 2 THEN 'so #### ' || said ELSE think || '<answer>' || said || '</answer>' END AS response
 FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id + 1 ELSE event_id END::VARCHAR AS said, '<think>' || repeat('step by step ', (event_id % 20)::INT) || '</think>' AS think FROM events))"""


@query("SELECT row_id, nullif(nullif(trim(extra_info.difficulty_band), ''), 'None') AS band, CASE WHEN regexp_full_match(trim(reward_model.ground_truth), '-?[0-9]+') THEN trim(reward_model.ground_truth)::BIGINT ELSE 0 END AS answer FROM corpus_rows")
def cleaned_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_rows").select("row_id", X.null_string(F.col("extra_info.difficulty_band")).alias("band"), X.to_int(F.col("reward_model.ground_truth")).alias("answer"))


@query("SELECT doc_id, substr(sha1(trim(regexp_replace(text, '[\\s\\x{A0}\\x{2028}\\x{2029}\\x{85}\\x{3000}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}]+', ' ', 'g'))), 1, 16) AS key FROM documents WHERE text IS NOT NULL")
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.question_key(F.col("text")).alias("key"))


@query("SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, corpus || '_' || regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '[^a-z0-9]+', '_', 'g') AS slug FROM video_files")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_files").select("path", X.stem(F.col("path")).alias("stem"), X.slug(F.col("corpus"), F.col("path")).alias("slug"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_SET = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({stop})))"


@query(f"""WITH s AS (SELECT doc_id, video_id, {_SET.format(c='text', stop=_STOP)} AS w FROM documents WHERE text IS NOT NULL AND video_id IS NOT NULL), n AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY video_id ORDER BY doc_id) AS v FROM s)
 SELECT doc_id, round(len(list_intersect(w, v))::DOUBLE / len(list_distinct(list_concat(w, v))), 6) AS similarity FROM n WHERE v IS NOT NULL AND len(list_concat(w, v)) > 0""")
def scene_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the word sets of a video's documents that follow each other."""
    from rillflow.operators.batches import with_ordinal

    s = with_ordinal(table(spark, d, "documents").where("text is not null and video_id is not null").select("doc_id", "video_id", X.token_set(F.col("text")).alias("w")), ["doc_id"], "ord", ["video_id"])
    after = s.select("video_id", (F.col("ord") - 1).alias("ord"), F.col("w").alias("v"))
    return s.join(after, ["video_id", "ord"]).where(F.size(F.concat("w", "v")) > 0).select("doc_id", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


_WS = "[\\s\\x{A0}\\x{2028}\\x{2029}\\x{85}\\x{3000}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}]+"
_QA = "array_to_string(list_filter(string_split(regexp_replace(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '{ws}', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query(f"SELECT doc_id, {_QA.format(c='text', ws=_WS)} AS plain FROM documents WHERE text IS NOT NULL")
def qa_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.qa_normal(F.col("text")).alias("plain"))


@query(f"WITH {_A} SELECT event_id, nullif(regexp_extract(response, '#### (-?[0-9.,]+)', 1), '') AS strict, list_filter(regexp_extract_all(right(response, 300), '-?[0-9.,]+'), lambda x: x <> '.')[-1] AS flexible, nullif(regexp_extract(response, '\\\\boxed\\{{([^{{}}]*)\\}}', 1), '') AS box FROM a")
def extracted_answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer read after the marks, as the last number, and out of the box."""
    r = F.col("response")
    return answers(spark, d).select("event_id", X.last_hash_number(r).alias("strict"), X.last_number(r).alias("flexible"), X.boxed(r).alias("box"))


@query(f"WITH {_A} SELECT event_id, (regexp_extract(response, '\\\\boxed\\{{([^{{}}]*)\\}}', 1)) AS last_box, (contains(response, 'boxed'))::INT AS n_boxes FROM a WHERE contains(response, 'boxed')")
def balanced_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = X.balanced_boxes("response")
    return answers(spark, d).where(F.col("response").contains("boxed")).select("event_id", boxes.alias("b")).select("event_id", F.element_at("b", -1).alias("last_box"), F.size("b").alias("n_boxes"))


@query(f"""WITH {_A}, s AS (SELECT *, regexp_extract(response, '<think>(.*)</think>', 1) AS think, contains(response, '<answer>') AS tagged, regexp_extract(response, '<answer>(.*)</answer>', 1) AS body FROM a),
 t AS (SELECT *, CASE WHEN tagged THEN CASE WHEN contains(body, '\\boxed') THEN regexp_extract(body, '\\\\boxed\\{{([^{{}}]*)\\}}', 1) ELSE body END ELSE response END AS answer, CASE WHEN tagged AND length(trim(think)) > 0 THEN CASE WHEN contains(body, '\\boxed') THEN 1.0 ELSE 0.5 END ELSE 0 END AS format FROM s)
 SELECT event_id, CAST(trim(answer) = gold AS INT)::DOUBLE AS accuracy, CASE WHEN length(trim(think)) < 100 THEN 0 ELSE format END::DOUBLE AS format, round(0.8 * CAST(trim(answer) = gold AS INT) + 0.2 * CASE WHEN length(trim(think)) < 100 THEN 0 ELSE format END, 6)::DOUBLE AS score FROM t""")
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Four fifths accuracy and one fifth format; a short thought has no format score."""
    scored = R.composite(answers(spark, d), "response", "gold")
    return scored.select("event_id", "accuracy", "format", F.round("score", 6).alias("score"))


@query(f"WITH {_A} SELECT event_type, count(*) AS n, round(avg(CAST(list_filter(regexp_extract_all(right(response, 300), '-?[0-9.,]+'), lambda x: x <> '.')[-1] = gold AS INT)), 6) AS solve_rate FROM a GROUP BY event_type")
def solve_rates(spark: SparkSession, d: str) -> DataFrame:
    hit = (X.last_number(F.col("response")).eqNullSafe(F.col("gold"))).cast("int")
    return answers(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("solve_rate"))


@query("SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN CASE WHEN abs(value * 1.005 - value) <= greatest(1e-6, 0.01 * abs(value)) THEN 1 ELSE 0 END ELSE CASE WHEN abs(value * 1.05 - value) <= greatest(1e-6, 0.01 * abs(value)) THEN 1 ELSE 0 END END, 1)::DOUBLE AS score FROM events")
def numeric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that may be off by a hundredth of the gold."""
    said = F.when(F.col("event_id") % 4 == 0, F.col("value") * 1.005).otherwise(F.col("value") * 1.05).cast("string")
    return table(spark, d, "events").select("event_id", R.numeric(said, F.col("value").cast("string"), F.lit(0.01)).alias("score"))


_SEQ = "s AS (SELECT event_id, [event_id % 3, (event_id + 1) % 3, (event_id + 2) % 3] AS gold, [event_id % 3, (event_id + 1 + event_id % 2) % 3, (event_id + 2 - event_id % 2) % 3] AS said FROM events)"


@query(f"WITH {_SEQ} SELECT event_id, CAST(said = gold AS INT)::DOUBLE AS exact, round(len(list_filter([1, 2, 3], lambda i: said[i] = gold[i])) / 3.0, 6)::DOUBLE AS place_rate FROM s")
def sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders compared as wholes and place by place; arrows and commas both part them."""
    n, k = F.col("event_id"), F.col("event_id") % 2
    gold = F.concat_ws(",", (n % 3).cast("string"), ((n + 1) % 3).cast("string"), ((n + 2) % 3).cast("string"))
    said = F.concat_ws(" \\rightarrow ", (n % 3).cast("string"), ((n + 1 + k) % 3).cast("string"), ((n + 2 - k) % 3).cast("string"))
    s = R.sequence(said, gold)
    return table(spark, d, "events").select("event_id", s["exact"].alias("exact"), F.round(s["place_rate"], 6).alias("place_rate"))


@query("WITH s AS (SELECT event_id, chr((65 + event_id % 5)::INT) AS gold, CASE event_id % 3 WHEN 0 THEN '(' || chr((65 + event_id % 4)::INT) || ') because' WHEN 1 THEN 'The answer is ' || chr((65 + event_id % 5)::INT) ELSE 'unclear' END AS said FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN said[2] WHEN 1 THEN right(said, 1) END AS letter, CAST(coalesce(CASE event_id % 3 WHEN 0 THEN said[2] WHEN 1 THEN right(said, 1) END = gold, false) AS INT)::DOUBLE AS score FROM s")
def choice_scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    letter = lambda k: F.char((F.lit(65) + k).cast("int"))
    said = F.when(n % 3 == 0, F.concat(F.lit("("), letter(n % 4), F.lit(") because"))).when(n % 3 == 1, F.concat(F.lit("The answer is "), letter(n % 5))).otherwise("unclear")
    got = X.choice_letter(said)
    return table(spark, d, "events").select("event_id", got.alias("letter"), F.coalesce((got == letter(n % 5)).cast("double"), F.lit(0.0)).alias("score"))


@query("SELECT event_id, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events")
def json_in_replies(spark: SparkSession, d: str) -> DataFrame:
    """A number out of JSON that stands in a fenced block of a reply, or bare."""
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("It is "), F.col("props"), F.lit(" I think")))
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(X.fenced_json(reply)), "$.k", "bigint").alias("k"))


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END)::BIGINT AS answer FROM events")
def integers_in_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"answer": "about '), F.col("user_id"), F.lit(' of 9", "n": 3}'))).otherwise(F.concat(F.lit("first 12, at last "), F.col("event_id")))
    return table(spark, d, "events").select("event_id", X.integer_in_reply(reply).alias("answer"))


@query("SELECT event_id, event_type AS name, (event_id % 7)::VARCHAR AS argument FROM events")
def parsed_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('ok <tool_call>\n{"name": "'), F.col("event_type"), F.lit('", "arguments": {"k": '), (F.col("event_id") % 7).cast("string"), F.lit("}}</tool_call> <tool_call>broken</tool_call>"))
    return table(spark, d, "events").select("event_id", F.explode(X.tool_calls(text)).alias("c")).select("event_id", "c.name", F.col("c.arguments")["k"].alias("argument"))


@query("WITH m AS (SELECT row_id, unnest(prompt) AS m FROM corpus_rows), k AS (SELECT row_id, m.content AS c FROM m WHERE m.role = 'user') SELECT row_id, (length(c) - length(replace(c, '<video>', '')))::BIGINT // 7 AS marks, length(replace(c, '<video>', ''))::BIGINT AS text_chars FROM k")
def placeholder_counts(spark: SparkSession, d: str) -> DataFrame:
    user = table(spark, d, "corpus_rows").select("row_id", F.explode("prompt").alias("m")).where("m.role = 'user'")
    parts = user.select("row_id", F.explode_outer(X.placeholder_parts(F.col("m.content"))).alias("p"))
    return parts.groupBy("row_id").agg(F.count_if(F.col("p.kind") == "video").alias("marks"), F.coalesce(F.sum(F.when(F.col("p.kind") == "text", F.length("p.text"))), F.lit(0)).cast("long").alias("text_chars"))


@query("SELECT doc_id, trim(replace(regexp_replace(replace(text, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' '), ' ') AS clean FROM documents WHERE text IS NOT NULL")
def brackets_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.bracket_cleanup(F.col("text")).alias("clean"))


@query("""WITH s AS (SELECT video_id, captioned_at, unnest(timeline) AS s FROM caption_docs) SELECT video_id, epoch_ms(captioned_at) AS at_ms, count(*) AS n, round(avg(CASE WHEN trim(coalesce(s.text, '')) <> '' THEN 1 ELSE 0 END), 6) AS filled, count(*) FILTER (s."end" < s.start) AS reversed FROM s GROUP BY video_id, captioned_at""")
def caption_checks(spark: SparkSession, d: str) -> DataFrame:
    """Share of segments with a caption, and segments that end before they start."""
    t = F.col("timeline")
    filled = F.size(F.filter(t, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""))
    docs = table(spark, d, "caption_docs").where(F.size(t) > 0)
    return docs.select("video_id", F.unix_millis("captioned_at").alias("at_ms"), F.size(t).cast("long").alias("n"), F.round(filled / F.size(t), 6).alias("filled"), F.size(F.filter(t, lambda s: s["end"] < s["start"])).cast("long").alias("reversed"))


@query("""WITH s AS (SELECT video_id, captioned_at, unnest(timeline) AS s, generate_subscripts(timeline, 1) AS i FROM caption_docs), r AS (SELECT video_id, captioned_at, i, '[seg ' || s.seg || ' | ' || printf('%.1f', round(s.start + 1e-9, 1)) || '-' || printf('%.1f', round(s."end" + 1e-9, 1)) || ' s] ' || coalesce(s.text, '') AS line FROM s)
 SELECT video_id, epoch_ms(captioned_at) AS at_ms, sha1(string_agg(line, chr(10) ORDER BY i)) AS rendered FROM r GROUP BY video_id, captioned_at""")
def timelines_rendered(spark: SparkSession, d: str) -> DataFrame:
    """A caption document as lines of segment, times with one decimal and text (as its hash)."""
    def line(s):
        times = [F.format_string("%.1f", F.round(s[c] + 1e-9, 1)) for c in ("start", "end")]
        return F.concat(F.lit("[seg "), s["seg"].cast("string"), F.lit(" | "), times[0], F.lit("-"), times[1], F.lit(" s] "), F.coalesce(s["text"], F.lit("")))
    docs = table(spark, d, "caption_docs").where(F.size("timeline") > 0)
    return docs.select("video_id", F.unix_millis("captioned_at").alias("at_ms"), F.sha1(F.array_join(F.transform("timeline", line), "\n")).alias("rendered"))


@query("SELECT row_id, CASE WHEN r < 0.25 THEN 'hard' WHEN r < 0.75 THEN 'medium' ELSE 'easy' END AS band3, CASE WHEN r <= 0 THEN 'dead_hard' WHEN r >= 1 THEN 'dead_easy' WHEN r < 0.25 THEN 'hard' WHEN r < 0.75 THEN 'medium' ELSE 'easy' END AS band5, greatest(24576, 24576 + 3072 * greatest(0, h - 4)) AS budget FROM (SELECT row_id, extra_info.solve_rate AS r, extra_info.num_hops AS h FROM corpus_rows WHERE extra_info.solve_rate BETWEEN 0 AND 1 AND NOT isnan(extra_info.solve_rate) AND extra_info.num_hops IS NOT NULL)")
def difficulty_bands(spark: SparkSession, d: str) -> DataFrame:
    r, h = F.col("extra_info.solve_rate"), F.col("extra_info.num_hops")
    rows = table(spark, d, "corpus_rows").where((r >= 0) & (r <= 1) & ~F.isnan(r) & h.isNotNull())
    return rows.select("row_id", N.band3(r).alias("band3"), N.band5(r).alias("band5"), N.token_budget(h).alias("budget"))


@query("SELECT l_orderkey, l_partkey, (24576 * l_quantity + l_quantity * l_quantity)::BIGINT AS workload, ceil(l_quantity / 7)::BIGINT AS parts, round(least(-(l_quantity - 30) / 10 * 0.5, 0), 6) + 0.0 AS penalty FROM lineitem")
def length_costs(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", N.workload(q).alias("workload"), N.ceil_div(q, 7).alias("parts"), (F.round(N.overlong_penalty(q, 40, 10, 0.5), 6) + 0.0).alias("penalty"))


_FRAME = "f AS (SELECT p_partkey, p_size * 37.0::DOUBLE AS w, (p_size + 3) * 23.0::DOUBLE AS h FROM part)"


@query(f"""WITH {_FRAME}, s AS (SELECT *, least(1.0, sqrt(50176 / (w * h))) AS k, round_even(w / 32, 0) * 32 AS rw, round_even(h / 32, 0) * 32 AS rh FROM f)
 SELECT p_partkey, greatest(32, floor(w * k / 32) * 32)::BIGINT AS width, (CASE WHEN rw * rh > 50176 THEN greatest(32, floor(w / sqrt(w * h / 50176) / 32) * 32) WHEN rw * rh < 3136 THEN ceil(w * sqrt(3136 / (w * h)) / 32) * 32 ELSE rw END)::BIGINT AS smart_width FROM s""")
def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 37.0, (F.col("p_size") + 3) * 23.0
    return table(spark, d, "part").select("p_partkey", N.frame_side(w, h, 50176).cast("long").alias("width"), N.smart_side(w, h, 3136, 50176).cast("long").alias("smart_width"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(7), lambda i: round_even(i * (p_size + 6) / 6.0, 0)::INT))), ',') AS at FROM part")
def even_samples(spark: SparkSession, d: str) -> DataFrame:
    """Seven frames spread evenly over a video's frames."""
    from rillflow.functions.arrays import even_indices

    return table(spark, d, "part").select("p_partkey", F.array_join(even_indices(F.col("p_size") + 7, F.lit(7)).cast("array<string>"), ",").alias("at"))


@query("WITH h AS (SELECT p_partkey, [[p_size, p_size + 1], [p_size % 7, p_size % 5], [p_size % 11, 2]] AS b FROM part), s AS (SELECT p_partkey, list_sort(flatten(list_transform(b[1], lambda x: flatten(list_transform(b[2], lambda y: list_transform(b[3], lambda z: x + y + z)))))) AS s FROM h) SELECT p_partkey, len(s) = len(list_distinct(s)) AS distinct_totals, s[-1]::BIGINT AS largest FROM s")
def branch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Whether every choice of branches has a total of its own."""
    from rillflow.functions.arrays import all_sums_distinct, subset_sums

    n = F.col("p_size").cast("bigint")
    pairs = F.array(F.array(n, n + 1), F.array(n % 7, n % 5), F.array(n % 11, F.lit(2).cast("bigint")))
    return table(spark, d, "part").select("p_partkey", all_sums_distinct(pairs).alias("distinct_totals"), F.array_max(subset_sums(pairs)).alias("largest"))


@query("SELECT user_id, round(0.1 * exp(sum(ln(1 + least(greatest(value / 50 - 1, -0.2), 0.2) * 10 / 1000.0))), 9) AS coefficient FROM events GROUP BY user_id")
def adaptive_kl(spark: SparkSession, d: str) -> DataFrame:
    """A KL coefficient after all of a user's steps."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(N.adaptive_final(F.col("value"), F.lit(10.0), 0.1, 50.0, 1000.0), 9).alias("coefficient"))


@query("SELECT vec_id, round(0.1 * exp(list_sum(list_transform(embedding, lambda x: ln(1 + least(greatest(abs(x::DOUBLE) / 0.1 - 1, -0.2), 0.2) * 10 / 1000.0)))), 9) AS coefficient FROM embeddings")
def adaptive_kl_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The same where a row holds its steps in order."""
    steps = F.transform("embedding", lambda x: F.struct(F.abs(x.cast("double")).alias("kl"), F.lit(10.0).alias("n")))
    return table(spark, d, "embeddings").select("vec_id", F.round(N.adaptive_coefficient(steps, 0.1, 0.1, 1000.0), 9).alias("coefficient"))


@query("SELECT row_id, md5(array_to_string(list_transform(prompt, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10)) AS chat FROM corpus_rows")
def chats_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as one text by a chat template, by their hash."""
    return table(spark, d, "corpus_rows").select("row_id", F.md5(X.chat(F.col("prompt"))).alias("chat"))
