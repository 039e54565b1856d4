"""Scorers on answers in many forms: each event meets one of a list of cases, whose score is written beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import answers as Y
from rillflow.functions import text as X
from rillflow.operators import scoring as R
from rillflow.plans.registry import query, table

Case = tuple[object, ...]


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def expected(cases: list[Case], columns: dict[str, str]) -> str:
    """SQL: every event with what is written beside its case; ``columns`` are the last columns of a case, with their types."""
    rows = ", ".join(f"({k}, {', '.join(_sql(v) for v in case[-len(columns):])})" for k, case in enumerate(cases))
    listed = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns.items()))
    return f"SELECT event_id, {listed} FROM events JOIN (VALUES {rows}) AS t(k, {', '.join(f'c{i}' for i in range(len(columns)))}) ON event_id % {len(cases)} = k"


def met(spark: SparkSession, d: str, cases: list[Case], columns: str) -> DataFrame:
    """Every event with the first columns of its case."""
    n = len(columns.split(","))
    listed = spark.createDataFrame([(k, *case[:n]) for k, case in enumerate(cases)], f"k long, {columns}")
    return table(spark, d, "events").select("event_id").join(F.broadcast(listed), F.col("event_id") % len(cases) == F.col("k"))  # a few rows


ORDERS = [
    ("\\boxed{3,1,2}", "3,1,2", 1, 1), ("So \\boxed{3 \\rightarrow 1 \\rightarrow 2}", "3,1,2", 1, 1), ("\\boxed{[Clip 3 -> Clip 1, 2]}", "3,1,2", 1, 1), ("\\boxed{\\text{3 1 2}}", "3,1,2", 1, 1),
    ("\\boxed{3→2→1}", "3,1,2", 0, 1 / 3), ("\\boxed{3;1}", "3,1,2", 0, 0), ("\\boxed{9}", "", 0, 0), ("\\boxed{1,2} then \\boxed{2,1}", "2,1", 1, 1),
    ("<answer>2, 1, 3</answer>", "2,1,3", 1, 1), ("Let me think, 5 of them. The correct order is 2, 3, 1", "2,3,1", 1, 1), ("Hmm.\n**Correct order:** 1, 3, 2", "1,3,2", 1, 1),
    ("The final output should be 3, 2, 1. Or 1, 2, 3.", "3,2,1", 1, 1), ("follow these steps in order 2, 1", "1,2", 0, 0), ("1, 2, 2", "1,2,3", 0, 0), ("4, 5, 6", "4,5,6", 0, 0), (None, "1,2", 0, 0), ("no order", "1,2", 0, 0),
    ("<answer>clip 1, clip 2</answer> Correct order: 2, 1", "1,2", 1, 1), ("\\boxed{\\mathrm{Clip}\\ 4 | 3 | 2 | 1}", "4,3,2,1", 1, 1), ("\\boxed{2=>1}", "1,2", 0, 0), ("\\boxed{} correct order: 1, 2", "1,2", 1, 1),
]


@query(f"SELECT event_id, exact, round(place_rate, 6) AS place_rate FROM ({expected(ORDERS, {'exact': 'DOUBLE', 'place_rate': 'DOUBLE'})})")
def order_answers(spark: SparkSession, d: str) -> DataFrame:
    """Orders out of boxes in several dresses, and out of prose by its phrases."""
    s = R.order_scores(F.col("said"), F.col("gold"))
    return met(spark, d, ORDERS, "said string, gold string").select("event_id", s["exact"].alias("exact"), F.round(s["place_rate"], 6).alias("place_rate"))


TYPED = [
    ("string_match", "The Café!", "cafe", 1), ("string_match", "cafes", "cafe", 0), ("string_match", "", "", 0), ("string_match", "a", "A.", 1), ("string_match", "1,000", "1000.0", 1), ("counting", "The 7 cats", "7 cats", 1), ("counting", "seven", "7", 0),
    ("search", "New  York", "new york", 1), ("search", "York", "New York", 0), ("list_string_match", "Blue", "['red', 'blue']", 1), ("list_string_match", "green", "['red', 'blue']", 0), ("list_string_match", "it's", "[\"it's\", 'no']", 1),
    ("list_string_match", "2", "(1, 2)", 1), ("list_string_match", "red", "red", 1), ("list_string_match", "x", "", 0), ("list_string_match", "", "['']", 0), ("list_string_match", "the dog", "{'Dog'}", 1), ("list_string_match", "a, b", "[a, b]", 1),
    ("numeric", "3.14", "3.15", 1), ("numeric", "$1,200", "1200", 1), ("numeric", "-2", "2", 0), ("numeric", "0.000001", "0", 1), ("numeric", "n/a", "n/a", 1), ("numeric", "abc", "1", 0), ("numeric", "1e3", "1000", 1), ("numeric", "103", "100", 0),
    ("multiple_choice", "(B) because", "B", 1), ("multiple_choice", "B.", "b", 1), ("multiple_choice", "The answer is C", "C", 1), ("multiple_choice", "the answer is a dog", "A", 0), ("multiple_choice", "d", "D", 1), ("multiple_choice", "none", "A", 0), ("multiple_choice", "answer: (E)", "E", 1),
    ("other", " Yes ", "yes", 1), ("other", "yes", "no", 0), ("other", "5", "5.02", 1), (None, "5", "6", 0), (None, "Left", "left", 1),
]


@query(expected(TYPED, {"score": "DOUBLE"}))
def scores_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Answers scored by the reward type of their row."""
    return met(spark, d, TYPED, "kind string, said string, gold string").select("event_id", R.by_type(F.col("kind"), F.col("said"), F.col("gold")).alias("score"))


SOURCED = [
    ("openai/gsm8k", "so\n#### 1,234", "1234", 1), ("openai/gsm8k", "#### 5\n#### 6", "6", 1), ("openai/gsm8k", "6", "6", 0), ("openai/gsm8k", "#### $7", "7", 0), ("lighteval/MATH", "\\boxed{\\dfrac12}", "\\frac{1}{2}", 1), ("lighteval/MATH", "\\boxed{0.5}", "1/2", 1),
    ("HuggingFaceH4/MATH-500", "\\boxed{\\frac{1}{\\sqrt{\\frac{a}{b}}}}", "\\frac{1}{\\sqrt{\\frac{a}{b}}}", 1), ("HuggingFaceH4/MATH-500", "no box", "2", 0), ("math_dapo", "Answer: 12 dollars", "12", 1), ("aime_2024", "Answer: \\boxed{204}", "204", 1), ("aime_2024", "204", "204", -1),
    ("math", "Answer: x = 3", "3", 1), ("numina_cn_k12", "\\boxed{50}", "0.5", 1), ("numina_cn_k12", "\\boxed{(1, 2)}", "(1,2)", 1), ("numina_olympiads", "\\boxed{[0, 1)}", "[0, 1]", 0), ("numina_olympiads", "\\boxed{(3, 0.50001)}", "(3,0.5)", 1),
    ("hiyouga/geometry3k", "<think>t</think> \\boxed{12}", "12", 1), ("hiyouga/geometry3k", "\\boxed{12}", "12", 0.9), ("hiyouga/geometry3k", "<think>t</think> \\boxed{11}", "12", 0.1), ("hiyouga/geometry3k", "12", "12", 0),
    ("searchR1_nq", "<answer>The Eiffel tower.</answer>", "['Eiffel Tower', 'La tour']", 1), ("searchR1_nq", "<answer>a</answer> <answer>Paris</answer>", "paris", 1), ("searchR1_musique", "Paris", "Paris", 0), ("searchR1_popqa", "<answer>Rome</answer>", "['Paris']", 0),
]


@query(f"SELECT event_id, round(score, 6) AS score FROM ({expected(SOURCED, {'score': 'DOUBLE'})})")
def scores_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Responses scored by the rules of their source."""
    return met(spark, d, SOURCED, "source string, said string, gold string").select("event_id", F.round(R.by_source(F.col("source"), F.col("said"), F.col("gold")), 6).alias("score"))


LOOSE = [
    ("0.5", "50", True), ("50%", "0.5", True), ("50\\%", "50", True), ("5000", "50", True), ("500", "50", False), ("1.00005", "1", True), ("1.001", "1", False), ("Yes", "yes", True), ("x + 1", "x+1", True), ("(1, 2)", "(1,2)", True), ("(1, 2]", "(1,2)", False),
    ("[1,2,3]", "[1,2]", False), ("1, 2", "1,2.00001", True), ("{3, 4}", "{3,4}", True), ("1,000", "1000", True), ("", "0", False), ("two", "2", False), ("(a, b)", "(A,B)", True), ("-3", "3", False), ("1e2", "100", True), ("0", "0.0", True),
]


@query(expected(LOOSE, {"same": "BOOLEAN"}))
def loose_matches(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are equal as text, number, percentage, or part by part."""
    return met(spark, d, LOOSE, "said string, gold string").select("event_id", R.loosely_equal(F.col("said"), F.col("gold")).alias("same"))


GOLDS = [
    ("The Eiffel Tower!", "['eiffel tower']", 1, 1), ("It is the Eiffel Tower, in Paris", "['eiffel tower']", 0, 1), ("Paris", "['Rome', 'paris.']", 1, 1), ("Par", "['Paris']", 0, 0), ("a an the", "['']", 1, 1), ("", "['x']", 0, 0), ("Tower  Bridge", "['tower bridge']", 1, 1), ("two-part", "['twopart']", 1, 1),
]


@query(expected(GOLDS, {"exact": "DOUBLE", "contained": "DOUBLE"}))
def answers_of_many_golds(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches with any gold, and golds that the answer contains."""
    golds = R.listed(F.col("golds"))
    return met(spark, d, GOLDS, "said string, golds string").select("event_id", X.any_equal(F.col("said"), golds).alias("exact"), X.any_contained(F.col("said"), golds).alias("contained"))


BOXED = [
    ("<think>{long}</think><answer>\\boxed{\\frac{1}{\\sqrt{2}}}</answer>", "\\frac{1}{\\sqrt{2}}", 1, 1), ("<think>{long}</think><answer>\\boxed{a{b{c{d}}}}</answer>", "a{b{c{d}}}", 1, 1), ("<think>short</think><answer>\\boxed{7}</answer>", "7", 1, 0),
    ("<think>{long}</think><answer>7</answer>", "7", 1, 0.5), ("<think>{long}</think><answer>\\boxed{7} and \\boxed{8}</answer>", "8", 1, 0.5), ("<think>{long}</think><answer> </answer>", "7", 0, 0), ("7", "7", 1, 0), ("<think>{long}</think><answer>\\boxed{7</answer>", "7", 0, 0.5),
    ("<answer>\\boxed{7}</answer><think>{long}</think>", "7", 1, 0), ("<think>{long}</think><think>x</think><answer>\\boxed{7}</answer>", "7", 1, 0), ("", "", 1, 0), (None, "7", 0, 0),
]
BOXED = [(said.replace("{long}", "step by step " * 10) if said else said, *rest) for said, *rest in BOXED]


@query(f"SELECT event_id, accuracy, format, round(0.8 * accuracy + 0.2 * format, 6) AS score FROM ({expected(BOXED, {'accuracy': 'DOUBLE', 'format': 'DOUBLE'})})")
def nested_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Composite scores of answers whose boxes hold braces at several depths."""
    scored = R.composite(met(spark, d, BOXED, "said string, gold string"), "said", "gold")
    return scored.select("event_id", "accuracy", "format", F.round("score", 6).alias("score"))


LETTERED = [
    ("B", "B"), ("(C) since", "C"), ("The answer is D here", "D"), ("so it is E", "E"), ("1. A or 2. B", "B"), ("", None), ("?!", None), ("my choice is F, not G", "G"), ("it must be (H) or so", "H"), ("Option C.", "C"), ("A: yes", "A"), ("x B) y", "B"), ("'D'", "D"), ("no idea", None), ("zz G-1", "G"),
    ("correct option is\nB", "B"), ("i pick c", None), ("see C and (B) there", "B"), ("E. because A", "E"),
]


@query(expected(LETTERED, {"letter": "VARCHAR"}))
def letters_in_answers(spark: SparkSession, d: str) -> DataFrame:
    """Multiple-choice letters in many ways of writing."""
    return met(spark, d, LETTERED, "said string").select("event_id", Y.letter_cascade("said").alias("letter"))


_F1 = '{"name": "f", "parameters": {"a": 1, "b": "x"}}'
_F2 = '{"name": "f", "parameters": {"a": 2}}'
_G = '{"name": "g", "parameters": {}}'


def _called(*calls: str) -> str:
    return "<think>t</think>\n<tool_call>\n" + "\n".join(calls) + "\n</tool_call>"


TOOLED = [
    (_called(_F1), _called(_F1), 1, 3), (_called(_F1, _G), _called(_F1, _G), 1, 3), (_called(_G, _F1), _called(_F1, _G), 1, 3), (_called(_F2), _called(_F1), 1, 6 * (1 + 0.5) / 4 - 3), (_called(_G), _called(_F1), 1, -3), (_called(_F1, _G), _called(_F1), 1, 6 * (0.5 + 3) / 4 - 3),
    (_called("no json"), _called(_F1), 1, -3), ("<think>t</think>\n<response>hi</response>", "<think>t</think>\n<response>ok</response>", 1, 0), ("hi", "<response>ok</response>", 0, 0), ("hi", _called(_F1), 0, -3), (_called(_F2, _F1), _called(_F1, _F2), 1, 3),
    (_called(_F1) + "\n<response>x</response>", _called(_F1), 0, 3), (_called(_F1) + "\n<response>x</response>", _called(_F1) + "\n<response>y</response>", 1, 3), (_called('{"name": "f"}'), _called(_F1), 1, -3), (None, _called(_F1), 0, -3), ("x", None, 0, 0),
]


@query(f"SELECT event_id, format, round(correct, 6) AS correct FROM ({expected(TOOLED, {'format': 'DOUBLE', 'correct': 'DOUBLE'})})")
def tool_call_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Calls of tools that are right, partly right, in another order, unreadable or not asked for."""
    r = Y.tool_reward(F.col("said"), F.col("gold"))
    return met(spark, d, TOOLED, "said string, gold string").select("event_id", r["format"].alias("format"), F.round(r["correct"], 6).alias("correct"))


@query("SELECT event_id, (event_id % 7)::VARCHAR || '00' AS gold FROM events")
def worked_golds(spark: SparkSession, d: str) -> DataFrame:
    """The gold of a worked solution: the number after its first mark."""
    text = F.concat(F.lit("so 3 + 4\n#### "), (F.col("event_id") % 7).cast("string"), F.lit(",00\n#### 9"))
    return table(spark, d, "events").select("event_id", X.first_hash_number(text).alias("gold"))


@query("WITH r AS (SELECT user_id, list(event_type = 'purchase' ORDER BY event_id) AS r FROM events GROUP BY user_id) SELECT user_id, round(len(list_filter(r[1:10], lambda x: x)) / len(r[1:10]), 6)::DOUBLE AS first_ten, (len(list_filter(r, lambda x: NOT x)) = 0)::INT::DOUBLE AS every FROM r")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of passed tests: of the first ten, and of all."""
    results = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") == "purchase").alias("ok")))).alias("r")).withColumn("r", F.transform("r", lambda x: x["ok"]))
    return results.select("user_id", F.round(R.pass_rate(F.col("r")), 6).alias("first_ten"), R.pass_rate(F.col("r"), continuous=False).alias("every"))
