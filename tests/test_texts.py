import pytest
from pyspark.sql import functions as F

from rillflow.functions import text as X
from rillflow.operators import scoring as R
from rillflow.operators.segments import split_and_merge
from rillflow.sources import files


def ask(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]





def test_strings_and_integers(spark):
    assert ask(spark, X.null_string(F.col("t")), " a ", "None", "", None, "  ") == ["a", None, None, None, None]
    assert ask(spark, X.to_int(F.col("t")), "7", " -3 ", "--5", "²", None, "1.5") == [7, -3, 0, 0, 0, 0]
    assert ask(spark, X.branch_numbers(F.col("t")), "if x then 3 else -4", "no", None) == [[3, -4], None, None]


def test_boxes(spark):
    deep = r"so \boxed{a{b{c}}} and \boxed{\text{left}} then \boxed[9]"
    assert ask(spark, X.balanced_boxes("t"), deep, r"\boxed{open", "", None) == [["a{b{c}}", "left", "9"], [], [], []]
    assert ask(spark, X.boxed(F.col("t")), r"\boxed{1} \boxed{x{2}}", "none") == ["x{2}", None]


def test_answers(spark):
    assert ask(spark, X.last_hash_number(F.col("t")), "#### 1,200", "#### $5", "x", None) == ["1200", None, None, None]
    assert ask(spark, X.last_number(F.col("t")), "1 then 2.", "no", "..") == ["2.", None, ".."]
    assert ask(spark, X.choice_letter(F.col("t")), "(B) it is", "answer: C", "d", "nothing much", None) == ["B", "C", "D", None, None]
    assert ask(spark, X.integer_in_reply(F.col("t")), '```json\n{"answer": 5}\n```', "maybe 3 or 4", "none", None) == [5, 4, None, None]


def test_tools_and_marks(spark):
    calls = ask(spark, X.tool_calls(F.col("t")), '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>bad</tool_call>', "none")
    assert [c["name"] for c in calls[0]] == ["f"] and calls[1] == []
    parts = ask(spark, X.placeholder_parts(F.col("t")), "<video>a<image><video>", "")
    assert [(p["kind"], p["place"]) for p in parts[0]] == [("video", 0), ("text", None), ("image", 0), ("video", 1)] and parts[1] == []


def test_scores(spark):
    df = spark.createDataFrame([("1", "1.005", 1.0), ("2", "1", 0.0), ("x", "x", 1.0), ("0.000001", "0", 1.0), (None, "1", 0.0)], "a string, g string, want double")
    got = df.select(R.numeric(F.col("a"), F.col("g"), F.lit(0.01)).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)
    kinds = spark.createDataFrame([("numeric", "2", "2.01", 1.0), ("multiple_choice", "(A) yes", "a", 1.0), ("string", "The cat!", "cat", 1.0), ("other", "YES", "yes", 1.0), (None, "b", "c", 0.0)], "k string, a string, g string, want double")
    assert all(r["x"] == r["want"] for r in kinds.select(R.by_type(F.col("k"), F.col("a"), F.col("g")).alias("x"), "want").collect())


def test_format_needs_a_long_thought(spark):
    long = "<think>" + "step " * 40 + "</think><answer>\\boxed{4}</answer>"
    df = spark.createDataFrame([(long, "4"), ("<think>hm</think><answer>\\boxed{4}</answer>", "4"), (long + "x", "4"), (None, "4")], "r string, g string")
    assert [(r["accuracy"], r["format"]) for r in R.composite(df, "r", "g").collect()] == [(1.0, 1.0), (1.0, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_shots(spark):
    df = spark.createDataFrame([("v", [(0.0, 9.0), (9.0, 9.5), (9.5, 12.0)]), ("e", [])], "v string, s array<struct<start:double,end:double>>")
    got = [(r["start"], r["end"]) for r in split_and_merge(df, ["v"], "s", 4.0, 2.0).orderBy("start").collect()]
    assert got == [(0.0, 3.0), (3.0, 6.0), (6.0, 9.0), (9.0, 12.0)]


def test_json_lines_ids_and_maps(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"video_id": "v", "n": 1}\n\nbroken\n{"n": 2}\n')
    counts = files.line_counts(files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "video_id string, n int"), "video_id").first()
    assert tuple(counts) == (3, 1, 1)
    (tmp_path / "ids.txt").write_text("# list\nv1.mp4\tx\nv2\nv1\n\n")
    assert {r["id"]: r["copies"] for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"v1": 2, "v2": 1}
    for run, n in (("r1", 3), ("r2", 4)):
        (tmp_path / f"{run}.json").write_text(f'{{"k": [{n}, 1]}}')
    assert [tuple(r) for r in files.read_run_maps(spark, str(tmp_path / "r*.json"), ["r2"]).collect()] == [("r2", "k", 4, 1)]


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("v1", 1), ("v2", 2)], "v string, n int")
    assert files.append_missing(df, str(tmp_path / "out"), "v") == 2
    assert files.append_missing(df.union(spark.createDataFrame([("v3", 3)], "v string, n int")), str(tmp_path / "out"), "v") == 1
    assert files.dump_json(df, str(tmp_path / "dump"), 1) == {"rows": 2, "written": 1}
    assert files.to_schema(df, "n bigint, v string").dtypes == [("n", "bigint"), ("v", "string")]
    files.write_parquet(df, str(tmp_path / "a.parquet"))
    assert files.read_many(spark, [str(tmp_path / "a.parquet")]).count() == 2
    with pytest.raises(ValueError):
        files.read_many(spark, ["x.csv"])
    first = files.listing(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "dump")])
    assert first.count() >= 1
