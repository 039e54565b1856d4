"""Rule-based scores of answers against a gold, as column expressions; a registry for further ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions import text as X
from rillflow.functions.arrays import let
from rillflow.functions.answers import _match_normal as fold
from rillflow.functions.answers import latex_normal, match_normal, signed_score

FORMAT_WEIGHT, SHORT_THOUGHT, REL_TOL, ABS_TOL = 0.2, 100, 0.01, 1e-6
Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def register(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        if name in SCORERS and SCORERS[name] is not f:
            raise ValueError(f"scorer {name} is registered already")
        SCORERS[name] = f
        return f

    return add


def by_type(kind: Column, answer: Column, gold: Column, default: str = "default") -> Column:
    """The score that a row's reward type asks for; an unknown or null type uses the default."""
    out = SCORERS[default](answer, gold)
    for name, f in SCORERS.items():
        out = F.when(kind == name, f(answer, gold)).otherwise(out)
    return out


def numeric(answer: Column, gold: Column, tolerance: Column) -> Column:
    """1 for equal texts or numbers within 1e-6 or the relative tolerance of the gold (which counts absolutely for a gold of 0)."""
    clean = lambda c: F.translate(F.trim(c), ",$", "").try_cast("double")
    a, g = clean(answer), clean(gold)
    off = F.abs(a - g)
    near = (off <= ABS_TOL) | (off <= F.when(g == 0, tolerance).otherwise(tolerance * F.abs(g)))
    return F.when(F.trim(answer) == F.trim(gold), 1.0).when(near, 1.0).otherwise(0.0)


register("numeric")(lambda a, g: numeric(a, g, F.lit(REL_TOL)))


def string_match(answer: Column, gold: Column) -> Column:
    """1 for equal match forms that aren't empty."""
    return ((match_normal(answer) == match_normal(gold)) & (match_normal(gold) != "")).cast("double")


def listed(gold: Column) -> Column:
    """The texts of a list written as in code, ['a', "b"], ('a', 'b') or {'a'}; any other text is a list of itself, blank an empty one."""
    plain = F.trim(gold)
    inner = F.regexp_extract(plain, r"(?s)^[\[({](.*?),?\s*[\])}]$", 1)
    item = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?"""
    is_list = plain.rlike(rf"(?s)^[\[({{]\s*(?:(?:{item})\s*(?:,\s*|(?=[\])}}])))*[\])}}]$") & ~plain.rlike(r"^\([^,]*\)$")
    parts = F.transform(F.regexp_extract_all(inner, F.lit(f"(?s){item}"), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^(['\"])(.*)\1$", "$2"), r"\\(.)", "$1"))
    return F.when(plain == "", F.array().cast("array<string>")).when(is_list, parts).otherwise(F.array(plain))


def list_match(answer: Column, gold: Column) -> Column:
    """1 where the answer's match form is that of one of the gold's texts; 0 for an empty form. Match forms fold
    Unicode, which no built-in function does."""
    return match_normal_list(answer, listed(gold)).cast("double")


@F.pandas_udf(T.BooleanType())
def match_normal_list(answer: pd.Series, golds: pd.Series) -> pd.Series:
    return pd.Series([bool(m := fold(a)) and any(m == fold(g) for g in (gs if gs is not None else ())) for a, gs in zip(answer, golds)], dtype=bool)


for _name in ("string_match", "string", "counting", "search"):
    register(_name)(string_match)
register("list_string_match")(list_match)
register("multiple_choice")(lambda a, g: F.coalesce((X.choice_letter(a) == F.upper(F.trim(g))).cast("double"), F.lit(0.0)))
register("default")(lambda a, g: F.when(F.lower(F.trim(a)) == F.lower(F.trim(g)), 1.0).otherwise(numeric(a, g, F.lit(REL_TOL))))


def sequence(answer: Column, gold: Column) -> Column:
    """``exact`` and ``place_rate`` of an order: parts are set off by commas, semicolons, '>' or arrows (LaTeX ones too)."""
    def parts(c: Column) -> Column:
        split = F.split(F.regexp_replace(c, r"\\(?:right|to)arrow|\\to|->|→|⇒|>|;", ","), r"\s*,\s*")
        return F.filter(F.transform(split, lambda p: F.lower(F.trim(p))), lambda p: p != "")
    a, g = parts(answer), parts(gold)
    hits = F.size(F.filter(F.zip_with(a, g, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    rate = F.when((F.size(a) == F.size(g)) & (F.size(g) > 0), hits / F.size(g)).otherwise(0.0)
    return F.struct((a == g).cast("double").alias("exact"), rate.cast("double").alias("place_rate"))


#: Words after which an order may stand, tried in turn; '' is a sentence's start (fixed values).
ORDER_PHRASES = ("", "correct order is:", "correct order:", "correct order", "follow these steps in order", "the correct order is", "the final output should be")


def _numbers(parts: Column) -> Column:
    """The first whole number of each part that has one."""
    return F.transform(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"\d+", 0)), lambda x: x != ""), lambda x: x.cast("int"))


def order_in_box(text: Column) -> Column:
    """The order that a boxed answer gives, as numbers: one per part where it has parts, else all of them."""
    plain = F.regexp_replace(text, r"\\(?:long)?rightarrow|\\to", ",")
    plain = F.translate(F.regexp_replace(plain, r"\\text|\\mathrm|\\left|\\right", " "), "[]{}()$", " " * 7)
    parts = F.filter(F.split(plain, r",|;|\||/|-{0,2}>|=>|→|\n"), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) > 1, _numbers(parts)).otherwise(F.transform(F.regexp_extract_all(plain, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int")))


def order_in_prose(text: Column, n: Column) -> Column:
    """The first order of 1 to ``n`` that follows one of ``ORDER_PHRASES`` in a sentence, phrase by phrase; empty without one."""
    sentences = F.split(F.replace(text, F.lit("*"), F.lit("")), r"(?<=[.!?])\s+|\n+")

    def after(phrase: str) -> Column:
        found = F.filter(sentences, lambda s: F.contains(F.lower(s), F.lit(phrase)))
        return F.transform(found, lambda s: F.substr(s, F.instr(F.lower(s), F.lit(phrase)) + F.lit(len(phrase)))) if phrase else sentences

    orders = F.transform(F.concat(*map(after, ORDER_PHRASES)), lambda s: _numbers(F.split(s, ",")))
    good = F.filter(orders, lambda o: (F.size(o) == n) & (F.array_sort(F.array_distinct(o)) == F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)))
    return F.when(F.size(good) > 0, good[0]).otherwise(F.array().cast("array<int>"))


def order_scores(response: Column, gold: Column) -> Column:
    """``exact`` and ``place_rate`` of an order of 1 to n against '3,1,2': out of the last box, else out of the prose of the answer (or of
    all where no answer is marked). Orders of different lengths, and a gold without numbers, give 0."""
    r = F.coalesce(response, F.lit(""))
    body = F.when(r.rlike(r"(?s)<answer>.*?</answer>"), F.regexp_extract(r, r"(?s)<answer>(.*?)</answer>", 1)).otherwise(r)
    parts = F.struct(_numbers(F.split(F.coalesce(gold, F.lit("")), ",")).alias("want"), F.nullif(F.trim(X.boxed(r)), F.lit("")).alias("box"), body.alias("body"))

    def read(p: Column) -> Column:
        said = F.when(p["box"].isNotNull(), order_in_box(p["box"])).otherwise(order_in_prose(p["body"], F.size(p["want"])))
        return F.struct(said.alias("said"), p["want"].alias("want"))

    def scored(o: Column) -> Column:
        said, want = o["said"], o["want"]
        fits = (F.size(said) == F.size(want)) & (F.size(want) > 0)
        hits = F.size(F.filter(F.zip_with(said, want, lambda x, y: x.eqNullSafe(y)), lambda x: x))
        return F.struct((fits & (said == want)).cast("double").alias("exact"), F.when(fits, hits / F.size(want)).otherwise(0.0).alias("place_rate"))

    return let(let(parts, read), scored)


def within(a: Column, g: Column, tolerance: float) -> Column:
    """Whether two numbers are near: the difference at most the tolerance of the larger one."""
    return F.abs(a - g) <= tolerance * F.greatest(F.abs(a), F.abs(g))


def loosely_equal(answer: Column, gold: Column, percent: bool = True, tolerance: float = 1e-4) -> Column:
    """Equality of answers as text, as numbers (also where one is a percentage of the other), and part by part of lists and intervals
    of one kind of bracket. No algebra: other forms of one expression are different."""
    def number(c: Column) -> Column:
        plain = F.translate(F.trim(c), ",", "")
        ratio = r"^(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}$"
        over = F.regexp_extract(plain, ratio, 2).try_cast("double") / F.nullif(F.regexp_extract(plain, ratio, 3).try_cast("double"), F.lit(0.0))
        return F.when(plain.rlike(ratio), F.when(plain.startswith("-"), -over).otherwise(over)).when(plain.endswith("%"), F.regexp_replace(plain, r"\\?%$", "").try_cast("double") / 100).otherwise(plain.try_cast("double"))

    def one(a: Column, g: Column) -> Column:
        x, y = number(a), number(g)
        near = reduce(lambda p, q: p | q, [within(x, y * k, tolerance) for k in ((0.01, 1.0, 100.0) if percent else (1.0,))])
        return (F.lower(F.trim(a)) == F.lower(F.trim(g))) | (F.replace(a, F.lit(" "), F.lit("")) == F.replace(g, F.lit(" "), F.lit(""))) | F.coalesce(near, F.lit(False))

    def inside(c: Column) -> Column:
        return F.split(F.regexp_replace(F.trim(c), r"^[\[({]|[\])}]$", ""), ",")

    open_, close = (lambda c: F.regexp_extract(F.trim(c), r"^[\[({]?", 0)), (lambda c: F.regexp_extract(F.trim(c), r"[\])}]?$", 0))

    def equal(b: Column) -> Column:
        a, g = b["a"], b["g"]
        alike = (F.size(inside(a)) == F.size(inside(g))) & (F.size(inside(g)) > 1) & (open_(a) == open_(g)) & (close(a) == close(g))
        return F.coalesce(one(a, g) | (alike & ~F.exists(F.zip_with(inside(a), inside(g), one), lambda ok: ~ok)), F.lit(False))

    return let(F.struct(answer.alias("a"), gold.alias("g")), equal)  # each is worked out once


def boxed_geometry(response: Column, gold: Column, format_weight: float = 0.1) -> Column:
    """Nine tenths for the last box's value and one for a thought before a box."""
    shaped = response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    right = F.coalesce(loosely_equal(latex_normal(X.boxed(response)), latex_normal(gold)), F.lit(False)).cast("double")
    return (1 - format_weight) * right + format_weight * shaped


def marked_number(response: Column, gold: Column) -> Column:
    return F.coalesce((X.last_hash_number(response) == gold).cast("double"), F.lit(0.0))


def boxed_latex(response: Column, gold: Column) -> Column:
    return F.coalesce((latex_normal(X.boxed(response)) == latex_normal(gold)).cast("double"), F.lit(0.0))


def tagged_answer(response: Column, gold: Column) -> Column:
    """1 where the last marked answer's normal form is one of the golds' (a list written as in code, or one text)."""
    said = F.element_at(F.regexp_extract_all(response, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), -1)
    found = F.when(F.size(F.regexp_extract_all(response, F.lit(r"<answer>"), F.lit(0))) > 0, said)
    return F.coalesce(X.any_equal(found, listed(gold)), F.lit(0.0))


#: Sources and how their answers are scored (fixed values); a name that ends in * stands for all that begin so.
SOURCES: dict[str, tuple[str, ...]] = {
    "marked_number": ("openai/gsm8k",),
    "boxed_latex": ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"),
    "answer_line": ("math_dapo", "math", "math_dapo_reasoning", "aime*"),
    "loose_box": ("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"),
    "boxed_geometry": ("hiyouga/geometry3k",),
    "tagged_answer": ("searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"),
}
FAMILIES: dict[str, Scorer] = {
    "marked_number": marked_number, "boxed_latex": boxed_latex, "answer_line": signed_score, "boxed_geometry": boxed_geometry, "tagged_answer": tagged_answer,
    "loose_box": lambda r, g: loosely_equal(latex_normal(X.boxed(r)), latex_normal(g)).cast("double"),
}


def by_source(source: Column, response: Column, gold: Column) -> Column:
    """The score of a response by the rules of its source; a source without rules is an error. Sources whose answers are programs
    have none here: their tests are run elsewhere and ``pass_rate`` reads the results."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    for family, names in SOURCES.items():
        hit = source.isin([n for n in names if not n.endswith("*")])
        for n in names:
            hit = hit | source.startswith(n[:-1]) if n.endswith("*") else hit
        out = F.when(hit, FAMILIES[family](response, gold)).otherwise(out)
    return out


def pass_rate(results: Column, continuous: bool = True, first: int = 10) -> Column:
    """Share of passed tests among the first ten (``continuous``), or 1 only if all pass; results are booleans, null is not passed."""
    looked = F.slice(results, 1, first) if continuous else results
    passed = F.size(F.filter(looked, lambda x: F.coalesce(x, F.lit(False))))
    rate = F.when(F.size(looked) > 0, passed / F.size(looked)).otherwise(0.0)
    return rate if continuous else (rate == 1).cast("double")


def format_score(response: Column) -> Column:
    """1 for exactly one filled thought and one filled answer that has one box, 0.5 without a box, 0 else."""
    whole = response.rlike(r"(?s)^\s*<think>.*\S.*</think>\s*<answer>.*\S.*</answer>\s*\z")
    ok = X.single_pair(response, "think") & X.single_pair(response, "answer") & whole
    box = (X.count_of(response, "\\boxed") == 1) & (F.trim(F.coalesce(X.boxed(response), F.lit(""))) != "")
    return F.when(~ok, 0.0).when(box, 1.0).otherwise(0.5)


def composite(df: DataFrame, response: str, gold: str) -> DataFrame:
    """Adds ``accuracy, format, score``: four fifths and one fifth; a thought under 100 characters has no format score. Null is ''."""
    r = F.coalesce(F.col(response), F.lit(""))
    thought = F.trim(F.regexp_extract(r, r"(?s)<think>(.*?)</think>", 1))
    body = F.regexp_extract(r, r"(?s)<answer>(.*?)</answer>", 1)
    answer = F.when(r.contains("<answer>"), F.coalesce(X.boxed(body), body)).otherwise(r)
    accuracy = (F.trim(answer) == F.col(gold)).cast("double")
    form = F.when(F.length(thought) < SHORT_THOUGHT, 0.0).otherwise(format_score(r))
    return df.withColumns({"accuracy": accuracy, "format": form}).withColumn("score", (1 - FORMAT_WEIGHT) * F.col("accuracy") + FORMAT_WEIGHT * F.col("format"))
