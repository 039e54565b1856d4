"""Text expressions: normalisers, keys, renderings, extraction from answers, and JSON inside replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that two scene descriptions may share without being alike (fixed value).
STOP_WORDS = ("the", "and", "with", "for", "that", "this", "from", "into", "are", "was", "were", "has", "have", "his", "her", "its", "their", "then", "when", "where", "which", "while", "during")


def null_string(c: Column) -> Column:
    """Null for '', 'None' and what is blank; else the trimmed text."""
    t = F.trim(c)
    return F.when((t == "") | (t == "None"), None).otherwise(t)


def to_int(c: Column, default: int | None = 0) -> Column:
    """A whole number written with digits and at most one minus; anything else gives the default."""
    t = F.trim(c)
    got = F.when(t.rlike(r"^-?[0-9]+$"), t.try_cast("bigint"))
    return got if default is None else F.coalesce(got, F.lit(default).cast("bigint"))


def branch_numbers(mapping: Column) -> Column:
    """The two numbers of the first 'then N else M', as an array; null without one."""
    pattern = r"then\s+(-?\d+)\s+else\s+(-?\d+)"
    first = F.regexp_extract(mapping, pattern, 1)
    return F.when(first != "", F.array(to_int(first, None), to_int(F.regexp_extract(mapping, pattern, 2), None)))


def collapse(c: Column) -> Column:
    """Runs of white space, of any kind, as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def question_key(c: Column) -> Column:
    """Sixteen hex digits that texts equal up to white space share."""
    return F.substring(F.sha1(collapse(c)), 1, 16)


def stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def slug(kind: Column, path: Column) -> Column:
    """A name for an output folder: kind and last folder where there are both, else the last folder and eight digits of the path's hash."""
    base = F.regexp_replace(F.lower(F.regexp_extract(F.rtrim(F.regexp_replace(path, "/+$", "")), r"([^/]*)$", 1)), r"[^a-z0-9]+", "_")
    return F.when(kind.isNotNull() & (kind != ""), F.concat_ws("_", F.regexp_replace(F.lower(kind), r"[^a-z0-9]+", "_"), base)).otherwise(F.concat(base, F.lit("_"), F.substring(F.sha1(path), 1, 8)))


def token_set(c: Column) -> Column:
    """Distinct words of letters and digits, longer than two, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS])))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def qa_normal(c: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, single spaces."""
    bare = F.translate(F.lower(c), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.array_join(F.filter(F.split(collapse(bare), " "), lambda w: ~w.isin("", "a", "an", "the")), " ")


def any_equal(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: qa_normal(g) == qa_normal(answer)).cast("double")


def any_contained(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: qa_normal(answer).contains(qa_normal(g))).cast("double")


def last_hash_number(c: Column) -> Column:
    """The number after the last '#### ' in the last 300 characters, without commas and dollars; null without one."""
    found = F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.translate(F.element_at(found, -1), ",$", ""))


def first_hash_number(c: Column) -> Column:
    """The number after the first '#### ', without commas: the gold of a worked solution. A text without one is an error; null stays null."""
    got = F.regexp_extract(c, r"#### (-?[0-9.,]+)", 1)
    return F.when(c.isNull(), None).when(got == "", F.raise_error(F.lit("a solution without ####")).cast("string")).otherwise(F.replace(got, F.lit(","), F.lit("")))


def last_number(c: Column) -> Column:
    """The last number in the last 300 characters that is more than a dot; null without one."""
    found = F.filter(F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"(-?[0-9.,]+)"), F.lit(0)), lambda x: ~x.isin("", "."))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def braced(depth: int) -> str:
    """Pattern of a text whose braces are balanced and at most ``depth`` deep."""
    body = "[^{}]*"
    for _ in range(depth):
        body = rf"[^{{}}]*(?:\{{{body}\}}[^{{}}]*)*"
    return body


def boxed(c: Column, depth: int = 12) -> Column:
    """What the last \\boxed{...} holds, with up to ``depth`` levels of inner braces; null without one. ``balanced_boxes`` takes any depth."""
    found = F.regexp_extract_all(c, F.lit(rf"\\boxed\{{({braced(depth)})\}}"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _boxes(text: str | None) -> list[str]:
    out, at = [], 0
    text = text or ""
    while (at := text.find("\\boxed", at)) >= 0:
        at += 6
        while at < len(text) and text[at] == " ":
            at += 1
        if at >= len(text) or text[at] not in "{[":
            continue
        opening, closing, depth, start = text[at], "}" if text[at] == "{" else "]", 0, at + 1
        for i in range(at, len(text)):
            depth += (text[i] == opening) - (text[i] == closing)
            if depth == 0:
                body = text[start:i].strip()
                inner = re.fullmatch(r"\\text\{(.*)\}", body, re.S)
                out.append(inner.group(1).strip() if inner else body)
                at = i + 1
                break
        else:
            break  # a box that isn't closed ends the search
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def balanced_boxes(text: pd.Series) -> pd.Series:
    """All boxes in order, at any depth of braces; \\text{...} around a whole body is taken off, \\boxed[...] is read as well."""
    return text.map(_boxes)


def fenced_json(c: Column) -> Column:
    """JSON text in a reply: the first fenced block, else the whole, else the outermost braces, else the outermost brackets."""
    fence = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.+?)\s*```", 1), F.lit(""))
    braces, brackets = (F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]"))
    candidates = F.array(fence, F.trim(c), braces, brackets)
    good = F.filter(candidates, lambda x: x.isNotNull() & F.try_parse_json(x).isNotNull() & x.rlike(r"(?s)^\s*[\{\[]"))
    return F.when(F.size(good) > 0, good[0])


def integer_in_reply(c: Column) -> Column:
    """The first integer in the JSON's ``answer``, else the last integer of the text; null without any."""
    answer = F.try_variant_get(F.try_parse_json(fenced_json(c)), "$.answer", "string")
    keyed = F.nullif(F.regexp_extract(F.coalesce(answer, F.lit("")), r"-?\d+", 0), F.lit(""))
    every = F.regexp_extract_all(c, F.lit(r"-?\d+"), F.lit(0))
    return F.coalesce(keyed, F.when(F.size(every) > 0, F.element_at(every, -1))).try_cast("bigint")


def bracket_cleanup(c: Column) -> Column:
    """' [title]' as '. ', other bracketed parts removed, double spaces single."""
    return F.trim(F.replace(F.regexp_replace(F.replace(c, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" ")))


def chat(messages: Column, before: str = "<|im_start|>", after: str = "<|im_end|>\n", ask: bool = True) -> Column:
    """Messages (structs of role and content) as one text: each role and content between marks, and with ``ask`` the opening of the
    assistant's turn. Null contents are empty; no messages give the opening alone."""
    said = F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(after)))
    return F.concat(F.array_join(F.coalesce(said, F.array().cast("array<string>")), ""), F.lit(f"{before}assistant\n" if ask else ""))


def placeholder_parts(c: Column) -> Column:
    """A content split at its marks: structs of kind (text, image, video, audio), text and the place among the marks of that kind."""
    parts = F.filter(F.split(c, r"(?=<(?:image|video|audio)>)|(?<=<(?:image|video|audio)>)"), lambda p: p != "")
    kind = F.transform(parts, lambda p: F.when(p.rlike("^<(image|video|audio)>$"), F.regexp_extract(p, "[a-z]+", 0)).otherwise("text"))
    zipped = F.arrays_zip(kind.alias("kind"), parts.alias("text"))
    return F.transform(zipped, lambda z, i: F.struct(z["kind"].alias("kind"), z["text"].alias("text"), F.when(z["kind"] == "text", None).otherwise(F.size(F.filter(F.slice(kind, 1, i), lambda k: k == z["kind"]))).alias("place")))


def tool_calls(c: Column) -> Column:
    """Calls written as <tool_call>{...}</tool_call>: structs of name and arguments; text that isn't JSON is left out."""
    bodies = F.regexp_extract_all(c, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.try_variant_get(F.try_parse_json(b), "$.name", "string").alias("name"), F.try_variant_get(F.try_parse_json(b), "$.arguments", "map<string,string>").alias("arguments")))
    return F.filter(parsed, lambda s: s["name"].isNotNull())


def choice_letter(c: Column) -> Column:
    """A multiple-choice letter A to Z in an answer: '(B)', 'B.', 'B)', 'answer is B', or the letter alone; null else."""
    t = F.trim(c)
    tries = [F.regexp_extract(t, p, 1) for p in (r"(?i:answer\s*(?:is|:)?\s*)\(?([A-Z])\b(?!')", r"^\(?([A-Z])\s*[).:]", r"\(([A-Z])\)", r"^([A-Za-z])$")]
    return F.upper(F.coalesce(*[F.nullif(x, F.lit("")) for x in tries]))


def count_of(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def single_pair(c: Column, tag: str) -> Column:
    return (count_of(c, f"<{tag}>") == 1) & (count_of(c, f"</{tag}>") == 1)
