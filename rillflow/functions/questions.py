"""Questions made of hops: conditions and branch numbers out of a hop's mapping, rendered text, sums, and lints of the prose.

A hop is a struct with ``mapping`` ('if ... then 3 else 5'), ``description``, ``scene_ref`` and ``value``; hops are named A, B, ... in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import branch_numbers, to_int

LETTERS = "ABCDEFGH"
#: Words for the number of a check (fixed values).
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh")


def _bare(c: Column) -> Column:
    """Trimmed, without dots at the end; '' for null."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", "")


def condition_text(mapping: Column, description: Column) -> Column:
    """What stands between 'if' and 'then N else M' where the whole mapping is of that form, else the description."""
    whole = r"(?is)^\s*if\s+(.+?)\s+then\s+-?\d+\s+else\s+-?\d+\s*$"
    return _bare(F.when(mapping.rlike(whole), F.regexp_extract(mapping, whole, 1)).otherwise(description))


def sum_expression(n: Column, prefix: str = "H", joint: str = "+") -> Column:
    """'H1+H2+...' of ``n`` hops; '' for none."""
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit(prefix), i.cast("string"))), joint)


def answer_sum(values: Column) -> Column:
    """The sum of values that are whole numbers; null if one isn't or there are none."""
    numbers = F.transform(values, lambda v: to_int(v, None))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull()), F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, n: s + n))


def letter_of(i: Column) -> Column:
    """The letter of the i-th hop, from 1."""
    return F.substring(F.lit(LETTERS), i.cast("int"), F.lit(1))


def rendered(hops: Column, routes: Column) -> Column:
    """The question in a sentence per hop and a line that asks for the sum; ``routes`` maps a hop's number to the one that decides where
    it looks. Null where a hop has no branch numbers or there are no hops."""
    def line(hop: Column, at: Column) -> Column:
        i = at + 1
        scene, pair = _bare(hop["scene_ref"]), branch_numbers(hop["mapping"])
        by = F.try_element_at(routes, i)
        place = F.when(scene != "", F.concat(F.lit("n "), scene)).otherwise("n the video")
        opening = F.when(by.isNotNull(), F.concat(F.lit("Using check "), letter_of(by), F.lit(", i"), place)).otherwise(F.concat(F.lit("I"), place))
        condition = condition_text(hop["mapping"], hop["description"])
        return F.concat(opening, F.lit(", if "), condition, F.lit(", let "), letter_of(i), F.lit(" be "), pair[0].cast("string"), F.lit("; otherwise let "), letter_of(i), F.lit(" be "), pair[1].cast("string"), F.lit("."))

    lines = F.transform(hops, line)
    total = F.array_join(F.transform(hops, lambda _, i: letter_of(i + 1)), " + ")
    whole = F.concat(F.array_join(lines, "\n"), F.lit("\nReport "), total, F.lit(" as a single integer."))
    return F.when((F.size(hops) > 0) & ~F.exists(lines, lambda x: x.isNull()), whole)


def question_text(query: Column, hops: Column, routes: Column) -> Column:
    """The prose of a question where it has some, else the rendered hops."""
    return F.coalesce(F.nullif(F.trim(query), F.lit("")), rendered(hops, routes))


def checks_named(query: Column) -> Column:
    """Numbers of the checks that a text names: 'check two', 'check 2' or 'second check'."""
    either = rf"(?i)\bcheck\s+(?:{'|'.join(NUMBERS)}|\d)\b|\b(?:{'|'.join(ORDINALS)})\s+check\b"
    words = F.transform(F.regexp_extract_all(F.lower(query), F.lit(either), F.lit(0)), lambda m: F.trim(F.regexp_replace(m, r"\bcheck\b", "")))
    value = lambda w: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in NUMBERS]), w), F.lit(0)), F.nullif(F.array_position(F.array(*[F.lit(x) for x in ORDINALS]), w), F.lit(0)), w.try_cast("bigint"))
    return F.transform(words, value)


def lints(query: Column, n: Column) -> Column:
    """What is wrong with a question's prose of ``n`` hops: ``check`` (names one that it doesn't have), ``letters`` (other than the hops),
    ``hop`` (speaks of hops by number). Null counts as empty."""
    text = F.coalesce(query, F.lit(""))
    letters = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\bLET ([A-H]) BE\b"), F.lit(1)))
    faults = {
        "check": F.exists(checks_named(text), lambda i: (i < 1) | (i > n)),
        "letters": (F.size(letters) > 0) & (F.size(letters) != n),
        "hop": text.rlike(r"(?i)\bhop\s*\d+"),
    }
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in faults.items()]), lambda f: f.isNotNull())
