"""Column expressions shared by the operators on corpus_rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may stand around a stored name without belonging to it.
_OUTER = r"[\s\u00a0\u200b\u2060\ufeff]+"
_EXTENSION = r"\.(mp4|webm|mkv|mov|avi|m4v)([?#].*)?$"


def clean_name(c: Column) -> Column:
    """A label in lower case without outer spaces; null stays null."""
    return F.lower(F.regexp_replace(c, rf"^{_OUTER}|{_OUTER}$", ""))


def known_rate(c: Column) -> Column:
    """The solve rate where it is one of 0 to 1; null for -1, NaN, null and anything else."""
    return F.when(~F.isnan(c) & (c >= 0) & (c <= 1), c + F.lit(0.0))


def spelled(c: Column) -> Column:
    """A video name without what differs between its spellings: outer spaces, percent signs, scheme, letter case, extension.

    A place keeps its folders; ``resolve_places`` of identity.py finds the id in it. Null and blank names give null.
    """
    plain = F.regexp_replace(c, rf"^{_OUTER}|{_OUTER}$", "")
    plain = F.when(plain.contains("%"), F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)).otherwise(plain)
    plain = F.lower(F.regexp_replace(plain, r"\\", "/"))
    plain = F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]+:/+", "/")
    plain = F.regexp_replace(F.regexp_replace(plain, r"/{2,}", "/"), rf"^\./|{_OUTER}$", "")
    return F.nullif(F.regexp_replace(plain, _EXTENSION, ""), F.lit(""))


def user_message(prompt: Column) -> Column:
    """The user's turns of a prompt, joined, without the <video> mark; '' where there is none."""
    turns = F.filter(prompt, lambda m: F.lower(F.trim(m["role"])) == "user")
    return F.coalesce(F.replace(F.array_join(F.transform(turns, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"), F.lit("<video>"), F.lit(" ")), F.lit(""))


def word_hashes(text: Column, shingle: int = 1) -> Column:
    """The words of a text (runs of letters or digits, lower case) as 64-bit hashes, sorted, repeats kept; or its runs of
    ``shingle`` words, the whole of a text that has fewer."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    if shingle == 1:
        return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - shingle + 1, F.lit(1))), lambda k: F.xxhash64(F.slice(h, k, shingle))))
    return F.when(F.size(words) > 0, F.sort_array(runs[0])).otherwise(F.array().cast("array<bigint>"))
