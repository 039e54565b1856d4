"""Padded and ragged forms of token sequences, and the arrays that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.arrays import pad_left, pad_right


def to_ragged(x: Column, mask: Column) -> Column:
    """The elements under the mask."""
    return F.transform(F.filter(F.arrays_zip(x.alias("x"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: z["x"])


def to_padded(x: Column, size: int, fill: Column, left: bool = False) -> Column:
    return pad_left(x, size, fill) if left else pad_right(x, size, fill)


def last_part(x: Column, n: int) -> Column:
    """The last ``n`` elements: the response of a padded prompt with response."""
    return F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), F.lit(n))


def attention(prompt: Column, response: Column, prompt_size: int, response_size: int) -> Column:
    """1 over a left-padded prompt and a right-padded response of the given lengths, 0 over padding."""
    ones = lambda n: F.array_repeat(F.lit(1), n)
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    return F.concat(zeros(F.lit(prompt_size) - prompt), ones(prompt), ones(response), zeros(F.lit(response_size) - response))


def positions(prompt: Column, prompt_size: int, response_size: int) -> Column:
    """Places counted from the first token, 0 over the padding before it."""
    pad = F.lit(prompt_size) - prompt
    return F.transform(F.sequence(F.lit(0), F.lit(prompt_size + response_size - 1)), lambda i: F.greatest(F.lit(0), i - pad))


def assistant_mask(roles: Column, lengths: Column) -> Column:
    """1 on the tokens of assistant turns, 0 on all others."""
    return F.flatten(F.zip_with(roles, lengths, lambda r, n: F.array_repeat(F.when(r == "assistant", 1).otherwise(0), n)))


def with_weightless_rows(df: DataFrame, ordinal: str, total: int, divisor: int) -> DataFrame:
    """Rows until their number divides, the added ones copies of the first with ``weight`` 0; aggregates weigh them out."""
    missing = -total % divisor if total else 0
    extra = df.where(F.col(ordinal) == 0).withColumn(ordinal, F.explode(F.sequence(F.lit(total).cast("long"), F.lit(total + missing - 1).cast("long")))) if missing else df.limit(0)
    return df.withColumn("weight", F.lit(1.0)).unionByName(extra.withColumn("weight", F.lit(0.0)))


def pair_rows(df: DataFrame, prompt: str, chosen: str, rejected: str, width: int, pad: int = 0, keep: list[str] = ()) -> DataFrame:
    """Two rows per pair, its chosen answer before its rejected one: ``side, tokens, attention, answer_mask`` of ``width`` each. Prompt and answer
    stand one after the other, are cut on the right and padded there; the answer mask is 1 on the answer's tokens. Null arrays are empty."""
    none = F.array().cast(df.schema[prompt].dataType)
    p = F.coalesce(F.col(prompt), none)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.coalesce(F.col(c), none).alias("said")) for side, c in (("chosen", chosen), ("rejected", rejected))])
    rows = df.select(*keep, p.alias("_p"), F.explode(sides).alias("s")).select(*keep, "_p", "s.*")
    n, m = F.size("_p"), F.size("said")
    places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i)
    whole = F.slice(F.concat("_p", "said"), 1, width)
    filled = F.concat(whole, F.array_repeat(F.lit(pad).cast(df.schema[prompt].dataType.elementType), F.lit(width) - F.size(whole)))
    return rows.select(*keep, "side", filled.alias("tokens"), F.transform(places, lambda i: (i < n + m).cast("int")).alias("attention"), F.transform(places, lambda i: ((i >= n) & (i < n + m)).cast("int")).alias("answer_mask"))
