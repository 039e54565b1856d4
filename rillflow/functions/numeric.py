"""Number expressions: frame sizes, bands, budgets, percent and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_side(side: Column, other: Column, budget: int, factor: int = 32) -> Column:
    """A frame's side scaled (never up) so that both fit ``budget`` pixels, down to a multiple of ``factor``, at least one of it."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(budget)) / (side * other)))
    return F.greatest(F.lit(factor), F.floor(side * scale / factor) * factor)


def smart_side(side: Column, other: Column, least: int, most: int, factor: int = 32) -> Column:
    """A side rounded (halves to even) to a multiple of ``factor``; too large a frame is floored, too small a one raised to the budget."""
    r = F.bround(side / factor) * factor
    both = r * (F.bround(other / factor) * factor)
    down = F.sqrt(side * other / F.lit(float(most)))
    up = F.sqrt(F.lit(float(least)) / (side * other))
    return F.when(both > most, F.greatest(F.lit(float(factor)), F.floor(side / down / factor) * factor)).when(both < least, F.ceil(side * up / factor) * factor).otherwise(r)


def band3(rate: Column) -> Column:
    return F.when(rate < 0.25, "hard").when(rate < 0.75, "medium").when(rate.isNotNull(), "easy")


def band5(rate: Column) -> Column:
    """Bands with 0 and 1 apart: nothing to learn from questions that are never or always solved."""
    return F.when(rate <= 0, "dead_hard").when(rate >= 1, "dead_easy").otherwise(band3(rate))


def workload(length: Column) -> Column:
    """Cost of a sequence of tokens: linear plus quadratic part."""
    n = length.cast("bigint")
    return F.lit(24576).cast("bigint") * n + n * n


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("bigint")


def token_budget(hops: Column) -> Column:
    return F.greatest(F.lit(24576), F.lit(24576) + 3072 * F.greatest(F.lit(0), hops - 4))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to ``most - buffer`` tokens, then linearly down to ``-factor`` per buffer."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def entropy_after_drop(h: Column, dropped_plogp: Column, mass: Column) -> Column:
    """Entropy of what is left when tokens of probability ``mass`` are taken out, at least 0."""
    return F.greatest(F.lit(0.0), (h + dropped_plogp) / (1 - mass) + F.ln(1 - mass))


def adaptive_coefficient(steps: Column, start: float, target: float, horizon: float) -> Column:
    """A KL coefficient after ordered steps (structs of kl and n): times 1 + clip(kl / target - 1, 0.2) n / horizon at each."""
    def one(v: Column, s: Column) -> Column:
        error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), s["kl"] / target - 1))
        return v * (1 + error * s["n"] / horizon)
    return F.aggregate(steps, F.lit(start), one)


def adaptive_final(kl: Column, n: Column, start: float, target: float, horizon: float) -> Column:
    """The coefficient after all steps of a group, as an aggregate: its factors don't depend on it, so their order doesn't matter."""
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), kl / target - 1))
    return start * F.exp(F.sum(F.ln(1 + error * n / horizon)))


def round_exact(x: Column, digits: int = 2) -> Column:
    """A double rounded by its exact binary value (a tie to the even digit): 2.405, which is a little less, gives 2.4. Spark's own ``round``
    goes by the shortest decimal that stands for the double. The product's error is carried along, for sizes up to about 1e12."""
    scale = F.lit(float(10**digits))
    split = x * 134217729.0  # 2^27 + 1
    high = split - (split - x)
    whole = x * scale
    error = (high * scale - whole) + (x - high) * scale
    down = F.floor(whole).cast("double")
    left = (whole - down) + error
    up = (left > 0.5) | ((left == 0.5) & (F.pmod(down, F.lit(2.0)) == 1))
    return (down + F.when(up, 1.0).otherwise(0.0)) / scale
