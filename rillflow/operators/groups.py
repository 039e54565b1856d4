"""Statistics of groups attached to their rows, and the group-relative advantage estimators built on them.

A group's statistics are aggregated (combined before the shuffle) and joined back, so a group that holds a third of all rows is
neither collected into one task nor sorted; adaptive execution splits its join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA_EPS = 1e-6
WHITEN_EPS = 1e-8
Estimator = Callable[..., DataFrame]
ESTIMATORS: dict[str, Estimator] = {}


def register(name: str) -> Callable[[Estimator], Estimator]:
    """Register an estimator; a second one of the same name is an error, the same function again isn't."""

    def add(f: Estimator) -> Estimator:
        if ESTIMATORS.get(name, f) is not f:
            raise ValueError(f"estimator {name} is registered already")
        ESTIMATORS[name] = f
        return f

    return add


def estimator(name: str) -> Estimator:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[name]


def with_group(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its groups; rows with a null key form a group of their own."""
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *aggregates)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(renamed, same).drop(*[f"_k_{k}" for k in keys])


def group_moments(df: DataFrame, key: str, score: str) -> DataFrame:
    """Adds ``g_n, g_mean, g_std``: size, mean and sample deviation; a group of one has mean 0 and deviation 1."""
    s = F.col(score)
    out = with_group(df, [key], g_n=F.count(s), g_mean=F.avg(s), g_std=F.stddev_samp(s))
    return out.withColumns({"g_mean": F.when(F.col("g_n") > 1, F.col("g_mean")).otherwise(0.0), "g_std": F.when(F.col("g_n") > 1, F.col("g_std")).otherwise(1.0)})


@register("grpo")
def grpo(df: DataFrame, key: str, score: str, out: str = "advantage", by_std: bool = True) -> DataFrame:
    """Score less the group's mean, over its deviation plus 1e-6 (``by_std``) or as it is."""
    centred = F.col(score) - F.col("g_mean")
    return group_moments(df, key, score).withColumn(out, centred / (F.col("g_std") + SIGMA_EPS) if by_std else centred).drop("g_n", "g_mean", "g_std")


@register("rloo")
def rloo(df: DataFrame, key: str, score: str, out: str = "advantage", singleton: str = "zero") -> DataFrame:
    """Score less the mean of the group's others. A group of one gets 0, or keeps its score with ``singleton='keep'``."""
    n = F.col("g_n")
    alone = F.lit(0.0) if singleton == "zero" else F.col(score)
    out_df = with_group(df, [key], g_n=F.count(F.col(score)), g_mean=F.avg(score))
    return out_df.withColumn(out, F.when(n > 1, n / (n - 1) * (F.col(score) - F.col("g_mean"))).otherwise(alone)).drop("g_n", "g_mean")


@register("opo")
def opo(df: DataFrame, key: str, score: str, length: str, out: str = "advantage") -> DataFrame:
    """Score less the group's mean weighted by length; the baseline of a group of one is 0."""
    base = F.when(F.col("g_n") > 1, F.col("g_s") / F.col("g_l")).otherwise(0.0)
    sums = with_group(df, [key], g_n=F.count(F.col(score)), g_s=F.sum(F.col(length) * F.col(score)), g_l=F.sum(length))
    return sums.withColumn(out, F.col(score) - base).drop("g_n", "g_s", "g_l")


@register("gpg")
def gpg(df: DataFrame, key: str, score: str, out: str = "advantage", f_norm: float = 1.0) -> DataFrame:
    """Centred score times rows over rows with a score other than 0, over ``f_norm``; the mean of a group of one is 0."""
    scale = df.agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col(score) != 0))).alias("g_scale"))
    centred = group_moments(df, key, score).join(F.broadcast(scale))  # one row
    return centred.withColumn(out, F.col("g_scale") * (F.col(score) - F.col("g_mean")) / f_norm).drop("g_n", "g_mean", "g_std", "g_scale")


@register("passk")
def passk(df: DataFrame, key: str, score: str, ordinal: str, out: str = "advantage") -> DataFrame:
    """Only a group's best row (the first by ``ordinal`` at a tie) gets the best score less the second, over deviation plus 1e-6.

    Groups of one have no second score; they get 0 (the estimator is undefined there).
    """
    top = with_group(df, [key], g_n=F.count(F.col(score)), g_std=F.stddev_samp(score), g_top=F.min_by(F.col(ordinal), F.struct(-F.col(score), F.col(ordinal))))
    rest = df.join(top.select(key, ordinal, "g_top").where(F.col(ordinal) == F.col("g_top")).select(F.col(ordinal).alias("_t")), F.col(ordinal) == F.col("_t"), "left_anti")
    second = rest.groupBy(F.col(key).alias("_k")).agg(F.max(score).alias("g_second"))
    joined = top.join(second, F.col(key) == F.col("_k"), "left").drop("_k")
    best = F.when((F.col(ordinal) == F.col("g_top")) & (F.col("g_n") > 1), (F.col(score) - F.col("g_second")) / (F.col("g_std") + SIGMA_EPS)).otherwise(0.0)
    return joined.withColumn(out, best).drop("g_n", "g_std", "g_top", "g_second")


def whiten_rows(df: DataFrame, value: str, out: str, weight: Column | None = None) -> DataFrame:
    """Value less the weighted mean of all rows over the root of their variance (Bessel) plus 1e-8."""
    w = F.lit(1.0) if weight is None else weight
    v = F.col(value)
    first = df.agg(F.sum(w).alias("w_n"), (F.sum(w * v) / (F.sum(w) + WHITEN_EPS)).alias("w_mean"))
    centred = df.join(F.broadcast(first))  # one row; squares about the mean, as those about 0 cancel where it is large
    second = centred.agg(F.sum(w * F.pow(v - F.col("w_mean"), 2)).alias("w_q"))
    var = F.col("w_q") / (F.col("w_n") + WHITEN_EPS) * F.col("w_n") / (F.col("w_n") - 1)
    return centred.join(F.broadcast(second)).withColumn(out, (v - F.col("w_mean")) / F.sqrt(var + WHITEN_EPS)).drop("w_n", "w_mean", "w_q")


@register("rfpp_baseline")
def rfpp_baseline(df: DataFrame, key: str, score: str, length: str, out: str = "advantage") -> DataFrame:
    """Centred score (mean 0 for a group of one) on each of a row's tokens, whitened over all tokens."""
    centred = group_moments(df, key, score).withColumn("_c", F.col(score) - F.col("g_mean")).drop("g_n", "g_mean", "g_std")
    return whiten_rows(centred, "_c", out, F.col(length)).drop("_c")


@register("gdpo")
def gdpo(df: DataFrame, key: str, rewards: dict[str, float], length: str, out: str = "advantage") -> DataFrame:
    """Group-normalised advantage of each reward column, their weighted sum whitened over all tokens. No rewards: an error."""
    if not rewards:
        raise ValueError("name the reward columns")
    moments, total = {}, F.lit(0.0)
    for i, (name, weight) in enumerate(rewards.items()):  # one shuffle for all rewards
        n, mean, std = F.col(f"_n{i}"), F.col(f"_m{i}"), F.col(f"_s{i}")
        moments |= {f"_n{i}": F.count(name), f"_m{i}": F.avg(name), f"_s{i}": F.stddev_samp(name)}
        total = total + weight * F.when(n > 1, (F.col(name) - mean) / (std + SIGMA_EPS)).otherwise(F.col(name) / (1 + SIGMA_EPS))
    summed = with_group(df, [key], **moments).withColumn("_sum", total).drop(*moments)
    return whiten_rows(summed, "_sum", out, F.col(length)).drop("_sum")
