"""Importance weights and rejection masks between the policy that wrote a batch and the one that learns from it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.arrays import clamp, let, mask_size, masked_max, masked_mean, masked_sum, zip_map
from rillflow.operators.losses import SAFE, token_losses

TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
SEQUENCE_OPTIONS = tuple(f"seq_{level}_{k}" for level in ("sum", "mean") for k in ("k1", "k2", "k3")) + ("seq_max_k2", "seq_max_k3")


@dataclass(frozen=True)
class Threshold:
    lower: float | None
    upper: float


def parse_thresholds(options: list[str], spec: float | str | list) -> dict[str, Threshold]:
    """Thresholds of each option from one value for all, or a list with one each: a number, "upper" or "lower_upper".

    An option on k1 without a lower bound has 1 / upper. Booleans, an upper bound that isn't positive, a lower one above it and
    lists of another length are errors.
    """
    values = spec if isinstance(spec, list) else [spec] * len(options)
    if len(values) != len(options):
        raise ValueError("give one threshold, or one for each option")
    out = {}
    for name, value in zip(options, values):
        if name not in TOKEN_OPTIONS + SEQUENCE_OPTIONS:
            raise ValueError(f"unknown option {name}")
        if isinstance(value, bool) or value is None:
            raise ValueError(f"{name}: a threshold must be a number or text")
        parts = [float(p) for p in str(value).split("_")]
        if len(parts) > 2 or parts[-1] <= 0:
            raise ValueError(f"{name}: {value!r} is no threshold")
        lower, upper = (parts[0] if len(parts) == 2 else None), parts[-1]
        if lower is None and name.endswith("k1"):
            lower = 1 / upper
        if lower is not None and not 0 < lower <= upper:
            raise ValueError(f"{name}: the lower bound must be positive and at most the upper one")
        out[name] = Threshold(lower, upper)
    return out


def _divergences(log_ratio: Column, kind: str) -> Column:
    def one(x: Column) -> Column:
        x = clamp(x, -SAFE, SAFE)
        return {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1 - x}[kind]
    return F.transform(log_ratio, one)


def keep_mask(log_ratio: Column, mask: Column, thresholds: dict[str, Threshold]) -> Column:
    """1 where a token passes every option (token-wise, or by its sequence's sum, mean or maximum), else 0, as doubles."""
    keep = F.transform(log_ratio, lambda _: F.lit(1.0))
    for name, bound in thresholds.items():
        kind = name[-2:]
        values = _divergences(log_ratio, kind)
        low, high = (math.log(bound.lower), math.log(bound.upper)) if kind == "k1" else (None, bound.upper)
        if name in TOKEN_OPTIONS:
            passed = _each_passes(values, low, high)
        else:
            stat = {"sum": masked_sum, "mean": masked_mean, "max": masked_max}[name.split("_")[1]](values, mask)
            passed = _all_pass(values, _within(stat, low, high))
        keep = F.zip_with(keep, passed, lambda k, p: k * p)
    return keep


def _within(x: Column, low: float | None, high: float) -> Column:
    return ((x <= high) if low is None else (x >= low) & (x <= high)).cast("double")


def _each_passes(values: Column, low: float | None, high: float) -> Column:
    return F.transform(values, lambda x: _within(x, low, high))


def _all_pass(values: Column, whole: Column) -> Column:
    return let(whole, lambda w: F.transform(values, lambda _: w))


def raw_weights(log_ratio: Column, mask: Column, level: str) -> Column:
    if level == "token":
        return F.zip_with(log_ratio, mask, lambda x, m: F.exp(clamp(x, -SAFE, SAFE)) * m)
    if level == "sequence":
        whole = F.exp(clamp(masked_sum(log_ratio, mask), -SAFE, SAFE))
        return let(whole, lambda w: F.transform(mask, lambda m: w * m))
    raise ValueError(f"unknown level {level}")


def clip_weights(raw: Column, upper: float, lower: float | None = None) -> Column:
    """Weights cut at the upper bound; with a lower bound, weights outside both become 0 instead."""
    if lower is None:
        return F.transform(raw, lambda w: clamp(w, high=upper))
    return F.transform(raw, lambda w: F.when((w >= lower) & (w <= upper), w).otherwise(F.lit(0.0)))


def bypassed(df: DataFrame, advantage: str, new: str, rollout: str, mask: str, kind: str = "ppo_clip", level: str | None = None, upper: float = 2.0, normalise: bool = False, thresholds: dict[str, Threshold] | None = None) -> DataFrame:
    """``df`` with ``loss`` and ``kept``, where the rollout's own log probabilities stand for the old ones: rejected tokens leave the mask;
    ``reinforce`` is weighted by the ratio of new to rollout (``level``, cut at ``upper``), ``ppo_clip`` isn't, as its clipped ratio
    is that already."""
    if kind not in ("ppo_clip", "reinforce"):
        raise ValueError(f"unknown loss {kind}")
    a, n, o, m = (F.col(c) for c in (advantage, new, rollout, mask))
    out = df.withColumn("_x", ratio_of(n, o))
    out = out.withColumn("kept", zip_map(lambda k, w: k * w, keep_mask(F.col("_x"), m, thresholds), m) if thresholds else m)
    if kind == "ppo_clip":
        return out.withColumn("loss", token_losses("vanilla", a, n, o)).drop("_x")
    losses = token_losses("reinforce", a, n, o)
    if level is None:
        return out.withColumn("loss", losses).drop("_x")
    weighted = out.withColumn("_w", clip_weights(raw_weights(F.col("_x"), m, level), upper))
    if normalise:
        weighted = normalised(weighted, "_w", mask, level, "_w")
    return weighted.withColumn("loss", zip_map(lambda x, w: x * w, losses, F.col("_w"))).drop("_x", "_w")


def normalised(df: DataFrame, weights: str, mask: str, level: str, out: str) -> DataFrame:
    """Weights over their batch mean (over tokens, or over sequences that have a token); a mean of 1e-8 or less changes nothing."""
    w, m = F.col(weights), F.col(mask)
    if level == "token":
        mean = df.agg((F.sum(masked_sum(w, m)) / (F.sum(mask_size(m)) + 1e-8)).alias("w_mean"))
    else:
        mean = df.agg((F.sum(F.when(mask_size(m) > 0, masked_mean(w, m))) / F.greatest(F.count_if(mask_size(m) > 0), F.lit(1e-8))).alias("w_mean"))
    factor = F.when(F.col("w_mean") > 1e-8, F.col("w_mean")).otherwise(1.0)
    return df.join(F.broadcast(mean)).withColumn(out, F.transform(w, lambda x: x / factor)).drop("w_mean")  # one row


def ratio_of(new: Column, old: Column) -> Column:
    return zip_map(lambda n, o: n - o, new, old)
