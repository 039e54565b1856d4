"""Sources blended to target shares of the tokens: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut, ranked

#: What the rates of a source are fitted to: its tokens, or its tokens and records, so that lengths keep their proportions.
MOMENTS = ("tokens",)


@dataclass
class Blend:
    """``copies``: ``ident, source, size, copies`` of the used records; ``report``: one row per target source."""

    copies: DataFrame
    report: DataFrame


def balance(size: np.ndarray, count: np.ndarray, goal: float, most: float, moments: tuple[str, ...] = MOMENTS, steps: int = 200) -> np.ndarray:
    """Rates min(most, exp(x @ l)) of records of each ``size`` (``count`` of them) with sum(count * size * rate) = ``goal``.

    Of all rates that reach the goal these are nearest to using each record once (in relative entropy). x are the size and, with
    "records", 1, whose total is then held at the share of the records that the goal is of the tokens. Newton steps on the convex dual
    sum(count * e(x @ l)) - goals @ l, halved while they don't lower it; rates at ``most`` stay there and weigh nothing. A goal
    beyond all records used ``most`` times gives ``most`` throughout, a goal of 0 nothing.
    """
    size, count = size.astype(float), count.astype(float)
    whole = float(count @ size)
    if goal <= 0 or most <= 0 or whole <= 0:
        return np.zeros(len(size))
    if goal >= most * whole * (1 - 1e-12):
        return np.full(len(size), float(most))
    x = size[:, None] / size.mean()
    goals = np.array([goal / size.mean()])
    if "records" in moments:
        x, goals = np.column_stack([np.ones(len(size)), x]), np.array([count.sum() * goal / whole, goals[0]])
    top = np.log(most)

    def dual(lam: np.ndarray) -> float:  # of min(most, exp): linear beyond the bound, so it stays convex
        z = x @ lam
        return float(count @ (np.where(z < top, np.exp(np.minimum(z, top)), most * (1 + z - top)))) - float(goals @ lam)

    lam = np.zeros(x.shape[1])
    for _ in range(steps):
        z = x @ lam
        rate = np.exp(np.minimum(z, top))
        slope = x.T @ (count * rate) - goals
        if np.all(np.abs(slope) <= 1e-10 * goals):
            return rate
        bend = x.T @ ((count * rate * (z < top))[:, None] * x)
        step = np.linalg.solve(bend + 1e-9 * (np.trace(bend) + 1e-9) * np.eye(len(goals)), slope)
        scale = 1.0 / max(1.0, float(np.abs(x @ step).max()) / 8)
        now = dual(lam)
        while scale > 1e-12 and not dual(lam - scale * step) <= now:
            scale /= 2
        lam = lam - scale * step
    if "records" in moments:  # no rates within the bound hold both
        return balance(size, count, goal, most, MOMENTS, steps)
    low, high = -1e6, 1e6  # tokens alone grow with l, so halving ends where Newton steps got stuck
    for _ in range(200):
        middle = (low + high) / 2
        rate = np.exp(np.clip(x[:, 0] * middle, -700, top))
        low, high = (middle, high) if count @ (size * rate) < goal else (low, middle)
    return np.exp(np.clip(x[:, 0] * high, -700, top))


def _rounded(moments: tuple[str, ...]) -> Callable:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ascending=False, kind="stable")
        size, count, most = part["size"].to_numpy(), part["n"].to_numpy(), int(part["most"].iat[0])
        rate = balance(size, count, float(part["goal"].iat[0]), float(most), moments)
        base = np.floor(rate + 1e-9).astype(np.int64)
        owed, extra = 0.0, []
        for n, c, f, b in zip(size.tolist(), count.tolist(), np.maximum(0.0, rate - base).tolist(), base.tolist()):
            owed += f * n * c
            k = int(min(c, max(0, np.floor(owed / n + 0.5)))) if b < most else 0
            owed -= k * n
            extra.append(k)
        return part.assign(rate=rate, base=base, extra=np.array(extra, dtype=np.int64))[["source", "size", "rate", "base", "extra"]]

    return run


def blend(sizes: DataFrame, ident: str, source: str, size: str, targets: DataFrame, moments: tuple[str, ...] = MOMENTS, fill_gaps: bool = False) -> Blend:
    """Use each record 0, 1, ... ``max_repeats`` times so that each source of ``targets`` (``source, target_share, max_repeats``)
    comes to its share of the tokens in all of ``sizes``.

    Records of other or null sources, and those whose size is null or not positive, are not used, but their tokens count in the
    whole. A source that can't reach its goal is used ``max_repeats`` times throughout and reported ``short``; with ``fill_gaps`` what
    it lacks goes to the others in proportion to their shares, while they can take it. A null or negative share or limit means 0.
    Repeated target sources count once with the largest values. Repeated records are used each for itself. No records: no copies,
    every goal 0.

    Each source's rates are fitted to its histogram of lengths (``balance``), which is combined before it moves and has no more rows than
    there are lengths; sources are solved side by side and no source's state reaches the driver. A length's rate is given out as
    its whole part to all records and its fraction to some, the longest lengths first, so that what is owed never exceeds half a record
    of the current length; within a length the copies go by a rank that no single task computes. The report has ``wanted_tokens`` (the
    goal before gaps), ``blended_tokens, copies, most_copies, reached_share`` (of the tokens of all of ``sizes``) and ``actual_share``
    (of the blend).
    """
    zero = F.lit(0).cast("long")
    wanted = cut(targets.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)))).alias("target_share"), F.max(F.greatest(zero, F.coalesce(F.col("max_repeats").cast("long"), zero))).alias("max_repeats")))
    n_wanted = wanted.count()
    light = sizes.select(F.col(ident).alias("ident"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0")
    histogram = cut(light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    total = float(histogram.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0)
    held = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens"), F.sum("n").alias("documents"))
    plan = wanted.join(held, "source", "left").na.fill(0, ["tokens", "documents"]).withColumn("wanted_tokens", F.col("target_share") * F.lit(total))
    plan = cut(plan.withColumn("reach", F.col("tokens") * F.col("max_repeats")).withColumn("goal", F.col("wanted_tokens")))
    while fill_gaps:
        lack, open_ = plan.agg(F.sum(F.greatest(F.lit(0.0), F.col("goal") - F.col("reach"))), F.sum(F.when(F.col("goal") < F.col("reach"), F.col("target_share")))).first()
        if not open_ or lack <= 1e-6 * max(total, 1.0):
            break
        plan = cut(plan.withColumn("goal", F.when(F.col("goal") < F.col("reach"), F.col("goal") + F.lit(lack / open_) * F.col("target_share")).otherwise(F.col("reach").cast("double"))))
    some = attach_small(histogram, plan.where("goal > 0 and max_repeats > 0").select("source", "goal", F.col("max_repeats").alias("most")), ["source"], "inner", rows=n_wanted)
    fitted = cut(some.groupBy("source").applyInPandas(_rounded(moments), "source string, size long, rate double, base long, extra long"))
    ranks = ranked(attach_small(light, plan.select("source"), ["source"], "left_semi", rows=n_wanted), ["source", "size"], "ident", "slot")
    copies = attach_small(ranks, fitted, ["source", "size"], "inner").select(F.col("ident").alias(ident), "source", "size", (F.col("base") + (F.col("slot") < F.col("extra")).cast("long")).alias("copies")).where("copies > 0")
    # what the fitted rates come to, by length
    given = F.col("base") * F.col("n") + F.col("extra")
    used = histogram.join(fitted, ["source", "size"]).groupBy("source").agg(
        F.sum(F.col("size") * given).alias("blended_tokens"), F.sum(given).alias("copies"), F.max(F.col("base") + (F.col("extra") > 0).cast("long")).alias("most_copies"), F.sum(F.col("size") * F.col("n") * F.col("rate")).alias("fitted")
    )
    report = cut(plan.join(used, "source", "left").na.fill(0, ["blended_tokens", "copies", "most_copies", "fitted"]))
    blended = float(report.agg(F.sum("blended_tokens")).first()[0] or 0)
    short = F.col("fitted") < F.col("wanted_tokens") - F.lit(1e-9) * F.col("wanted_tokens") - 1e-6
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "tokens", "wanted_tokens", short.alias("short"), "blended_tokens", "copies", "most_copies",
        (F.col("blended_tokens") / F.lit(total if total else None).cast("double")).alias("reached_share"), (F.col("blended_tokens") / F.lit(blended if blended else None).cast("double")).alias("actual_share"),
    )
    return Blend(copies, report)
