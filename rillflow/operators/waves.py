"""Two waves of rollouts: the gate between them and what a group looks like after both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.evaluation import percentiles

#: Variance up to which a group counts as degenerate.
FLAT = 1e-9


def gate(df: DataFrame, key: str, score: str, most_var: float, most_mean: float) -> DataFrame:
    """``key, explore``: whether a first wave of two or more scored rollouts is flat and weak enough to explore."""
    stats = df.groupBy(key).agg(F.count(score).alias("n"), F.var_pop(score).alias("v"), F.avg(score).alias("m"))
    return stats.select(key, ((F.col("n") >= 2) & (F.col("v") <= most_var) & (F.col("m") <= most_mean)).alias("explore"))


def on_duty(ordinal: Column, period: int, phase: int) -> Column:
    return F.pmod(ordinal, F.lit(period)) == phase % period


def group_stats(df: DataFrame, key: str, wave: str, score: str, explored: Column) -> DataFrame:
    """Per group: kind of the first wave, variance after both, its share between the waves (exact: total is within plus between),
    the variance that chance alone would give, and what the second wave solved. Rows without a score don't count."""
    w1, w2, s = F.col(wave) == 1, F.col(wave) == 2, F.col(score)
    at = lambda f, w: f(F.when(w, s))
    g = df.where(s.isNotNull()).groupBy(key).agg(
        F.count_if(w1).alias("n1"), F.count_if(w2).alias("n2"), F.coalesce(at(F.avg, w1), F.lit(0.0)).alias("m1"), F.coalesce(at(F.avg, w2), F.lit(0.0)).alias("m2"), F.avg(s).alias("m"),
        at(F.var_pop, w1).alias("v1"), F.var_pop(s).alias("v"), F.bool_or(w1 & (s > 0.5)).alias("hit1"), F.bool_or(w2 & (s > 0.5)).alias("hit2"), F.bool_or(w2 & (s <= 0.5)).alias("miss2"), F.bool_or(explored).alias("triggered"),
    )
    n, flat = F.col("n1") + F.col("n2"), (F.col("n1") >= 2) & (F.coalesce("v1", F.lit(0.0)) <= FLAT)
    right, wrong = flat & (F.col("m1") >= 0.5), flat & (F.col("m1") < 0.5)
    after = F.when(n < 2, 0.0).otherwise(F.col("v"))
    between = (F.col("n1") * F.pow(F.col("m1") - F.col("m"), 2) + F.col("n2") * F.pow(F.col("m2") - F.col("m"), 2)) / n
    t = F.col("triggered")
    return g.select(
        key, right.alias("all_correct"), wrong.alias("all_wrong"), (~flat).alias("mixed"), t, (t & (after > FLAT)).alias("var_manufactured"), after.alias("var_after"), (t & wrong & F.col("hit2")).alias("cracked"),
        (t & right & F.col("miss2")).alias("broke"), F.col("m1").alias("w1_acc"), F.col("m2").alias("w2_acc"), F.when(after > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(0.0), between / after))).otherwise(0.0).alias("between_share"),
        F.when(n > 1, F.col("m1") * (1 - F.col("m1")) * (n - 1) / n).otherwise(0.0).alias("var_null"), (F.col("hit1") | F.col("hit2")).alias("pass_any"), F.col("hit1").alias("pass_any_w1"), (F.col("hit2") & ~F.col("hit1")).alias("w2_solves_new"),
    )


def roll_up(stats: DataFrame) -> DataFrame:
    """Composition, conditional shares, coverage gain and excess variance over all groups."""
    share = lambda c: F.avg(c.cast("int"))
    given = lambda c, w: F.count_if(c & w) / F.nullif(F.count_if(w).cast("double"), F.lit(0.0))
    t = F.col("triggered")
    median = percentiles(stats, [], "var_after", {"median_var": 0.5}).select("median_var")
    return stats.agg(
        F.count(F.lit(1)).alias("groups"), *[share(F.col(c)).alias(c) for c in ("all_correct", "all_wrong", "mixed", "triggered")], given(F.col("cracked"), t & F.col("all_wrong")).alias("cracked_share"), given(F.col("broke"), t & F.col("all_correct")).alias("broke_share"),
        given(F.col("w2_solves_new"), t).alias("new_triggered"), given(F.col("w2_solves_new"), ~t).alias("new_untriggered"), (share(F.col("pass_any")) - share(F.col("pass_any_w1"))).alias("coverage_gain"), (F.avg("var_after") - F.avg("var_null")).alias("excess_var"),
        F.avg("between_share").alias("between_share"),
    ).join(F.broadcast(median))  # one row each


def split_metrics(stats: DataFrame, on: Column | None = None) -> DataFrame:
    """``metric, value``: what exploring did, on triggered and untriggered groups apart. ``on`` says whether the strategy was on for a group;
    columns ``lcp_w1, lcp_w2`` (see ``prefix_means``; negative: unknown) are read where ``stats`` has them. What has no groups is left out."""
    t, n = F.col("triggered"), F.count(F.lit(1)).cast("double")
    mean = lambda c, when=None: F.avg((c if when is None else F.when(when, c)).cast("double"))
    part = lambda c, when: F.count_if(c & when) / F.nullif(F.count_if(when).cast("double"), F.lit(0.0))
    flat = F.col("all_correct") | F.col("all_wrong")
    out = {
        "two_wave/triggered_all_wrong_share": part(F.col("all_wrong"), t), "two_wave/triggered_all_correct_share": part(F.col("all_correct"), t), "two_wave/variance_manufactured_frac": part(F.col("var_manufactured"), t),
        "two_wave/wave1_acc_mean": mean(F.col("w1_acc")), "two_wave/wave2_acc_mean": mean(F.col("w2_acc")), "two_wave/explore_acc_delta": mean(F.col("w2_acc") - F.col("w1_acc"), t), "two_wave/group_var_after_triggered_mean": mean(F.col("var_after"), t),
        "two_wave/pass_at_n_mean": mean(F.col("pass_any").cast("int")), "two_wave/pass_at_n_anchor_mean": mean(F.col("pass_any_w1").cast("int")), "two_wave/n_triggered": F.count_if(t).cast("double"), "two_wave/n_untriggered": n - F.count_if(t),
    }
    halves = {"between_share": F.col("between_share"), "var_gain": F.col("var_after") - F.col("var_null"), "solves_new_frac": F.col("w2_solves_new").cast("int")}
    if {"lcp_w1", "lcp_w2"} <= set(stats.columns):
        known = (F.col("lcp_w1") >= 0) & (F.col("lcp_w2") >= 0)
        out["two_wave/lcp_w1_mean"] = mean(F.col("lcp_w1"), known)
        halves["lcp_delta"] = F.when(known, F.col("lcp_w2") - F.col("lcp_w1"))
    for name, c in halves.items():
        out |= {f"two_wave/{name}_triggered": mean(c, t), f"two_wave/{name}_untriggered": mean(c, ~t)}
    if on is not None:
        out |= {"two_wave/strategy_on_frac": mean(on.cast("int")), "two_wave/explored_frac_when_on": part(t, on), "two_wave/suppressed_by_toggle_share": part(~on, flat)}
    wide = stats.agg(*[a.alias(f"m{i}") for i, a in enumerate(out.values())])
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").cast("double").alias("value")) for i, m in enumerate(out)])
    return wide.select(F.explode(listed).alias("m")).select("m.*").where("value is not null")


def drop_decisions(df: DataFrame, key: str, position: str, p: Column, token: Column, least: int, cap: int, tau: float, tags: list[int]) -> DataFrame:
    """A replay of which top tokens an exploring sampler drops: from ``least`` on, where the top probability is above ``tau`` and the
    token is no tag, up to ``cap`` times in a sequence (rows of a sequence are bounded by its length)."""
    from pyspark.sql import Window

    trigger = (F.col(position) >= least) & (p > tau) & ~token.isin(*tags)
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(trigger.cast("int")).over(w)
    return df.withColumn("dropped", trigger & (n <= cap))


def prefix_means(df: DataFrame, key: str, wave: str, ordinal: str, ids: str, cap: int = 4096) -> DataFrame:
    """``key, lcp_w1, lcp_w2``: mean length of the prefix that each wave's rollouts share with the group's first rollout of wave 1
    (itself left out), counted up to ``cap``; -1 where there is nothing to compare."""
    from rillflow.functions.arrays import common_prefix

    first = df.where((F.col(wave) == 1) & (F.size(ids) > 0)).groupBy(key).agg(F.min_by(F.struct(F.col(ordinal).alias("o"), F.col(ids).alias("x")), ordinal).alias("_f"))
    others = df.where(F.size(ids) > 0).join(first, key).where(F.col(ordinal) != F.col("_f.o"))
    shared = others.withColumn("_n", common_prefix(F.col(ids), F.col("_f.x"), cap))
    means = shared.groupBy(key).agg(*[F.avg(F.when(F.col(wave) == w, F.col("_n"))).alias(f"lcp_w{w}") for w in (1, 2)])
    groups = df.select(key).distinct()
    return groups.join(means, key, "left").select(key, *[F.coalesce(f"lcp_w{w}", F.lit(-1.0)).alias(f"lcp_w{w}") for w in (1, 2)])
