"""Evaluation roll-ups: mean, spread, best, worst and majority of N answers, bootstrap, and metric reducers by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import cut, previous, running

#: Resamples and seed of the bootstrap.
RESAMPLES, SEED = 1000, 42


def exact_best(df: DataFrame, keys: list[str], value: str, n: int, worst: bool = False) -> DataFrame:
    """``keys, best``: expected best (or worst) of ``n`` draws with replacement from a group's values, without simulation.

    Of N sorted values the k-th is the best with probability (k / N)^n - ((k - 1) / N)^n. Equal values are first counted, so a
    group moves as its distinct values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys).orderBy(F.desc(value) if worst else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumns({"_k": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    chance = F.pow(F.col("_k") / F.col("_n"), n) - F.pow((F.col("_k") - F.col("_c")) / F.col("_n"), n)
    return upto.groupBy(*keys).agg(F.sum(F.col(value) * chance).alias("best"))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, position: str) -> DataFrame:
    """``keys, vote, value``: the most frequent vote, the first cast at a tie, with the value it first had."""
    counted = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"), F.min_by(value, position).alias(value))
    best = F.max_by(F.struct(vote, value), F.struct("_n", -F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{vote}", f"_b.{value}")


def bootstrap(df: DataFrame, keys: list[str], value: str, position: str, n: int, how: str = "max", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``keys, mean, std`` of a reducer (max, min, mean) over ``resamples`` draws of ``n`` values with replacement, seeded.

    Groups are the answers to one prompt, a bounded number; the same draws serve all groups of one size.
    """
    reducer = {"max": np.max, "min": np.min, "mean": np.mean}[how]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values(position)[value].to_numpy(float)
        drawn = np.random.default_rng(seed).integers(0, len(values), size=(resamples, n))
        got = reducer(values[drawn], axis=1)
        return pd.DataFrame([(*[part[k].iat[0] for k in keys], float(got.mean()), float(got.std()))], columns=[*keys, "mean", "std"])

    kinds = dict(df.dtypes)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", mean double, std double")


def rollup(df: DataFrame, source: str, prompt: str, value: str, sizes: list[int]) -> DataFrame:
    """``source, metric, value``: per prompt mean and population deviation of its answers and expected best and worst of 2, 4, ...,
    then the mean over the source's prompts. Values are counted once; one order of a prompt's values serves all sizes, as the worst of
    n draws has the chances of the best read from the other end."""
    keys, c, k, n = [source, prompt], F.col("_c"), F.col("_k"), F.col("_n")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    each = Window.partitionBy(*keys)
    upto = counted.withColumns({"_k": F.sum("_c").over(each.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(each)})
    v = F.col(value).cast("double")
    mean = F.sum(v * c) / F.sum("_c")
    best = {f"best@{m}": F.sum(v * (F.pow(k / n, m) - F.pow((k - c) / n, m))) for m in sizes}
    worst = {f"worst@{m}": F.sum(v * (F.pow((n - k + c) / n, m) - F.pow((n - k) / n, m))) for m in sizes}
    centred = upto.withColumn("_mean", F.sum(v * c).over(each) / n)
    parts = centred.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.sum(c * F.pow(v - F.col("_mean"), 2)) / F.sum("_c")).alias("std"), *[a.alias(m) for m, a in (best | worst).items()])
    names = ["mean", "std", *[f"{w}@{m}" for m in sizes for w in ("best", "worst")]]
    means = parts.groupBy(source).agg(*[F.avg(f"`{m}`").alias(m) for m in names])
    return means.select(source, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in names])).alias("m")).select(source, "m.*")


def core_label(variable: Column, metric: Column) -> Column:
    """'core' for mean, majority and best of the accuracy, 'aux' for everything else."""
    return F.when((variable == "acc") & metric.rlike("^(mean|maj|best)"), "core").otherwise("aux")


def reducer_of(name: Column, whole_words: bool = False) -> Column:
    """How a metric is reduced, by its name: max, min, or the mean. Any part of the name counts, so 'minibatch' is a minimum; with
    ``whole_words`` only words of its last part do."""
    if not whole_words:
        return F.when(name.contains("max"), "max").when(name.contains("min"), "min").otherwise("mean")
    last = F.element_at(F.split(name, "/"), -1)
    return F.when(last.rlike(r"(^|[_-])max($|[_-])"), "max").when(last.rlike(r"(^|[_-])min($|[_-])"), "min").otherwise("mean")


def reduce_metrics(df: DataFrame, name: str, value: str, whole_words: bool = False) -> DataFrame:
    v, how = F.col(value), reducer_of(F.col(name), whole_words)
    return df.groupBy(name).agg(F.max(v).alias("_max"), F.min(v).alias("_min"), F.avg(v).alias("_mean")).select(name, F.when(how == "max", F.col("_max")).when(how == "min", F.col("_min")).otherwise(F.col("_mean")).alias("reduced"))


def aggregate_steps(df: DataFrame, name: str, value: str, step: str, weight: str, rules: dict[str, str]) -> DataFrame:
    """One value per metric over steps by the first rule whose text its name holds: last, sum, max, min, weighted or avg (default)."""
    v, w = F.col(value), F.col(weight)
    kinds = {"last": F.max_by(v, F.col(step)), "sum": F.sum(v), "max": F.max(v), "min": F.min(v), "weighted": F.sum(v * w) / F.sum(w), "avg": F.avg(v)}
    how = F.lit("avg")
    for part, kind in reversed(rules.items()):
        how = F.when(F.col(name).contains(part), kind).otherwise(how)
    each = df.groupBy(name).agg(*[a.alias(f"_{k}") for k, a in kinds.items()])
    pick = F.col("_avg")
    for k in kinds:
        pick = F.when(how == k, F.col(f"_{k}")).otherwise(pick)
    return each.select(name, how.alias("rule"), pick.alias("value"))


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float] | None = None) -> DataFrame:
    """Exact tp50, tp95 and tp99 (interpolated; or ``points``), mean, least and greatest of each key's values that aren't null.

    Equal values are counted before they are sorted, and ranks come from sums over ranges of values, so neither a hot key nor the
    whole table (no ``keys``) is sorted in one task.
    """
    points = points or {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}
    c, v = F.col("_c"), F.col(value).cast("double")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    spans = running(counted, keys, [value], c, "_from")
    totals = cut(spans.groupBy(*keys).agg(F.sum("_c").alias("_n"), (F.sum(v * c) / F.sum("_c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest")))
    small = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
    joined = spans.join(small, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else spans.join(F.broadcast(small))  # one row without keys
    place = {name: F.lit(p) * (F.col("_n") - 1) for name, p in points.items()}
    held = lambda at: (at >= F.col("_from")) & (at < F.col("_from") + c)
    ends = [F.max(F.when(held(f(at)), v)).alias(f"_{name}{e}") for name, at in place.items() for e, f in (("l", F.floor), ("h", F.ceil))]
    found = joined.groupBy(*keys).agg(*ends) if keys else joined.agg(*ends)
    both = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[x for x in found.columns if x not in keys])
    out = totals.join(both, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else totals.join(F.broadcast(both))
    part = lambda name: F.col(f"_{name}l") + (F.col(f"_{name}h") - F.col(f"_{name}l")) * (place[name] - F.floor(place[name]))
    return out.select(*keys, *[part(name).alias(name) for name in points], "mean", "least", "greatest")


def counter_deltas(df: DataFrame, worker: str, step: str, at: str, counter: str) -> DataFrame:
    """``step, total, delta``: each worker's last snapshot per step summed, and its growth since the step before; after a restart
    (a smaller sum) the sum itself."""
    last = df.groupBy(worker, step).agg(F.max_by(counter, at).alias("_c"))
    sums = last.groupBy(step).agg(F.sum("_c").alias("total"))
    d = F.col("total") - F.coalesce("_before", F.lit(0))
    return previous(sums, [], [step], "total", "_before").withColumn("delta", F.when(d < 0, F.col("total")).otherwise(d)).drop("_before")


#: Rates of a sampler that drops tokens: what is divided by what (fixed values). Those of ``ALWAYS`` are 0 where nothing happened, others are left out.
ALWAYS = {
    "lp_trigger_rate": ("triggered", "active_positions"), "lp_perturb_rate": ("perturbed", "triggered"), "lp_perturb_per_seq_mean": ("perturb_count_sum", "finished_seqs"), "lp_cap_hit_rate": ("cap_hit_seqs", "finished_seqs"),
    "lp_skipped_outside_think": ("skipped_outside_think", "active_positions"), "lp_skipped_min_pos": ("skipped_min_pos", "active_positions"), "lp_active_seq_mean": ("active_seq_count_sum", "active_seq_count_steps"),
}
RATES = {
    "drop/logp_mean": ("dropped_logp_sum", "perturbed"), "drop/prob_mean": ("dropped_prob_sum", "perturbed"), "drop/mass_mean": ("dropped_mass_sum", "perturbed"), "drop/runner_up_logp_mean": ("runner_up_logp_sum", "perturbed"),
    "drop/forced_logp_delta_mean": ("forced_logp_delta_sum", "perturbed"), "drop/entropy_mean": ("dropped_entropy_sum", "dropped_entropy_n"), "drop/trigger_top1_prob_mean": ("trigger_top1_prob_sum", "triggered"),
    "entropy/drop_post_mask_mean": ("drop_H_post_sum", "drop_H_post_n"), "entropy/drop_delta_mean": ("drop_dH_sum", "drop_H_post_n"), "entropy/drop_residual_concentration": ("drop_resid_conc_sum", "drop_H_post_n"),
    "entropy/drop_near_forced_frac": ("drop_H_post_near_forced", "drop_H_post_n"), "entropy/drop_open_fork_frac": ("drop_H_post_open", "drop_H_post_n"), "entropy/seq_explore_mean": ("ent_tok_sum_explore", "ent_tok_n_explore"),
    "entropy/seq_anchor_mean": ("ent_tok_sum_anchor", "ent_tok_n_anchor"), "entropy/post_drop_window_mean": ("post_drop_ent_sum", "post_drop_ent_n"),
}
#: Deviations from sums of squares, sums and numbers; differences of rates; histograms and, for some, the bin from which a share is taken.
SPREADS = {
    "entropy/drop_post_mask_std": ("drop_H_post_sq_sum", "drop_H_post_sum", "drop_H_post_n"), "entropy/seq_explore_std": ("ent_tok_sq_explore", "ent_tok_sum_explore", "ent_tok_n_explore"), "entropy/seq_anchor_std": ("ent_tok_sq_anchor", "ent_tok_sum_anchor", "ent_tok_n_anchor"),
}
GAPS = {"entropy/seq_explore_minus_anchor": ("entropy/seq_explore_mean", "entropy/seq_anchor_mean"), "entropy/post_drop_lift": ("entropy/post_drop_window_mean", "entropy/seq_explore_mean")}
BARS = {"drop/top1_hist_": ("drop_top1_hist", None, None), "entropy/hist_explore_": ("ent_hist_explore", "entropy/forking_frac_explore", 8), "entropy/hist_anchor_": ("ent_hist_anchor", "entropy/forking_frac_anchor", 8)}


def counter_rates(snapshots: DataFrame, name: str = "name", value: str = "value", bin_: str = "bin") -> DataFrame:
    """``metric, rate`` of workers' counters (``name, value`` and ``bin`` for histograms, null else), summed over all snapshots first."""
    sums = snapshots.groupBy(F.col(name).alias("k"), F.col(bin_).alias("b")).agg(F.sum(F.col(value).cast("double")).alias("v"))
    scalars = sorted({c for pair in [*ALWAYS.values(), *RATES.values(), *SPREADS.values()] for c in pair})
    wide = sums.where("b is null").agg(*[F.coalesce(F.sum(F.when(F.col("k") == c, F.col("v"))), F.lit(0.0)).alias(c) for c in scalars])
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rates = {m: F.coalesce(over(*pair), F.lit(0.0)) for m, pair in ALWAYS.items()} | {m: over(*pair) for m, pair in RATES.items()}
    rates |= {m: F.when(F.col(n) > 0, F.sqrt(F.greatest(F.lit(0.0), F.col(q) / F.col(n) - F.pow(F.col(s) / F.col(n), 2)))) for m, (q, s, n) in SPREADS.items()}
    rates |= {m: rates[a] - rates[b] for m, (a, b) in GAPS.items()}
    listed = wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), r.alias("rate")) for m, r in rates.items()])).alias("r")).select("r.*").where("rate is not null")
    bars = sums.where("b is not null").join(sums.where("b is not null").groupBy(F.col("k").alias("k2")).agg(F.sum("v").alias("whole")), F.col("k") == F.col("k2")).where("whole > 0")
    for prefix, (histogram, tail, first) in BARS.items():
        one = bars.where(F.col("k") == histogram)
        listed = listed.unionByName(one.select(F.concat(F.lit(prefix), F.col("b").cast("string")).alias("metric"), (F.col("v") / F.col("whole")).alias("rate")))
        if tail:
            listed = listed.unionByName(one.groupBy("whole").agg(F.sum(F.when(F.col("b") >= first, F.col("v")).otherwise(0.0)).alias("v")).select(F.lit(tail).alias("metric"), (F.col("v") / F.col("whole")).alias("rate")))
    return listed


def merge_histograms(df: DataFrame, array: str) -> DataFrame:
    """``bin, n``: arrays of counters summed place by place."""
    return df.select(F.posexplode(array).alias("bin", "_n")).groupBy("bin").agg(F.sum("_n").alias("n"))
