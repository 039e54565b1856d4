"""A sample whose categories have target shares: calibration by exponential tilting, drawn by the pivotal method."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut

#: Rows of one category that one task draws from; categories whose counts the driver may hold (a few numbers each).
SHARD_ROWS, MAX_CATEGORIES = 50_000, 1_000_000


@dataclass
class Sample:
    """``rows``: the drawn rows; ``report``: one row per category with its goal, what there is and what was drawn."""

    rows: DataFrame
    report: DataFrame


@dataclass
class Members:
    """Which categories count for which targets: ``cell[i]`` for ``target[i]``."""

    cell: np.ndarray
    target: np.ndarray

    def over_targets(self, by_target: np.ndarray, cells: int) -> np.ndarray:
        """Sum over the targets of each category."""
        return np.bincount(self.cell, by_target[self.target], minlength=cells).astype(float)

    def over_cells(self, by_cell: np.ndarray, targets: int) -> np.ndarray:
        """Sum over the categories of each target: its moment."""
        return np.bincount(self.target, by_cell[self.cell], minlength=targets).astype(float)

    def of(self, cells: np.ndarray, targets: np.ndarray) -> Members:
        ok = cells[self.cell] & targets[self.target]
        return Members((np.cumsum(cells) - 1)[self.cell[ok]], (np.cumsum(targets) - 1)[self.target[ok]])


def tilt(count: np.ndarray, members: Members, goals: np.ndarray, base: float, steps: int = 100) -> np.ndarray:
    """Inclusion probabilities ``base * exp(sum of l over its targets)`` of categories of ``count`` units, whose moments are ``goals``.

    Newton steps on the convex dual sum(count * p) - goals @ l, halved while they don't lower it. A step's equations are solved by
    conjugate gradients on products with the sparse Hessian, so the work follows the members and not the square of the targets.
    """
    n, k = len(count), len(goals)
    lam = np.zeros(k)

    def dual(v: np.ndarray) -> float:
        with np.errstate(over="ignore"):
            return float(np.sum(count * base * np.exp(members.over_targets(v, n))) - goals @ v)

    for _ in range(steps):
        weight = count * base * np.exp(members.over_targets(lam, n))
        slope = members.over_cells(weight, k) - goals
        if np.all(np.abs(slope) <= 1e-9 * np.maximum(1.0, goals)):
            break
        diagonal = np.maximum(members.over_cells(weight, k), 1e-300)
        step, rest = np.zeros(k), slope.copy()
        at = rest / diagonal
        along, size = at.copy(), float(rest @ at)
        for _ in range(min(k, 1000) + 10):
            if size <= 1e-20 * float(slope @ (slope / diagonal)):
                break
            bent = members.over_cells(weight * members.over_targets(along, n), k) + 1e-9 * diagonal * along
            go = size / float(along @ bent)
            step, rest = step + go * along, rest - go * bent
            at = rest / diagonal
            size, before = float(rest @ at), size
            along = at + size / before * along
        step = step / max(1.0, float(np.abs(step).max(initial=0)) / 20)
        scale, now = 1.0, dual(lam)
        while scale > 1e-9 and not dual(lam - scale * step) <= now:
            scale /= 2
        lam = lam - scale * step
    return base * np.exp(members.over_targets(lam, n))


def plan_goals(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: float, kind: np.ndarray) -> np.ndarray:
    """Rows that each target is to get: those that can't reach their goal get all there is, those whose goal lies under their floor get
    the floor, and the rest share what is left of ``size`` in the proportion of their shares. Each ``kind`` of targets by itself."""
    goal, low = np.zeros(len(share)), np.minimum(floor, available)
    for k in np.unique(kind):
        free = (kind == k) & (available > 0) & ((share > 0) | (low > 0))
        while free.any():
            rest = max(0.0, size - float(goal[(kind == k) & ~free].sum()))
            whole = share[free].sum()
            wanted = rest * share[free] / whole if whole > 0 else np.zeros(free.sum())
            at = np.flatnonzero(free)
            small, full = wanted < low[free], wanted > available[free]
            if small.any():  # floors first: they take from the others
                goal[at[small]] = low[at[small]]
                free[at[small]] = False
            elif full.any():
                goal[at[full]] = available[at[full]]
                free[at[full]] = False
            else:
                goal[at] = wanted
                break
    return goal


def plan_rates(count: np.ndarray, members: Members, goals: np.ndarray, base: float) -> np.ndarray:
    """Probabilities of each category's rows. Targets that get all they have or nothing fix their categories; the others are calibrated,
    and categories that would be drawn more than once are taken whole while the rest is calibrated again."""
    n, k = len(count), len(goals)
    available = members.over_cells(count, k)
    none, full = goals <= 0, goals >= available * (1 - 1e-12)
    rate, free = np.zeros(n), count > 0
    rate[free & (members.over_targets((full & ~none).astype(float), n) > 0)] = 1.0
    barred = members.over_targets(none.astype(float), n) > 0
    rate[barred] = 0.0
    free &= (rate == 0) & ~barred & (np.bincount(members.cell, minlength=n) > 0)
    while free.any():
        left = goals - members.over_cells(count * rate, k)
        open_ = ~none & ~full & (left > 1e-9) & (members.over_cells(free.astype(float), k) > 0)
        free &= members.over_targets(open_.astype(float), n) > 0
        if not free.any():
            break
        p = tilt(count[free], members.of(free, open_), left[open_], base)
        at = np.flatnonzero(free)
        if not (p > 1 + 1e-9).any():
            rate[at] = p
            break
        rate[at[p > 1]] = 1.0
        free[at[p > 1]] = False
    return np.minimum(rate, 1.0)


def pivotal(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Which units are taken, the unit left undecided (-1: none) and its probability: neighbours fight until one is 0 or 1."""
    taken, at, a = np.zeros(len(p), bool), -1, 0.0
    for j, (b, r) in enumerate(zip(p.tolist(), u.tolist())):
        if at < 0:
            at, a = j, b
        elif a + b < 1 - 1e-12:
            if r * (a + b) >= a:
                at = j
            a += b
        elif r * (2 - a - b) < 1 - b:
            taken[at] = True
            at, a = j, a + b - 1
        else:
            taken[j] = True
            a += b - 1
        if a >= 1 - 1e-9:
            taken[at], at, a = True, -1, 0.0
        elif a <= 1e-9:
            at, a = -1, 0.0
    return taken, at, a


def _draw(last: bool) -> Callable:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cat", "u", "ident"], kind="stable").reset_index(drop=True)
        taken, at, a = pivotal(part["p"].to_numpy(), part["u"].to_numpy())
        out = part.assign(p=np.where(taken, 1.0, 0.0))
        if at >= 0:
            out.loc[at, "p"] = (1.0 if part["u"][at] < a else 0.0) if last else a
        return out[out["p"] > 0]

    return run


def sample_to_targets(rows: DataFrame, keys: list[str], ident: str, targets: DataFrame, fraction: float, seed: int = 7) -> Sample:
    """Draw ``fraction`` of all ``rows`` with the shares of ``targets`` (``keys, target_share, min_rows``) among its categories.

    A category is a combination of ``keys``; a null key of a target stands for any value, so that shares of single keys (margins) and of
    combinations may be given together. A target gets at least ``min_rows``, or all it has; one that can't reach its goal is taken
    whole and its gap goes to the others of the same keys in proportion, so the size holds while rows last; floors come first, even where
    they add up to more than the size. Rows of no target are not drawn (a null in a key meets only targets that leave the key open).
    Targets that contradict each other are met as nearly as the dual allows. The report has ``keys, target_share, min_rows, wanted`` (the goal before
    floors), ``available, planned, sampled, gap`` (goal or floor less the drawn rows) and ``short`` (fewer rows than the goal). Repeated
    rows each take part; ``ident``, of any type, must be unique and not null. Repeated targets count once, the largest share. No rows:
    nothing drawn, all goals 0.

    Category counts, the only moments that the tilting needs, are combined before their shuffle; the probabilities are drawn
    by the ordered pivotal method in shards of about ``SHARD_ROWS`` rows of a category, then among the shards' leftovers and at last
    among the categories', so every category ends within one row of its plan and the whole has a fixed size. The driver holds
    a few numbers per category (up to ``MAX_CATEGORIES``, beyond that it is an error).
    """
    spark = rows.sparkSession
    listed = cut(targets.groupBy(*keys).agg(F.max(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0))).alias("target_share"), F.max("min_rows").alias("min_rows")).coalesce(1).orderBy(*keys).withColumn("target", F.monotonically_increasing_id()))
    goals = listed.select("target", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce(F.col("min_rows").cast("double"), F.lit(0.0)).alias("floor"), *[F.col(k).isNotNull().alias(f"k{i}") for i, k in enumerate(keys)]).limit(MAX_CATEGORIES + 1).toPandas().sort_values("target")
    named = rows.select(F.col(ident).alias("ident"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    name = F.to_json(F.struct(*[f"k{i}" for i in range(len(keys))]))
    cells = cut(named.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n")).withColumn("name", name))
    total = cells.agg(F.sum("n")).first()[0] or 0
    coded = listed.select("target", *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    kinds = goals[[f"k{i}" for i in range(len(keys))]].drop_duplicates().to_numpy().tolist()  # at most 2 to the number of keys
    met = None
    for kind in kinds:
        on = [f"k{i}" for i, given in enumerate(kind) if given]
        some = coded
        for i, given in enumerate(kind):
            some = some.where(F.col(f"k{i}").isNotNull() if given else F.col(f"k{i}").isNull())
        some = some.select("target", *on)
        pair = (cells.join(some, on) if on else cells.crossJoin(F.broadcast(some))).select("name", "n", "target")  # without keys: one row
        met = pair if met is None else met.unionByName(pair)
    found = met.limit((MAX_CATEGORIES + 1) * max(1, len(kinds))).toPandas() if met is not None else pd.DataFrame({"name": [], "n": [], "target": []})
    if len(goals) > MAX_CATEGORIES or found["name"].nunique() > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    names, cell = np.unique(found["name"].to_numpy(str), return_inverse=True)
    members = Members(cell.astype(np.int64), found["target"].to_numpy(np.int64))
    count = np.zeros(len(names))
    count[members.cell] = found["n"].to_numpy(float)
    share, floor = goals["share"].to_numpy(float), goals["floor"].to_numpy(float)
    size = float(np.floor(fraction * total + 0.5))
    available = members.over_cells(count, len(share))
    kind_of = np.unique(goals[[f"k{i}" for i in range(len(keys))]].to_numpy(bool) @ (1 << np.arange(len(keys))), return_inverse=True)[1] if len(goals) else np.zeros(0, int)
    rate = plan_rates(count, members, plan_goals(available, share, floor, size, kind_of), max(1e-12, min(1.0, size / max(1.0, count.sum()))))
    kind = f"cat long, shard long, ident {named.schema['ident'].dataType.simpleString()}, p double, u double"
    planned = cut(spark.createDataFrame([(str(c), i, float(p), int(max(1, np.ceil(n / SHARD_ROWS)))) for i, (c, p, n) in enumerate(zip(names, rate, count))], "name string, cat long, p double, shards int"))
    light = attach_small(named.select("ident", name.alias("name")), planned, ["name"], "inner", rows=len(names)).drop("name")
    chance = (F.pmod(F.xxhash64(F.lit(seed), "ident"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u")
    sure = light.where("p >= 1").select("ident")
    open_ = light.where("p > 0 and p < 1").select("cat", F.pmod(F.xxhash64(F.lit(seed + 1), "ident"), F.col("shards")).alias("shard"), "ident", "p", chance)
    drawn = cut(open_.groupBy("cat", "shard").applyInPandas(_draw(False), kind))
    done = drawn.where("p = 1").select("ident")
    level, most = drawn.where("p < 1"), max([1.0, *np.ceil(count / SHARD_ROWS)])
    while most > SHARD_ROWS:  # leftovers of very many shards meet in shards again
        most = np.ceil(most / SHARD_ROWS)
        level = cut(level.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 2), "ident"), F.lit(int(most)))).groupBy("cat", "shard").applyInPandas(_draw(False), kind))
        done, level = done.unionByName(level.where("p = 1").select("ident")), level.where("p < 1")
    level = cut(level.withColumn("shard", F.lit(0).cast("long")).groupBy("cat", "shard").applyInPandas(_draw(False), kind))
    done, level = done.unionByName(level.where("p = 1").select("ident")), level.where("p < 1")
    final = level.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda d: _draw(True)(d.drop(columns="one")), kind)  # a row per category
    chosen = cut(sure.unionByName(done).unionByName(final.select("ident")))
    picked = rows.join(chosen, F.col(ident) == chosen["ident"], "left_semi") if ident != "ident" else rows.join(chosen, "ident", "left_semi")
    reached = light.join(chosen, "ident", "left_semi").groupBy("cat").agg(F.count(F.lit(1)).alias("sampled"))
    linked = cut(spark.createDataFrame(list(zip(members.cell.tolist(), members.target.tolist())), "cat long, target long"))
    by_target = reached.join(linked, "cat").groupBy("target").agg(F.sum("sampled").alias("sampled"))
    table = list(zip(goals["target"].tolist(), (share * fraction * total).tolist(), available.astype(int).tolist(), members.over_cells(count * rate, len(share)).tolist()))
    report = listed.join(spark.createDataFrame(table, "target long, wanted double, available long, planned double"), "target").join(by_target, "target", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    report = report.withColumns({"target_share": F.coalesce("target_share", F.lit(0.0)), "min_rows": F.coalesce(F.col("min_rows").cast("long"), F.lit(0).cast("long"))})
    need = F.greatest("wanted", F.col("min_rows").cast("double"))
    report = report.withColumn("gap", F.greatest(F.lit(0.0), F.ceil(need - 1e-9) - F.col("sampled")).cast("long")).withColumn("short", F.col("available") + 1e-9 < F.col("wanted")).drop("target")
    return Sample(picked, report)
