"""Ranked caps, top rows, quotas, splits and samples, all decided by a total order or by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut, running


def hash_order(seed: int | str, key: Column) -> Column:
    """A repeatable random order of keys that any SQL engine can reproduce."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def cap_ranked(df: DataFrame, entity: str, order: list, k: int, least: int = 0) -> DataFrame:
    """The first ``k`` rows of each entity in ``order``; entities with fewer than ``least`` rows give none. Only k rows of an
    entity leave each task (the window is limited before its shuffle)."""
    w = Window.partitionBy(entity).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    if least > 1:
        enough = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(F.col(entity).alias("_e"))
        out = out.join(enough, F.col(entity) == F.col("_e"), "left_semi")
    return out


def top_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``: each task keeps n, then those meet (a feature with a limit, not a cap on the data)."""
    return df.orderBy(*order).limit(n)


def largest_remainder(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole numbers in the proportion of ``shares`` with the given sum: floors, then one more by (largest remainder, name)."""
    whole = sum(shares.values())
    exact = {k: v / whole * total for k, v in shares.items()} if whole else dict.fromkeys(shares, 0.0)
    out = {k: int(x + 1e-9) for k, x in exact.items()}
    for k in sorted(shares, key=lambda k: (-(round(exact[k] - out[k], 9)), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def quotas(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``key, quota``: ``total`` shared out in proportion of ``n`` by largest remainder. ``counts`` has one row per category."""
    whole = counts.agg(F.sum(n).alias("_all"))
    exact = counts.join(F.broadcast(whole)).withColumn("_x", F.col(n) * F.lit(float(total)) / F.col("_all")).withColumn("_f", F.floor(F.col("_x") + 1e-9))
    missing = exact.agg((F.lit(total) - F.sum("_f")).alias("_m"))
    ranked = running(exact.withColumn("_d", -F.round(F.col("_x") - F.col("_f"), 9)), [], ["_d", key], F.lit(1), "_r")
    return ranked.join(F.broadcast(missing)).select(key, (F.col("_f") + (F.col("_r") < F.col("_m")).cast("long")).alias("quota"))


def holdout_entities(df: DataFrame, entity: str, k: int, seed: int) -> DataFrame:
    """Each row's ``split``: the k first entities in a seeded hash order are val, the others train; null entities are train."""
    chosen = df.select(entity).where(F.col(entity).isNotNull()).distinct().orderBy(hash_order(seed, F.col(entity)), entity).limit(k).withColumn("_v", F.lit(1))
    return attach_small(df, cut(chosen), [entity]).withColumn("split", F.when(F.col("_v") == 1, "val").otherwise("train")).drop("_v")


def fill_until(df: DataFrame, entity: str, row_order: list[str], target: int, seed: int) -> DataFrame:
    """Rows of entities in hash order until there are ``target``; the last entity may be cut, its other rows go nowhere."""
    sizes = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hash_order(seed, F.col(entity)))
    taken = cut(running(sizes, [], ["_h", entity], F.col("_n"), "_before").where(F.col("_before") < target))
    rows = attach_small(df, taken.select(entity, "_n", "_before"), [entity], "inner")
    whole = rows.where(F.col("_before") + F.col("_n") <= target)
    part = rows.where(F.col("_before") + F.col("_n") > target)
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(*row_order))).where((F.col("_before") + F.col("_r") <= target) & (F.col("_r") <= target)).drop("_r")
    return whole.unionByName(part).drop("_n", "_before")


def stratified(df: DataFrame, stratum: str, entity: str, row_order: list[str], target: int, seed: int) -> DataFrame:
    """About ``target`` rows with each stratum's share: its quota (halves to even) is filled by whole entities in hash order, the
    last one cut."""
    strata = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    whole = strata.agg(F.sum("_n").alias("_all"))
    quota = strata.join(F.broadcast(whole)).select(stratum, F.bround(F.col("_n") * F.lit(float(target)) / F.col("_all")).cast("long").alias("_q"))
    sizes = df.groupBy(stratum, entity).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hash_order(seed, F.col(entity)))
    taken = cut(running(sizes, [stratum], ["_h", entity], F.col("_n"), "_before").join(F.broadcast(cut(quota)), stratum).where(F.col("_before") < F.col("_q")))
    rows = attach_small(df, taken.select(stratum, entity, "_n", "_before", "_q"), [stratum, entity], "inner")
    fits = rows.where(F.col("_before") + F.col("_n") <= F.col("_q"))
    part = rows.where(F.col("_before") + F.col("_n") > F.col("_q"))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, entity).orderBy(*row_order))).where((F.col("_before") + F.col("_r") <= F.col("_q")) & (F.col("_r") <= target)).drop("_r")
    return fits.unionByName(part).drop("_n", "_before", "_q")


def resample(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement in proportion of ``weight``: ``draw, key``, by inverse cumulative weights and hashed uniforms.

    Draws are sorted into the ranges of cumulative weight by a join of ranges cut at the integers of the scaled sum, so none meets all.
    """
    w = df.select(key, weight.alias("_w")).where("_w > 0")
    total = w.agg(F.sum("_w")).first()[0]
    spark = df.sparkSession
    if not total:
        return spark.createDataFrame([], f"draw long, `{key}` {dict(df.dtypes)[key]}")
    cells = 4096
    spans = running(w, [], [key], F.col("_w"), "_lo").withColumn("_hi", F.col("_lo") + F.col("_w"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / total * cells), F.floor(F.col("_hi") / total * cells))))
    u = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    draws = spark.range(n).select(F.col("id").alias("draw"), (u * total).alias("_u")).withColumn("_cell", F.floor(F.col("_u") / total * cells))
    return draws.join(spans, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", key)


def preference_weight(df: DataFrame, score: str, how: str, out: str = "weight", power: float = 2.0) -> DataFrame:
    """Weight of each row for ``resample``: ``pow`` (a power of the score's size), ``max_min`` (1 for the best and worst of all rows, else 0)
    or ``max_random`` (0.4 for the best, else 0.1)."""
    if how == "pow":
        return df.withColumn(out, F.pow(F.abs(F.col(score)), power))
    if how not in ("max_min", "max_random"):
        raise ValueError(f"unknown rule {how}")
    with_ends = df.join(F.broadcast(df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))))  # one row
    best, worst = F.col(score) == F.col("_hi"), F.col(score) == F.col("_lo")
    weight = F.when(best | worst, 1.0).otherwise(0.0) if how == "max_min" else F.when(best, 0.4).otherwise(0.1)
    return with_ends.withColumn(out, weight).drop("_hi", "_lo")


def drawn(key: Column, share: float, seed: int) -> Column:
    """Whether a key is drawn, each with the chance ``share``: the same for all rows of a key, and again in every run of one seed."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13)) < share


def traced(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``traced``: all rows of ``k`` keys chosen by hash, or of all if there are fewer. Null keys are not traced."""
    order = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    chosen = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(order, key).limit(k).withColumn("traced", F.lit(True))
    return df.join(F.broadcast(chosen), key, "left").withColumn("traced", F.coalesce("traced", F.lit(False)))  # k rows


def smallest_of_kinds(df: DataFrame, entity: str, ordinal: str, kinds: str, k: int) -> DataFrame:
    """The ``k`` smallest ordinals of every set of ``kinds`` of an entity. Rows with one set are alike to any measure of the sets, so a
    choice of k rows by it, smallest ordinals at a tie, is among these; an entity keeps k rows per set, however many it has."""
    sets = df.withColumn(kinds, F.array_sort(F.array_distinct(kinds)))
    w = Window.partitionBy(entity, kinds).orderBy(ordinal)
    return sets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def diverse_pair(df: DataFrame, entity: str, ordinal: str, kinds: str) -> DataFrame:
    """``entity, overlap, i, j``: of each entity's pairs i < j the one that shares the fewest kinds, the smallest at a tie."""
    few = smallest_of_kinds(df, entity, ordinal, kinds, 2)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col(f"a.{entity}") == F.col(f"b.{entity}")) & (F.col(f"a.{ordinal}") < F.col(f"b.{ordinal}")))
    overlap = F.size(F.array_intersect(f"a.{kinds}", f"b.{kinds}"))
    scored = pairs.select(F.col(f"a.{entity}").alias(entity), F.struct(overlap.alias("overlap"), F.col(f"a.{ordinal}").alias("i"), F.col(f"b.{ordinal}").alias("j")).alias("s"))
    return scored.groupBy(entity).agg(F.min("s").alias("s")).select(entity, "s.*")


def round_robin(ordinal: Column, shards: int) -> Column:
    return F.pmod(ordinal, F.lit(shards))


__all__ = ["cap_ranked", "diverse_pair", "fill_until", "hash_order", "holdout_entities", "largest_remainder", "quotas", "resample", "round_robin", "smallest_of_kinds", "stratified", "top_rows"]
