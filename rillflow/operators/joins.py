"""Joins with a meaning of their own: stamps, unique keys, places inside arrays, greedy attachment, leak checks, unions of results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut


def stamp(rows: DataFrame, key: str, stats: DataFrame, value: str, count: str, rate: str, band) -> DataFrame:
    """Rows with ``rate`` and ``band`` of their key's pooled counts where there are any; other rows keep what they had.

    ``stats`` (``key, count, value``) may have several rows per key; they are summed before the join.
    """
    pooled = cut(stats.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(count).alias("_n"), F.sum(value).alias("_c")).where("_n > 0"))
    joined = attach_small(rows, pooled, [key])
    new = F.col("_c") / F.col("_n")
    return joined.withColumns({rate: F.coalesce(new, F.col(rate)), "band": F.coalesce(band(new), F.col("band"))}).drop("_n", "_c")


def unique_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on keys that occur once on each side; a key seen twice on a side is dropped from both."""
    def once(df: DataFrame) -> DataFrame:
        single = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns if c != key])
        return single.where("_n = 1").drop("_n")
    return once(a.where(F.col(key).isNotNull())).join(once(b.where(F.col(key).isNotNull())), key)


def repoint(rows: DataFrame, ident: str, array: str, field: str, moved: DataFrame) -> DataFrame:
    """Paths in an array of structs replaced by ``moved.target`` where ``moved.path`` names them; order and other fields stay.

    Only the paths travel: they are joined by themselves and come back as a map per row.
    """
    paths = rows.select(ident, F.explode(F.transform(array, lambda s: s[field])).alias("path"))
    hits = paths.join(moved.select("path", "target"), "path").groupBy(ident).agg(F.map_from_entries(F.collect_set(F.struct("path", "target"))).alias("_m"))
    joined = rows.join(hits, ident, "left")
    new = F.transform(array, lambda s: s.withField(field, F.coalesce(F.try_element_at(F.col("_m"), s[field]), s[field])))
    return joined.withColumn(array, new).drop("_m")


def attach_greedy(candidates: DataFrame, specs: DataFrame, group: str) -> DataFrame:
    """``group, pos, spec``: each candidate (``group, pos, spec_id``), in order of ``pos``, takes the spec of its id if it is free, else
    the free spec at its own place, else none. ``specs``: ``group, place, spec``; ``spec`` is unique in its group.

    Order matters, so rows are sorted by group, its specs first, and streamed through; only one group's specs are held at a time.
    """
    both = candidates.select(group, F.lit(1).alias("side"), F.col("pos").cast("long").alias("at"), F.col("spec_id").cast("double").alias("spec")).unionByName(
        specs.select(group, F.lit(0).alias("side"), F.col("place").cast("long").alias("at"), F.col("spec").cast("double").alias("spec"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, by_place, free = None, {}, set()
        for batch in batches:
            out = []
            for key, side, at, spec in zip(*(batch[c].tolist() for c in (group, "side", "at", "spec"))):
                if key != name:
                    name, by_place, free = key, {}, set()
                if side == 0:
                    by_place[at] = spec
                    free.add(spec)
                    continue
                pick = spec if spec in free else by_place.get(at)
                if pick in free:
                    free.discard(pick)
                    out.append((key, at, int(pick)))
            yield pd.DataFrame(out, columns=[group, "pos", "spec"])

    ordered = both.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, "side", "at")
    return ordered.mapInPandas(run, f"`{group}` {dict(candidates.dtypes)[group]}, pos long, spec long")


def dropped_tokens(drops: DataFrame, sampled: DataFrame, key: str, position: str, token: str, top: str) -> DataFrame:
    """What was dropped beside what was sampled there: ``drops`` (``key, position``) with the sampled ``token``, and ``rank``, its place from 1
    among the likeliest tokens ``top`` of that position (0: not among them). Positions without a sample are left out."""
    return drops.select(key, position).join(sampled, [key, position]).withColumn("rank", F.array_position(top, F.col(token)).cast("int"))


def leaks(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` has too; nulls leak nothing."""
    return a.select(key).where(F.col(key).isNotNull()).distinct().join(b.select(key), key, "left_semi")


def differing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side`` of keys that only one side has."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of two result tables; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def last_of_session(df: DataFrame, session: list[str], order: str, value: str, out: str) -> DataFrame:
    """Every row with the value that its session's last row has."""
    last = df.groupBy(*session).agg(F.max_by(value, order).alias(out))
    return df.join(last, session)


def gated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reason``, the first rule that holds (null: none), and ``reasons``, all of them, in the rules' order. A null rule doesn't hold."""
    every = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("reasons", every).withColumn("reason", F.when(F.size("reasons") > 0, F.col("reasons")[0]))
