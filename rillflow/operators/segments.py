"""Shots of a timeline: long ones cut into equal parts, short ones merged with what follows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.numeric import round_exact


def split_long(shots: Column, most: float) -> Column:
    """Shots longer than ``most`` in floor(length / most) + 1 equal parts with bounds of two decimals."""
    def parts(s: Column) -> Column:
        n = F.when(s["end"] - s["start"] > most, F.floor((s["end"] - s["start"]) / most) + 1).otherwise(1).cast("int")
        bound = lambda k: F.when(k == 0, s["start"]).when(k == n, s["end"]).otherwise(round_exact(s["start"] + (s["end"] - s["start"]) * k / n))
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(bound(k - 1).alias("start"), bound(k).alias("end")))
    return F.flatten(F.transform(shots, parts))


def _merge(rows, least: float) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for s in rows:
        if out and out[-1][1] - out[-1][0] < least:
            out[-1][1] = s["end"]
        else:
            out.append([s["start"], s["end"]])
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        _, end = out.pop()
        out[-1][1] = end
    return [(a, b) for a, b in out]


def split_and_merge(df: DataFrame, keys: list[str], shots: str, most: float, least: float) -> DataFrame:
    """``keys, start, end``: shots split, then one under ``least`` takes those that follow until it is long enough; a short tail joins
    the one before.

    What follows depends on what was merged, so timelines pass a Python function whole, in Arrow batches; empty ones have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [(*row[:-1], a, b) for row in part.itertuples(index=False, name=None) for a, b in _merge(row[-1], least)]
            yield pd.DataFrame(found, columns=[*keys, "start", "end"])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start double, end double"
    return df.select(*keys, split_long(F.col(shots), most).alias("_s")).mapInPandas(run, schema)
