"""A cap on the records of each contributor, keeping the best, from mergeable quality histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import BROADCAST_ROWS, attach_small, cut, running, salted_join

#: Quality bins between 0 and 1; one more below them holds unknown quality.
BINS = 64


@dataclass
class Capped:
    """``report``: ``contributor, name, total, kept, lost`` of every contributor; ``kept``: the rows that stay."""

    report: DataFrame
    kept: DataFrame


def cap_contributors(rows: DataFrame, contributor: str, quality: str, ident: str, cap: int | None = None, share: float | None = None, name: str | None = None, bins: int = BINS) -> Capped:
    """Leave each contributor at most ``cap`` rows, or at most ``share`` of all rows, the highest ``quality`` first.

    Quality lies in 0 to 1; null or NaN counts as unknown, below every known one; values outside are taken as 0 or 1. Equal quality
    is decided by the smaller ``ident``, so repeated rows count each for itself; ``ident`` should be unique. Rows with a null
    contributor belong to nobody and are all kept. A cap of 0 keeps none of a contributor's rows. ``name`` is a column whose
    smallest value names the contributor in the report.

    Counts per contributor and quality bin are combined before they are shuffled; a window over a contributor's bins (not rows)
    gives the bin in which its cap is reached and so what it keeps and loses. Rows in better bins stay, rows in worse ones go, and only
    rows in that bin are ranked, over ranges of quality that are counted first. No task sees all of a contributor's rows, whatever the cap.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    if share is not None:
        cap = int(rows.count() * share + 1e-9)
    raw = F.col(quality).cast("double")
    q = F.when(F.isnan(raw), None).otherwise(raw)
    level = F.when(q.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).otherwise(F.lit(-1.0))
    place = F.when(F.col("__q") < 0, F.lit(-1)).otherwise(F.least(F.lit(bins - 1), F.floor(F.col("__q") * bins).cast("int")))
    keyed = rows.withColumn("__who", F.col(contributor)).withColumn("__q", level).withColumn("__bin", place)
    names = F.min(name) if name else F.lit(None).cast("string")
    histogram = keyed.where(F.col("__who").isNotNull()).groupBy("__who", "__bin").agg(F.count(F.lit(1)).alias("n"), names.alias("name"))
    better = F.coalesce(F.sum("n").over(Window.partitionBy("__who").orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = histogram.withColumn("better", better)
    # of a contributor beyond its cap, the bin in which the cap is reached and the places left in it
    over = cut(reached.where((F.col("better") <= cap) & (F.col("better") + F.col("n") > cap)).select("__who", F.col("__bin").alias("__cut"), F.col("better").alias("__better"), (cap - F.col("better")).alias("__left")))
    n_over = over.count()
    totals = reached.groupBy("__who").agg(F.min("name").alias("name"), F.sum("n").alias("total"))
    report = attach_small(totals, over, ["__who"], rows=n_over).select(F.col("__who").alias("contributor"), "name", "total", F.coalesce(F.col("__better") + F.col("__left"), "total").alias("kept")).withColumn("lost", F.col("total") - F.col("kept"))
    over = over.drop("__better")
    if n_over <= BROADCAST_ROWS:
        judged = keyed.join(F.broadcast(over), "__who", "left")
    else:
        judged = salted_join(keyed, over, ["__who"], F.col(ident))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    sure = judged.where(F.col("__cut").isNull() | (F.col("__bin") > F.col("__cut"))).select(*columns)
    border = judged.where(F.col("__bin") == F.col("__cut")).withColumn("__worse", -F.col("__q"))
    placed = running(border, ["__who"], ["__worse", ident], F.lit(1), "__r")
    return Capped(report, sure.unionByName(placed.where(F.col("__r") < F.col("__left")).select(*columns)))
