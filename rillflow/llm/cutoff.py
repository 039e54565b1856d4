"""Score cutoffs that keep a target share of each source, by iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut

#: Bins of one round.
BINS = 512


def score_cutoffs(rows: DataFrame, source: Column, score: Column, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """Per source of ``targets`` (``source, target``): ``source, target, cutoff, known, kept, share``.

    A cutoff keeps the rows of its source whose score is at or below it; of all cutoffs, keeping none (null cutoff) and all
    included, the one whose share of the source's scored rows is nearest to the target is returned, the smaller at a tie.
    Rows with a null source or a null, NaN or infinite score count nowhere. A source without scored rows has null cutoff and share and 0
    rows; a null or NaN target likewise keeps its counts with null cutoff and share. Targets beyond 0 and 1 mean 0 and 1; null
    sources of ``targets`` are left out, and of repeated ones the largest target counts.

    Each round counts every open source's scores into equal bins between the least and greatest score still in question and zooms
    into the bin that holds the target rank, until that bin has one value. Only counters move (sources x bins, combined before
    they are shuffled), so a source that holds most rows costs no more than others; the state of a round is a table of one row per
    source, of which the driver sees the number. One value's ties are one bin by nature.
    """
    target = F.col("target").cast("double")
    wanted = cut(targets.select("source", F.when(~F.isnan(target), target).alias("goal"), target.alias("target")).where("source is not null").groupBy("source").agg(F.max("goal").alias("goal"), F.max("target").alias("target")))
    n_wanted = wanted.count()
    scored = rows.select(source.alias("source"), score.cast("double").alias("score")).where(F.col("source").isNotNull() & (F.abs("score") < float("inf")))
    totals = attach_small(scored, wanted.select("source", "goal"), ["source"], "inner", rows=n_wanted).groupBy("source").agg(F.count(F.lit(1)).alias("known"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    # below: the rows under the range still in question; previous: the greatest score among them; inside: the rows in the range
    rank = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("goal"))) * F.col("known")
    start = wanted.join(totals, "source", "left").withColumns({"rank": rank, "below": F.lit(0).cast("long"), "previous": F.lit(None).cast("double"), "inside": F.col("known")})
    state = cut(start)
    held = ["source", "lo", "hi", "rank", "below", "previous"]
    while n_open := state.where("lo < hi and rank is not null").count():
        opened = state.where("lo < hi and rank is not null")
        half = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.5).otherwise(1.0)  # so that no difference overflows
        place = F.least(F.lit(bins - 1), F.floor((F.col("score") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half) * bins).cast("int"))
        histogram = attach_small(scored, opened.select(*held), ["source"], "inner", rows=n_open).where("score between lo and hi").groupBy("source", place.alias("bin"))
        counted = histogram.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
        ordered = Window.partitionBy("source").orderBy("bin")  # at most ``bins`` rows
        summed = attach_small(counted, opened.select(*held), ["source"], "inner", rows=n_open).withColumns({
            "under": F.col("below") + F.sum("n").over(ordered) - F.col("n"), "last": F.lead("bin").over(ordered).isNull(), "before": F.coalesce(F.lag("most").over(ordered), "previous"),
        })
        hit = summed.where((F.col("under") + F.col("n") >= F.col("rank") - 1e-9) | F.col("last")).groupBy("source").agg(F.min_by(F.struct("least", "most", "under", "before", "n"), "bin").alias("z")).select("source", "z.*")
        zoomed = attach_small(state, hit, ["source"], rows=n_open)
        news = {"lo": "least", "hi": "most", "below": "under", "previous": "before", "inside": "n"}
        fresh = F.col("n").isNotNull()
        state = cut(zoomed.withColumns({a: F.when(fresh, F.col(b)).otherwise(F.col(a)) for a, b in news.items()}).select(*state.columns))
    upto, share = F.col("below") + F.col("inside"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("goal")))
    nearer = F.abs(upto / F.col("known") - share) < F.abs(F.col("below") / F.col("known") - share) - 1e-12
    kept = F.when(F.col("rank").isNull(), F.lit(0)).when(nearer, upto).otherwise(F.col("below"))
    cutoff = F.when(F.col("rank").isNotNull(), F.when(nearer, F.col("lo")).otherwise(F.col("previous")))
    settled = state.select("source", "target", cutoff.alias("cutoff"), F.coalesce("known", F.lit(0)).alias("known"), kept.cast("long").alias("kept"), "rank")
    return settled.withColumn("share", F.when(F.col("rank").isNotNull(), F.col("kept") / F.col("known"))).drop("rank")
