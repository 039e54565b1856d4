"""Splits in which related records stay together, near the wanted shares overall and per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut

#: Groups with more than this share of the rows are placed one by one; there are at most 1 / HEAVY of them.
HEAVY = 0.001
#: Ranges into which a source's hash space is counted.
CELLS = 4096


def assign_splits(rows: DataFrame, group: str, source: str, ident: str, targets: list[tuple[str, float]], seed: int = 42, heavy: float = HEAVY) -> DataFrame:
    """``ident, group, source, assigned`` for every row; rows of one ``group`` have one split.

    ``group`` names a connected component. A null group is a group of the one row; a null source counts as a source of its own.
    ``targets`` are (split, share) with shares that are brought to a sum of 1; a share of 0 gets nothing but what must go somewhere.
    Repeated rows are assigned alike. No rows: no assignments.

    A group's home is the source with most of its rows. Groups above the share ``heavy`` of all rows (at most 1 / ``heavy``) are placed
    first, each where it leaves the least squared excess overall and in its home. Every other group falls into a cell by the hash of its
    name, and each home's cells are cut into ranges whose rows, counted beforehand, have the shares still wanted there. With ``heavy`` = 1
    ranges alone decide, and a split may be off by the largest group. Only counts move, apart from the rows' own projection.
    """
    whole = sum(s for _, s in targets)
    shares = [(k, s / whole) for k, s in targets]
    own = F.concat(F.lit("\x00row:"), F.coalesce(F.col(ident).cast("string"), F.lit("null")))
    light = rows.select(F.col(ident).alias("__id"), F.coalesce(F.col(group).cast("string"), own).alias("__group"), F.col(source).cast("string").alias("__source"))
    names, ident, group, source = (ident, group, source), "__id", "__group", "__source"
    sizes = light.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    groups = cut(sizes.groupBy(group).agg(F.sum("n").alias("n"), F.max_by(F.struct(F.col(source).alias("home")), F.struct("n", F.xxhash64(source))).alias("h")).select(group, "n", "h.home"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = groups.where(F.col("n") > max(1.0, heavy * total)).orderBy(F.desc("n"), group).collect()
    homes_of_large = {r["home"] for r in large}
    at_home = F.col("home").isin([h for h in homes_of_large if h is not None]) | (F.col("home").isNull() if None in homes_of_large else F.lit(False))
    by_home = {r["home"]: r["n"] for r in groups.where(at_home).groupBy("home").agg(F.sum("n").alias("n")).collect()} if large else {}
    load: dict = {}
    placed = []
    for r in large:
        def excess(k: str, share: float) -> tuple:
            at, here = load.get((None, k), 0) + r["n"], load.get(((r["home"],), k), 0) + r["n"]
            return (max(0, at - share * total) + max(0, here - share * by_home[r["home"]]), -share)
        k = min(shares, key=lambda t: (*excess(*t), t[0]))[0]
        placed.append((r[group], k))
        for key in ((None, k), ((r["home"],), k)):
            load[key] = load.get(key, 0) + r["n"]
    spark = rows.sparkSession
    schema = f"`{group}` string, _placed string"
    by_hand = spark.createDataFrame(placed, schema)
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(CELLS))
    rest = groups.join(F.broadcast(by_hand), group, "left").withColumn("_cell", cell)
    cells = rest.where("_placed is null").groupBy("home", "_cell").agg(F.sum("n").alias("n"))
    left = [(where[0], k, float(n)) for (where, k), n in load.items() if where is not None]
    used = spark.createDataFrame(left, "home string, split string, used double")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("split"), F.lit(s).alias("share")) for i, (k, s) in enumerate(shares)])
    homes = groups.groupBy("home").agg(F.sum("n").alias("all"))
    # what each home still wants of each split, as ranges of its remaining rows
    need = homes.withColumn("w", F.explode(wanted)).select("home", "all", "w.*")
    need = need.join(F.broadcast(used), need["home"].eqNullSafe(used["home"]) & (need["split"] == used["split"]), "left").select(need["home"], "i", need["split"], F.greatest(F.lit(0.0), F.col("share") * F.col("all") - F.coalesce("used", F.lit(0.0))).alias("need"))
    home = Window.partitionBy("home")
    upto = F.sum("need").over(home.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ends = need.withColumn("end", upto / F.nullif(F.sum("need").over(home), F.lit(0.0))).groupBy("home").agg(F.array_sort(F.collect_list(F.struct("i", "end", "split"))).alias("ends"))
    middle = (F.sum("n").over(home.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") / 2) / F.sum("n").over(home)
    placed_cells = cells.withColumn("at", middle)
    hit = F.element_at(F.filter("ends", lambda e: e["end"] > F.col("at")), 1)["split"]
    chosen = placed_cells.join(ends, placed_cells["home"].eqNullSafe(ends["home"])).select(placed_cells["home"], "_cell", F.coalesce(hit, F.lit(shares[-1][0])).alias("_chosen"))
    chosen = cut(chosen)
    decided = rest.join(chosen, rest["home"].eqNullSafe(chosen["home"]) & (rest["_cell"] == chosen["_cell"]), "left").select(group, F.coalesce("_placed", "_chosen").alias("assigned"))
    decided = cut(decided)
    out = attach_small(light, decided, [group])
    return out.select(*[F.col(c).alias(n) for c, n in zip((ident, group, source), names)], "assigned")
