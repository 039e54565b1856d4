"""Helpers that keep plans safe at any size: lineage cuts, checked broadcasts, skew-proof ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a narrow side may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 400_000
#: Parts into which one key's rows are spread before they are ranked.
SHARDS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names in spark.checkpoint.dir. Where it names none, a local session (as in tests) gets a folder
    that goes with the process; on a cluster it is an error, as executors would not share it."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="rillflow-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def attach_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None, limit: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Join a narrow table to a large one without moving the large one when the narrow one is proven small.

    The narrow side is counted (pass ``rows`` where the count is known). Up to ``limit`` rows it is broadcast; beyond, the join
    is a shuffled one that adaptive execution may split. ``small`` should be a checkpointed table, as it is read twice. With
    ``null_safe`` a null key meets a null key.
    """
    n = small.count() if rows is None else rows
    keys: list = on
    if null_safe:
        small = small.withColumnsRenamed({c: f"__on_{c}" for c in on})
        keys = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    out = big.join(F.broadcast(small) if n <= limit else small.hint("merge"), keys, how)
    return out.drop(*[f"__on_{c}" for c in on]) if null_safe else out


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """A shuffled join whose hot keys are spread: rows of ``big`` by a salt, rows of ``small`` copied once per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, keys: list[str], ident: str, name: str = "rank", shards: int = SHARDS) -> DataFrame:
    """An exact rank 0, 1, ... within ``keys``, in an order given by a hash of ``ident``, without putting a key into one task.

    Every key's rows are spread over shards by hash; a shard's rows are ranked by themselves and start at the number of rows in
    the shards before. ``keys`` and ``ident`` must not be null; ``ident`` must be unique for the result to be repeatable.
    """
    sharded = df.withColumn("_shard", F.pmod(F.xxhash64(ident), F.lit(shards)).cast("int"))
    starts = (
        sharded.groupBy(*keys, "_shard").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_shard", F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(F.xxhash64(F.col(ident), F.lit(1)), F.col(ident)))
    return sharded.withColumn("_local", local - 1).join(starts, [*keys, "_shard"]).withColumn(name, F.col("_start") + F.col("_local")).drop("_shard", "_local", "_start")


def parted(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows in ranges of (``by``, ``order``), with the number of their range as ``_part``; ranges follow each other in that order."""
    return cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, is_parted: bool = False) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row in ``order`` within ``by`` (all rows for an empty ``by``).

    ``order`` should be total, else equal rows follow each other in any order. Ranges are summed first and each is accumulated by
    itself, so neither the whole table nor a hot group is ordered in one task.
    """
    rows = (df if is_parted else parted(df, by, order)).withColumn("__v", value)
    sums = rows.groupBy(*by, "_part").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = cut(sums.withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = attach_small(rows.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0))), starts, [*by, "_part"], null_safe=True)
    return out.withColumn(name, F.col("__start") + F.col("__in")).drop("__v", "__in", "__start", *([] if is_parted else ["_part"]))


def previous(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``value`` of the row before each row in ``order`` within ``by`` (all rows for an empty ``by``); null for the first.

    Ranges look inside themselves; only each range's last row is carried over, so no task orders the whole table or a hot group."""
    rows = parted(df, by, order)
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    last = rows.groupBy(*by, "_part").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_part")  # a row per range
    carried = cut(last.withColumn("_carried", F.lag("_last").over(earlier)).drop("_last"))
    own = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    both = attach_small(rows.withColumn("_own", own), carried, [*by, "_part"], null_safe=True)
    return both.withColumn(name, F.coalesce("_own", "_carried")["v"]).drop("_own", "_carried", "_part")
