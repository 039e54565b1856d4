"""Algebra of batches: order, slices, repeats, padding, chunks, folds and position-wise unions, on an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.scale import attach_small, cut, parted, running


def with_ordinal(df: DataFrame, order: list[str], name: str = "ord", by: list[str] = ()) -> DataFrame:
    """Consecutive ordinals 0, 1, ... in ``order`` (within ``by``), without one task for all rows or for a hot group."""
    return running(df, list(by), order, F.lit(1).cast("long"), name)


def take_slice(df: DataFrame, ordinal: str, start: int, stop: int, step: int = 1) -> DataFrame:
    o = F.col(ordinal)
    return df.where((o >= start) & (o < stop) & (F.pmod(o - start, F.lit(step)) == 0))


def take_indices(df: DataFrame, ordinal: str, indices: DataFrame, index: str = "index") -> DataFrame:
    """Rows at the given ordinals, in any order and as often as they are named (``indices``: ``pos, index``)."""
    return indices.join(df, indices[index] == df[ordinal]).drop(ordinal).withColumnRenamed("pos", ordinal).drop(index)


def inverse_permutation(perm: DataFrame) -> DataFrame:
    """``pos, index`` such that applying both permutations changes nothing."""
    return perm.select(F.col("index").alias("pos"), F.col("pos").alias("index"))


def repeat(df: DataFrame, ordinal: str, times: int | Column, interleave: bool = True, total: int | None = None) -> DataFrame:
    """Each row ``times`` times (a number or a column of counts; 0 drops the row). Copies follow their row, or with
    ``interleave=False`` whole copies of the batch of ``total`` rows follow each other."""
    n = F.lit(times) if isinstance(times, int) else times
    out = df.withColumn("_c", F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1))))
    if not isinstance(times, int):
        return out.withColumnRenamed("_c", "copy")
    new = F.col(ordinal) * times + F.col("_c") if interleave else F.col("_c") * total + F.col(ordinal)
    return out.withColumn(ordinal, new).withColumnRenamed("_c", "copy")


def pad_to_divisor(df: DataFrame, ordinal: str, total: int, divisor: int) -> DataFrame:
    """Leading rows repeated cyclically until the number of rows is divisible; ``is_pad`` marks them. No rows: none."""
    missing = -total % divisor
    if not total or not missing:
        return df.withColumn("is_pad", F.lit(False))
    rounds = -(-missing // total)
    extra = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_at", F.col("_k") * total + F.col(ordinal)).where(F.col("_at") < missing)
    extra = extra.withColumn(ordinal, F.col("_at") + total).drop("_k", "_at").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra)


def pad_with(df: DataFrame, ordinal: str, total: int, size: int, which: str) -> DataFrame:
    """Copies of the first or last row until there are ``size`` rows."""
    source = df.where(F.col(ordinal) == (0 if which == "first" else total - 1))
    extra = source.withColumn(ordinal, F.explode(F.sequence(F.lit(total).cast("long"), F.lit(size - 1).cast("long")))) if size > total else source.limit(0)
    return df.unionByName(extra)


def chunk_of(ordinal: Column, total: int, chunks: int) -> Column:
    """Chunk of a row when each chunk has ceil(total / chunks) rows but the last."""
    size = max(1, -(-total // chunks))
    return F.floor(ordinal / size)


def equal_chunk_of(ordinal: Column, total: int, chunks: int) -> Column:
    """Chunk of a row when sizes differ by at most one."""
    return F.floor(ordinal * chunks / max(1, total))


def fold(df: DataFrame, ordinal: str, k: int, columns: list[str]) -> DataFrame:
    """``k`` consecutive rows as one row of arrays (groups of bounded size)."""
    row = F.struct(F.col(ordinal), *columns)
    grouped = df.groupBy(F.floor(F.col(ordinal) / k).alias("_g")).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return grouped.select(F.col("_g").alias(ordinal), *[F.transform("_r", _field(c)).alias(c) for c in columns])


def _field(name: str):
    return lambda r: r[name]


def unfold(df: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """The inverse of ``fold`` for arrays of one length."""
    size = F.size(columns[0])
    out = df.select(ordinal, size.alias("_k"), F.posexplode(F.arrays_zip(*columns)).alias("_p", "_r"))
    return out.select((F.col(ordinal) * F.col("_k") + F.col("_p")).alias(ordinal), *[F.col(f"_r.{c}").alias(c) for c in columns])


def union_columns(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Columns of two batches side by side; a shared column must be equal row by row (NaN equals NaN, null equals null), else it fails."""
    shared = [c for c in a.columns if c in b.columns and c != ordinal]
    joined = a.join(b.select(ordinal, *[F.col(c).alias(f"_b_{c}" if c in shared else c) for c in b.columns if c != ordinal]), ordinal)
    for c in shared:
        same = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        joined = joined.withColumn(c, F.when(same, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs between the batches")).cast(dict(a.dtypes)[c])))
    return joined.drop(*[f"_b_{c}" for c in shared])


def concat(parts: list[DataFrame], meta: list[dict] | None = None) -> tuple[DataFrame, dict]:
    """All rows one after the other; meta entries of one name must agree, except lists under ``metrics``, which are joined."""
    out, merged = parts[0], {}
    for p in parts[1:]:
        out = out.unionByName(p)
    for m in meta or []:
        for k, v in m.items():
            if k == "metrics":
                merged.setdefault(k, []).extend(v if isinstance(v, list) else [v])
            elif k in merged and merged[k] != v:
                raise ValueError(f"meta entry {k} differs")
            else:
                merged[k] = v
    return out, merged


def minibatches(df: DataFrame, ordinal: str, total: int, size: int, epochs: int = 1) -> DataFrame:
    """``epoch, batch`` of every row; the size must divide the rows."""
    if size <= 0 or total % size:
        raise ValueError(f"{size} doesn't divide {total} rows")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(ordinal) / size))


def sampler_batches(df: DataFrame, key: str, total: int, size: int, seed: int | None = None, drop_last: bool = True) -> DataFrame:
    """Batches of an epoch in key order, or in the order of a seeded hash of the key; a last partial batch may be dropped."""
    order = [key] if seed is None else ["_h", key]
    hashed = df if seed is None else df.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    out = with_ordinal(hashed, order, "rank").drop("_h").withColumn("batch", F.floor(F.col("rank") / size))
    return out.where(F.col("batch") < total // size) if drop_last else out


def islands(df: DataFrame, order: list[str], label: str, by: list[str] = ()) -> DataFrame:
    """Runs of equal consecutive labels: adds ``run``, 0, 1, ... within ``by``, and ``at``, the row's place in its run.

    Ranges of rows are compared by themselves; the label before a range's first row comes from the ranges before it.
    """
    by = list(by)
    rows = parted(df, by, order)
    key = F.struct(*order)
    ends = rows.groupBy(*by, "_part").agg(F.max_by(F.struct(F.col(label).alias("l")), key).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_part")  # a row per range
    ends = cut(ends.withColumn("_prev", F.lag("_last").over(earlier)).drop("_last"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    own = F.struct(F.col(label).alias("l"))
    before = F.coalesce(F.lag(own).over(inside), F.col("_prev"))
    marked = attach_small(rows, ends, [*by, "_part"], null_safe=True).withColumn("_b", before)
    marked = marked.withColumn("_d", F.when(F.col("_b").isNull(), 0).otherwise((~F.col("_b.l").eqNullSafe(F.col(label))).cast("int"))).drop("_b", "_prev")
    out = running(marked, by, order, F.col("_d"), "run", is_parted=True).withColumn("run", F.col("run") + F.col("_d"))
    out = running(out, by, order, F.lit(1), "_ord", is_parted=True)
    keys = [*by, "run"]
    first = out.groupBy(*keys).agg(F.min("_ord").alias("_first")).withColumnsRenamed({c: f"_k_{c}" for c in keys})
    joined = out.join(first, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return joined.withColumn("at", F.col("_ord") - F.col("_first")).drop("_d", "_part", "_ord", "_first", *[f"_k_{c}" for c in keys])
