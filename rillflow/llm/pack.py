"""Containers of fixed capacity filled with items of varying length, by minimum bin slack over the lengths' histogram."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.scale import BROADCAST_ROWS, cut, ranked

#: Units of length in which a container is planned: the driver holds one counter per unit, whatever the number of items. Larger capacities
#: are planned in units of several tokens, to which lengths are rounded up.
UNITS = 1 << 20


@dataclass
class Pattern:
    """``times`` containers, the first of them ``base``, that each hold ``parts``: (length, uses in a container, first slot of that length)."""

    base: int
    times: int
    parts: list[tuple[int, int, int]]


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of remaining lengths (descending ``lengths``) whose sum comes closest to ``room`` from below.

    Bit s of ``reach`` says that the lengths so far can sum to s. A length's count enters in parts of 1, 2, 4, ... uses; the states
    before each part are kept, and the found sum is traced back through them.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    states: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:
            use = min(part, left)
            states.append((reach, length, use))
            reach |= (reach << (length * use)) & mask
            left, part = left - use, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, use in reversed(states):
        if not before >> at & 1:
            at -= length * use
            used[length] = used.get(length, 0) + use
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for ``histogram`` (count per length, 1 to ``capacity``): the largest length left opens a container, ``fill`` closes
    it, and the same content is repeated while the lengths last, so the work follows the distinct lengths and not the items."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, slots, base, out = sorted(counts, reverse=True), dict.fromkeys(counts, 0), 0, []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fill(lengths, counts, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[n] // c for n, c in used.items())
        out.append(Pattern(base, times, [(n, c, slots[n]) for n, c in sorted(used.items(), reverse=True)]))
        for n, c in used.items():
            counts[n] -= c * times
            slots[n] += c * times
        base += times
        lengths = [n for n in lengths if counts[n]]
    return out


def pack(sizes: DataFrame, ident: str, size: str, capacities: DataFrame) -> DataFrame:
    """``pack_name, container_id, ident, piece, start, size`` for every item and capacity (``pack_name, capacity``).

    An item larger than the capacity is cut into full pieces and a rest, in order; no other item is cut. Items whose size is null
    or not positive take no room and are in no container. Capacities that are null or not positive are left out, repeated pack
    names count once with the largest. Repeated items are placed each for itself. No items: no containers.

    Only the count of each length (at most ``UNITS`` numbers) reaches the driver, which plans containers as patterns of lengths;
    each item then finds its container by its rank among the items of its length, taken without putting a length into one task. The
    patterns are broadcast up to ``BROADCAST_ROWS`` rows and joined beyond.
    """
    packs = {r["pack_name"]: r["capacity"] for r in capacities.where("capacity > 0 and pack_name is not null").groupBy("pack_name").agg(F.max("capacity").alias("capacity")).collect()}
    spark = sizes.sparkSession
    result = f"pack_name string, container_id long, `{ident}` {dict(sizes.dtypes)[ident]}, piece long, start long, `{size}` long"
    if not packs:
        return spark.createDataFrame([], result)
    names = sorted(packs)
    unit = [-(-packs[n] // UNITS) for n in names]
    listed = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(packs[n]).cast("long").alias("cap"), F.lit(u).cast("long").alias("unit")) for i, (n, u) in enumerate(zip(names, unit))])
    whole = sizes.select(F.col(ident).alias("_id"), F.col(size).cast("long").alias("_n")).where("_n > 0").withColumn("_p", F.explode(listed)).select("_id", "_n", "_p.*")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("cap")))))
    items = pieces.withColumn("start", F.col("piece") * F.col("cap")).withColumn("size", F.least("cap", F.col("_n") - F.col("start")))
    items = items.withColumn("n", F.least(F.ceil(F.col("size") / F.col("unit")), F.floor(F.col("cap") / F.col("unit")))).select("pack", "_id", "piece", "start", "size", "n")
    histograms: dict[int, dict[int, int]] = {i: {} for i in range(len(names))}
    for r in items.groupBy("pack", "n").agg(F.count(F.lit(1)).alias("c")).collect():
        histograms[r["pack"]][r["n"]] = r["c"]
    rows = [(i, n, start, c, p.base) for i, h in histograms.items() for p in plan(h, packs[names[i]] // unit[i]) for n, c, start in p.parts]
    placed = ranked(items.withColumn("item", F.struct("_id", "piece")), ["pack", "n"], "item", "slot").select("pack", "_id", "piece", "start", "size", "n", "slot")
    kind = dict(sizes.dtypes)[ident]
    if len(rows) <= BROADCAST_ROWS:
        shared = spark.sparkContext.broadcast(np.array(sorted(rows), dtype=np.int64).reshape(-1, 5))
        found = placed.mapInArrow(_place(shared), f"pack long, container_id long, _id {kind}, piece long, start long, size long")
    else:
        table = cut(spark.createDataFrame(rows, "pack int, n long, first long, uses long, base long").groupBy("pack", "n").agg(F.array_sort(F.collect_list(F.struct("first", "uses", "base"))).alias("parts")))
        joined = placed.join(table, ["pack", "n"])
        part = F.element_at(F.filter("parts", lambda x: x["first"] <= F.col("slot")), -1)
        found = joined.withColumn("p", part).select(F.col("pack").cast("long"), (F.col("p.base") + F.floor((F.col("slot") - F.col("p.first")) / F.col("p.uses"))).alias("container_id"), "_id", "piece", "start", "size")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("pack") + 1).cast("int"))
    return found.select(named.alias("pack_name"), "container_id", F.col("_id").alias(ident), "piece", "start", F.col("size").alias(size))


def _place(shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_ = shared.value
        key = plan_[:, 0] * (UNITS + 1) + plan_[:, 1]
        firsts, begins = np.unique(key, return_index=True)
        ends = np.append(begins[1:], len(key))
        for batch in batches:
            pack_ = batch["pack"].to_numpy().astype(np.int64)
            wanted, slot = pack_ * (UNITS + 1) + batch["n"].to_numpy(), batch["slot"].to_numpy()
            low = begins[np.searchsorted(firsts, wanted)]
            high = ends[np.searchsorted(firsts, wanted)]
            while (high - low > 1).any():  # the last pattern of this length that starts at or before the slot
                middle = (low + high) // 2
                right = plan_[middle, 2] <= slot
                low, high = np.where(right & (high - low > 1), middle, low), np.where(right | (high - low <= 1), high, middle)
            container = plan_[low, 4] + (slot - plan_[low, 2]) // plan_[low, 3]
            yield pa.record_batch({"pack": pa.array(pack_), "container_id": pa.array(container), **{c: batch[c] for c in ("_id", "piece", "start", "size")}})

    return run


def fill_report(placed: DataFrame, size: str, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, items, tokens and the share of room that they fill."""
    held = placed.groupBy("pack_name", "container_id").agg(F.sum(size).alias("held"), F.count(F.lit(1)).alias("items"))
    out = held.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("held").alias("tokens"), F.max("held").alias("fullest"))
    caps = capacities.groupBy("pack_name").agg(F.max("capacity").alias("capacity"))
    return out.join(caps, "pack_name").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
