"""Batches balanced over workers: differencing and greedy partitions, micro-batches, and their order.

A batch is handled by one task (its rows are a bounded number, the batch size); batches are independent and run in parallel.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(weights: list[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Indices in ``k`` parts of nearly equal weight by the largest differencing method.

    Every item starts as a solution of its own (with ``equal_size``, every k items of neighbouring weight, one for each part; the
    count must divide). The two solutions of largest spread are joined, heaviest part with lightest, until one is left.
    Parts come in ascending order of their first index; with fewer items than parts some stay empty.
    """
    if k <= 0:
        raise ValueError("a positive number of parts is needed")
    order = sorted(range(len(weights)), key=lambda i: (weights[i], i))
    if equal_size:
        if len(weights) % k:
            raise ValueError(f"{len(weights)} items don't divide into {k} parts of equal size")
        seeds = [[(weights[i], [i]) for i in order[a : a + k]] for a in range(0, len(order), k)]
    else:
        seeds = [[(weights[i], [i])] + [(0, [])] * (k - 1) for i in order]
    tick = itertools.count()
    heap = []
    for parts in seeds:
        parts = sorted(parts, key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], next(tick), parts))
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda p: -p[0])
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], next(tick), parts))
    found = [sorted(ids) for _, ids in heap[0][2]] if heap else [[] for _ in range(k)]
    return sorted(found, key=lambda ids: (not ids, ids[:1]))


def greedy(weights: list[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Items in their order, each to the part of least weight so far (with ``equal_size``, among those that aren't full)."""
    room = -(-len(weights) // k) if equal_size else len(weights)
    parts, sums = [[] for _ in range(k)], [0.0] * k
    for i, w in enumerate(weights):
        p = min((j for j in range(k) if len(parts[j]) < room), key=lambda j: (sums[j], j))
        parts[p].append(i)
        sums[p] += w
    return parts


def micro_batches(lengths: list[int], most: int, at_least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Micro-batches of about ``most`` tokens: ceil(sum / most) of them, at least ``at_least``, a multiple of ``multiple``, at most one
    per item; balanced by workload and ordered so that the lightest stand at both ends."""
    if any(n > most for n in lengths):
        raise ValueError(f"a sequence is longer than {most}")
    k = max(at_least, -(-sum(lengths) // most))
    k = min(len(lengths), -(-k // multiple) * multiple)
    load = [24_576 * n + n * n for n in lengths]
    parts = [p for p in differencing(load, k) if p] if k else []
    parts.sort(key=lambda p: (-sum(load[i] for i in p), p[0]))
    return zigzag(parts)


def zigzag(parts: list) -> list:
    """Items of a descending list with the small ones at both ends and the large ones in the middle."""
    return parts[::2][::-1] + parts[1::2]


def grouped_parts(uids: list, weights: list[float], k: int) -> list[list[int]]:
    """Parts in which the neighbouring rows of one uid stay together and every part has as many groups."""
    runs = [[i for i, _ in g] for _, g in itertools.groupby(enumerate(uids), key=lambda t: t[1])]
    found = differencing([sum(weights[i] for i in run) for run in runs], k, equal_size=len(runs) % k == 0)
    return [[i for r in part for i in runs[r]] for part in found]


def check_parts(parts: list[list[int]], n: int, may_be_empty: bool = False) -> None:
    """Parts must cover 0 to n - 1 once, none empty; else an error."""
    if sorted(itertools.chain(*parts)) != list(range(n)):
        raise ValueError("the parts don't cover every item once")
    if not may_be_empty and not all(parts):
        raise ValueError("a part is empty")


_METHODS = {"differencing": differencing, "greedy": greedy, "equal": lambda w, k: differencing(w, k, True)}


def by_batch(df: DataFrame, batch: str, order: str, needed: list[str], place: Callable[..., dict[str, np.ndarray]], added: str) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``place`` gives for the ``needed`` columns of each batch, in ``order``.

    Batches are dealt to tasks whole and follow each other there, so a call of Python costs a group of many batches and not one."""
    names = [c.split()[0] for c in added.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in itertools.chain(frames, [None]):
            held = rest if frame is None else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if held is None or not len(held):
                rest = held
                continue
            key = held[batch].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            ends = [*cuts, len(held)] if frame is None else list(cuts)
            if not ends:
                rest = held
                continue
            done, starts = held.iloc[: ends[-1]], [0, *ends[:-1]]
            columns = [done[c].to_numpy() for c in needed]
            found = [place(*[c[a:b] for c in columns]) for a, b in zip(starts, ends)]
            yield done.assign(**{n: np.concatenate([f[n] for f in found]) for n in names})
            rest = held.iloc[ends[-1] :].reset_index(drop=True)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col(batch).isNotNull()).repartition(batch).sortWithinPartitions(batch, order).mapInPandas(run, f"{kinds}, {added}")


def balance(df: DataFrame, batch: str, order: str, weight: str, k: int, method: str = "differencing") -> DataFrame:
    """``df`` with ``part`` and ``at``: its part in its batch and its place after the batch is reordered part by part.

    Null weights count as 0. A part's rows stand in ascending zig-zag of weight: light ones at both ends. Rows of no batch are left out.
    """
    split = _METHODS[method]

    def place(weight: np.ndarray) -> dict[str, np.ndarray]:
        weights = np.nan_to_num(weight.astype(float)).tolist()
        parts = split(weights, k)
        check_parts(parts, len(weights), may_be_empty=True)
        part, at, n = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64), 0
        for p, ids in enumerate(parts):
            for i in zigzag(sorted(ids, key=lambda i: (-weights[i], i))):
                part[i], at[i], n = p, n, n + 1
        return {"part": part, "at": at}

    return by_batch(df, batch, order, [weight], place, "part long, at long")


def restored(df: DataFrame, batch: str, order: str) -> DataFrame:
    """Rows of batches that stand in the order ``at`` put back by the inverse of the permutation that moved them: ``batch``, ``pos`` (the
    place in the batch before it was balanced) and the row's other columns. ``order`` counts within a batch from 0."""
    moved = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*[c for c in df.columns if c not in (batch, "at")]).alias("row")))).alias("rows"))
    came = F.transform("rows", lambda r: r["row"][order])  # the row now at i came from came[i]
    inverse = F.transform(came, lambda _, i: F.array_position(came, i.cast(df.schema[order].dataType)) - 1)
    return moved.select(batch, F.posexplode(F.transform(inverse, lambda i: F.get("rows", i.cast("int"))["row"])).alias("pos", "row")).select(batch, "pos", "row.*")


def micro_batched(df: DataFrame, batch: str, order: str, length: str, most: int, at_least: int = 1, multiple: int = 1) -> DataFrame:
    """``df`` with ``micro``, the micro-batch of its batch (see ``micro_batches``), and ``within``, its place there."""
    def place(length: np.ndarray) -> dict[str, np.ndarray]:
        micro, within = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for p, ids in enumerate(micro_batches(length.astype(int).tolist(), most, at_least, multiple)):
            micro[ids], within[ids] = p, np.arange(len(ids))
        return {"micro": micro, "within": within}

    return by_batch(df, batch, order, [length], place, "micro long, within long")


def grouped(df: DataFrame, batch: str, order: str, uid: str, weight: str, k: int) -> DataFrame:
    """``df`` with ``part``: neighbouring rows of one uid stay together (see ``grouped_parts``)."""
    def place(uid: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        part = np.zeros(len(uid), np.int64)
        for p, ids in enumerate(grouped_parts(uid.tolist(), weight.astype(float).tolist(), k)):
            part[ids] = p
        return {"part": part}

    return by_batch(df, batch, order, [uid, weight], place, "part long")


def balance_report(df: DataFrame, batch: str, order: str, weight: str, k: int) -> DataFrame:
    """Per batch: least and greatest part before (equal runs of rows) and after balancing."""
    before = df.withColumn("_run", F.floor(F.col(order) % F.count(F.lit(1)).over(_of(batch)) * k / F.count(F.lit(1)).over(_of(batch))))
    old = before.groupBy(batch, "_run").agg(F.sum(weight).alias("s")).groupBy(batch).agg((F.max("s") - F.min("s")).alias("spread_before"))
    new = balance(df, batch, order, weight, k).groupBy(batch, "part").agg(F.sum(weight).alias("s")).groupBy(batch).agg((F.max("s") - F.min("s")).alias("spread_after"))
    return old.join(new, batch)


def _of(batch: str):
    from pyspark.sql import Window

    return Window.partitionBy(batch)
