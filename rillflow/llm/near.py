"""Near messages within a video: a multi-index join over b-bit minwise signatures, exact Jaccard similarity of word bags after it.

A message is the bag of its words (or of its shingles of ``shingle`` words); the k-th use of a word is an element of its own, so the
similarity of bags is that of sets. Its signature is a row of minwise symbols of ``BITS`` bits, split into chunks. Two messages are compared
if some chunk agrees but for at most ``errors`` symbols; the allowed errors are enumerated by leaving out each symbol of a chunk in
turn and meeting on a hash of the others. By pigeonhole this finds all pairs whose signatures differ in fewer than
(errors + 1) x chunks symbols, and pairs beyond that with the chance that ``layout`` brings to 1 - ``MISS`` at the limit itself. It does so
at every size of a video: a larger one has longer chunks and more of them, so the rows that meet by chance stay few and the work grows a
little faster than the rows and not with their square. Pairs that meet pass two filters without loss (their sizes' ratio is at least the
similarity; the distance of parity signatures never exceeds the bags' difference) and are verified on the words themselves.

Videos of up to ``LOCAL`` rows are searched where their rows meet after one shuffle. Of larger ones each task gets the chunks of a few
places for up to ``BLOCK`` rows; beyond that a chunk's rows are dealt by the hash of a half of it, one of which agrees in every pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.text import word_hashes
from rillflow.scale import attach_small, cut

#: Rows up to which a video is searched in one task.
LOCAL = 4096
#: Rows that a task holds of a larger video, root of the rows for each bundle of chunks below that, and tasks of all bundles.
BLOCK, BUNDLE_ROOT, MOST_TASKS = 600_000, 60, 4000
#: Chance to miss a pair whose similarity is the limit; pairs above it are missed far more seldom.
MISS = 1e-5
#: Bits of a minwise symbol.
BITS = 8
#: Words for each 64 bits of a parity signature, and its most lanes; longer bags only leave more pairs to verify.
WORDS_A_LANE, MOST_LANES = 56, 16
#: Pairs of rows that are looked at together, elements that are hashed together.
PAIRS, ELEMENTS = 1 << 20, 1 << 17
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
LINKS = "kind int, row_id_a long, row_id_b long"


@lru_cache(maxsize=1024)
def layout(n: int, errors: int, threshold: float = 0.75, miss: float = MISS) -> tuple[int, int]:
    """Symbols of a chunk and chunks of a signature for videos of up to ``n`` rows, so that at most ``miss`` of the pairs with a
    similarity of ``threshold`` share no chunk with at most ``errors`` errors."""
    c = max(3, math.ceil(math.log2(max(n, 2)) / 2)) + errors
    hit = sum(math.comb(c, i) * (1 - threshold) ** i * threshold ** (c - i) for i in range(errors + 1))
    return c, 1 if hit >= 1 else max(2, math.ceil(math.log(miss) / math.log(1 - hit)))


def scale_of(n: np.ndarray) -> np.ndarray:
    """The next power of two: videos of like size share a layout."""
    return 2 ** np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64)


def shards(n: int) -> int:
    """Parts that the rows of a video of ``n`` rows are dealt into, chunk by chunk."""
    return -(-n // BLOCK)


def bundles(n: int, chunks: int) -> int:
    """Tasks that share the chunks of a video whose rows one task can hold. Each of them gets all rows, so they grow with the root only."""
    return min(chunks, math.ceil(math.sqrt(n) / BUNDLE_ROOT))


def lanes(size: np.ndarray) -> np.ndarray:
    """Lanes of 64 bits (a power of two) that tell bags of ``size`` words from others."""
    return np.minimum(2 ** np.ceil(np.log2(np.maximum(size / WORDS_A_LANE, 1))), MOST_LANES).astype(int)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Bags:
    """Bags of words in flat arrays: elements ``x`` of row i at ``start[i]:start[i + 1]``."""

    def __init__(self, words: np.ndarray, start: np.ndarray):
        self.start, self.size = start, np.diff(start)
        first = np.ones(len(words), bool)
        first[1:] = words[1:] != words[:-1]
        first[start[:-1][self.size > 0]] = True
        at = np.arange(len(words))
        nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(_U)
        self.x = _mixed(words.astype(_U) + nth * _GOLD)

    def reduce(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), values.dtype)
        if (some := self.size > 0).any():
            out[some] = how.reduceat(values, self.start[:-1][some])
        return out

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that equal bags share."""
        return self.reduce(np.add, _mixed(self.x + _U(1))), self.reduce(np.add, _mixed(self.x ^ _GOLD))

    def parity(self, lanes: int) -> np.ndarray:
        """Parities of the elements' counts in 64 ``lanes`` buckets. Halves laid on each other are the signature of half the lanes."""
        bit, lane = _U(1) << (self.x & _U(63)), (self.x >> _U(6)) & _U(lanes - 1)
        return np.stack([self.reduce(np.bitwise_xor, np.where(lane == _U(i), bit, _U(0))) for i in range(lanes)], axis=1)

    def minwise(self, symbols: int) -> np.ndarray:
        """The lowest bits of the least hash of each bag under each of ``symbols`` hash functions; bags must not be empty."""
        seed = _mixed(np.arange(1, 2 * symbols + 1, dtype=_U) * _GOLD)
        first, second = (seed >> _U(32)).astype(np.uint32)[:symbols] | 1, (seed >> _U(32)).astype(np.uint32)[symbols:] | 1
        out, x = np.empty((len(self.size), symbols), np.uint8), (self.x >> _U(32)).astype(np.uint32)
        low = 0
        while low < len(self.size):
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + ELEMENTS, "right")) - 1)
            part, at = x[self.start[low] : self.start[high]], self.start[low:high] - self.start[low]
            for k in range(symbols):
                h = part * first[k]
                h ^= h >> np.uint32(15)
                h *= second[k]
                out[low:high, k] = np.minimum.reduceat(h, at)  # keeps the low BITS bits
            low = high
        return out

    def take(self, rows: np.ndarray) -> Bags:
        out = object.__new__(Bags)
        out.size = self.size[rows]
        out.start = np.concatenate([[0], np.cumsum(out.size)])
        out.x = self.x[np.repeat(self.start[:-1][rows] - out.start[:-1], out.size) + np.arange(out.start[-1])]
        return out


def shared_words(a: Bags, b: Bags) -> np.ndarray:
    """Elements in common of each row of two lists of bags."""
    pair = np.concatenate([np.repeat(np.arange(len(s.size)), s.size) for s in (a, b)])
    order = np.lexsort((x := np.concatenate([a.x, b.x]), pair))
    x, pair = x[order], pair[order]
    return np.bincount(pair[1:][(x[1:] == x[:-1]) & (pair[1:] == pair[:-1])], minlength=len(a.size))


def similar(a: Bags, b: Bags, threshold: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether row i of ``a`` and row j of ``b`` are that similar, pair by pair."""
    found = np.zeros(len(i), bool)
    for at in range(0, len(found), 4000):
        p, q = a.take(i[at : at + 4000]), b.take(j[at : at + 4000])
        both = shared_words(p, q)
        found[at : at + 4000] = both >= threshold * (p.size + q.size - both) - 1e-9
    return found


def _words(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).view(_U), np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])


def parities(bags: Bags) -> list[np.ndarray]:
    """The parity signature of each bag; its length depends on the bag's size."""
    width = lanes(bags.size)
    out: list[np.ndarray] = [np.zeros(0, _U)] * len(width)
    for n in np.unique(width):
        at = np.flatnonzero(width == n)
        for i, p in zip(at, bags.take(at).parity(int(n))):
            out[i] = p
    return out


class Filter:
    """Which pairs of rows sizes and parity signatures leave."""

    def __init__(self, size: np.ndarray, parity: list[np.ndarray], threshold: float):
        self.size, self.parity, self.threshold = size, parity, threshold
        self.width = np.array([len(p) for p in parity], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lane(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``n`` lanes of the rows that have as many, and the place of each row among them."""
        if n not in self.folded:
            place = np.cumsum(self.width >= n) - 1
            out = np.empty((int((self.width >= n).sum()), n), _U)
            for w in np.unique(self.width[self.width >= n]):
                at = np.flatnonzero(self.width == w)
                out[place[at]] = np.bitwise_xor.reduce(np.concatenate([self.parity[i] for i in at]).reshape(len(at), w // n, n), axis=1)
            self.folded[n] = out, place
        return self.folded[n]

    def keep(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.size[i], self.size[j]
        ok = np.minimum(a, b) >= self.threshold * np.maximum(a, b) - 1e-9
        limit, width = (1 - self.threshold) / (1 + self.threshold) * (a + b) + 1e-9, np.minimum(self.width[i], self.width[j])
        for n in np.unique(width[ok]):
            at = np.flatnonzero(ok & (width == n))
            rows, place = self.lane(int(n))
            far = np.bitwise_count(rows[place[i[at]]] ^ rows[place[j[at]]]).sum(axis=1, dtype=np.int64)
            ok[at] = far <= limit[at]
        return ok


def _meetings(key: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key (and of the sides 0 and 1), some at a time."""
    if side is None:
        order = np.argsort(key)
        low = np.arange(1, len(key) + 1)
    else:
        key = key & ~_U(1)
        order = np.argsort(key | side.astype(_U))
    held = key[order]
    new = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    length = np.diff(np.append(new, len(held)))
    stop = np.repeat(new + length, length)
    if side is not None:  # a row of side 0 meets those of side 1 behind it
        ones = np.add.reduceat(side[order].astype(np.int64), new)
        low = np.where(side[order] == 0, np.repeat(new + length - ones, length), stop)
    count = stop - low
    some = np.flatnonzero(count > 0)
    low, count = low[some], count[some]
    upto = np.cumsum(count)
    a = 0
    while a < len(some):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        n = count[a:b]
        i = np.repeat(some[a:b], n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        yield order[i], order[j]
        a = b


def candidates(run: np.ndarray, side: np.ndarray | None, symbols: np.ndarray, c: int, kept: Filter, errors: int, places: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run (and of sides 0 and 1) that agree in a chunk of ``c`` symbols but for ``errors`` (0 or 1) of them and
    pass the filter, each once. ``places`` are those of a chunk that may differ (all if None)."""
    n, codes, fresh = len(run), np.zeros(0, np.int64), []
    base = _mixed(run.astype(_U) * _GOLD + _U(7))
    for at in range(0, symbols.shape[1], c):
        chunk = symbols[:, at : at + c]
        salt = _mixed(np.arange(1, c + 1, dtype=_U) * _GOLD)
        hashed = [_mixed(chunk[:, p].astype(_U) + salt[p]) for p in range(c)]
        whole = np.bitwise_xor.reduce(hashed)
        for p in [-1] if errors == 0 else places or range(c):
            rest = base + (whole if p < 0 else whole ^ hashed[p])
            for i, j in _meetings(rest, side):
                ok = run[i] == run[j]
                if p > 0 and (places is None or p > places.start):  # equal chunks meet at their first place already
                    ok &= chunk[i, p] != chunk[j, p]
                i, j = i[ok], j[ok]
                ok = kept.keep(i, j)
                fresh.append(np.minimum(i, j)[ok] * n + np.maximum(i, j)[ok])
                if sum(map(len, fresh)) > 4 * PAIRS + len(codes):
                    codes, fresh = np.unique(np.concatenate([codes, *fresh])), []
    codes = np.unique(np.concatenate([codes, *fresh]))
    return codes // max(n, 1), codes % max(n, 1)


def _two_sided(run: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows of runs that have both sides."""
    least, most = np.full(run.max(initial=-1) + 1, 2), np.zeros(run.max(initial=-1) + 1)
    np.minimum.at(least, run, side)
    np.maximum.at(most, run, side)
    return least[run] < most[run]


def _search(table: pa.Table, threshold: float, errors: int, cross: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Copies and near pairs in whole videos: (0, representative, copy) and (1, a, b)."""
    ident, video, other, side = (table[c].to_numpy() for c in ("ident", "vk", "vk2", "side"))
    bags = Bags(*_words(table["words"]))
    s1, s2 = bags.names()
    order = np.lexsort((ident, s2, s1, side, other, video))
    same = np.arange(len(order)) > 0
    for c in (video, other, side, s1, s2, bags.size):
        same[1:] &= c[order][1:] == c[order][:-1]
    new = ~same
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    yield 0, ident[first[same]], ident[order[same]]
    if cross:  # copies on both sides are a pair even without a word
        empty = order[new & (bags.size[order] == 0)]
        met = (video[empty][1:] == video[empty][:-1]) & (other[empty][1:] == other[empty][:-1])
        yield 1, np.minimum(ident[empty][1:], ident[empty][:-1])[met], np.maximum(ident[empty][1:], ident[empty][:-1])[met]
    reps = order[new & (bags.size[order] > 0)]
    change = np.ones(len(reps), bool)
    change[1:] = (video[reps][1:] != video[reps][:-1]) | (other[reps][1:] != other[reps][:-1])
    run = np.cumsum(change) - 1
    n = np.bincount(run)[run] if len(run) else run
    wanted = n > 1
    if cross:
        wanted &= _two_sided(run, side[reps])
    like = scale_of(n)
    for scale in np.unique(like[wanted]):
        rows = np.flatnonzero(wanted & (like == scale))
        some = bags.take(reps[rows])
        c, m = layout(int(scale), errors, threshold)
        i, j = candidates(run[rows], side[reps][rows] if cross else None, some.minwise(c * m), c, Filter(some.size, parities(some), threshold), errors)
        ok = similar(some, some, threshold, i, j)
        a, b = ident[reps[rows[i[ok]]]], ident[reps[rows[j[ok]]]]
        yield 1, np.minimum(a, b), np.maximum(a, b)


def _as_links(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for kind, a, b in found:
        if len(a):
            yield pa.record_batch({"kind": pa.array(np.full(len(a), kind, np.int32)), "row_id_a": pa.array(a.astype(np.int64)), "row_id_b": pa.array(b.astype(np.int64))})


def _search_videos(threshold: float, errors: int, cross: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            video = held[-1]["vk"].to_numpy()
            if not len(video) or video[0] == video[-1]:
                continue
            whole = pa.concat_tables(held)
            split = len(whole) - int((video == video[-1]).sum())  # rows come sorted by vk
            yield from _as_links(_search(whole.slice(0, split), threshold, errors, cross))
            held = [whole.slice(split)]
        if held and len(whole := pa.concat_tables(held)):
            yield from _as_links(_search(whole, threshold, errors, cross))

    return run


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of bags: 128 bits and a size."""
    for batch in batches:
        bags = Bags(*_words(batch["words"]))
        s1, s2 = bags.names()
        columns = {c: batch[c] for c in ("ident", "vk", "vk2", "side", "n", "text")}
        yield pa.record_batch(columns | {"s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)), "size": pa.array(bags.size.astype(np.int64))})


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] if data.ndim > 1 else 0)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


PART = "vk long, vk2 long, part long, n long, ident long, side int, size long, parity binary, symbols binary"


def _deal(threshold: float, errors: int) -> Callable:
    """Every row for each part of its video that needs it, with the symbols of the part's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = Bags(*_words(batch["words"]))
            parity = pa.array([p.tobytes() for p in parities(bags)], pa.binary())
            like = scale_of(batch["n"].to_numpy())
            for scale in np.unique(like).tolist():
                at = np.flatnonzero(like == scale)
                c, m = layout(scale, errors, threshold)
                symbols = bags.take(at).minwise(c * m)
                rows = batch.take(pa.array(at))
                columns = {k: rows[k] for k in ("vk", "vk2", "ident", "side", "size")} | {"n": pa.array(np.full(len(at), scale)), "parity": parity.take(pa.array(at))}
                for part, held in _parts(symbols, scale, c, m, errors):
                    yield pa.record_batch({**columns, "part": pa.array(part), "symbols": _binary(held)}).select(PART_COLUMNS)

    return run


PART_COLUMNS = [p.split()[0] for p in PART.split(", ")]


def _parts(symbols: np.ndarray, scale: int, c: int, m: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of parts and the symbols that go there."""
    if (s := shards(scale)) == 1:
        t = bundles(scale, m)
        for k in range(t):
            chunks = range(k, m, t)
            yield np.full(len(symbols), k), np.concatenate([symbols[:, j * c : (j + 1) * c] for j in chunks], axis=1)
        return
    for j in range(m):
        chunk = symbols[:, j * c : (j + 1) * c]
        for half, fixed in enumerate([range(c)] if errors == 0 else [range(c // 2), range(c // 2, c)]):
            h = np.zeros(len(chunk), _U)
            for p in fixed:
                h = _mixed(h + chunk[:, p] + _GOLD)
            yield ((j * 2 + half) * s + (h % _U(s)).astype(np.int64)), chunk


def _cell(threshold: float, errors: int, cross: bool) -> Callable:
    """Pairs of one part of a video that meet there and pass the filter."""

    def run(table: pa.Table) -> pa.Table:
        ident, side, size = (table[c].to_numpy() for c in ("ident", "side", "size"))
        scale, part = table["n"][0].as_py(), table["part"][0].as_py()
        c, _ = layout(scale, errors, threshold)
        parity = [np.frombuffer(p.as_buffer(), _U) for p in table["parity"]]
        symbols = np.frombuffer(b"".join(table["symbols"].to_pylist()), np.uint8).reshape(len(ident), -1)
        s, places = shards(scale), None
        if s > 1 and errors:  # the first half agrees in even parts, so that the second may differ
            places = range(c // 2) if part // s % 2 else range(c // 2, c)
        i, j = candidates(np.zeros(len(ident), np.int64), side if cross else None, symbols, c, Filter(size, parity, threshold), errors, places)
        return pa.table({"a": ident[i], "b": ident[j]})

    return run


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            ok = similar(Bags(*_words(batch["words_a"])), Bags(*_words(batch["words_b"])), threshold, at, at)
            a, b = batch["a"].to_numpy()[ok], batch["b"].to_numpy()[ok]
            yield from _as_links(iter([(1, np.minimum(a, b), np.maximum(a, b))]))

    return run


def _spread(hot: DataFrame, threshold: float, errors: int, cross: bool, shingle: int, tasks: int) -> DataFrame:
    """Copies and near pairs in videos too large for one task."""
    words = word_hashes(F.col("text"), shingle).alias("words")
    signed = cut(hot.select("ident", "vk", "vk2", "side", "n", "text", words).mapInArrow(
        _sign, "ident long, vk long, vk2 long, side int, n long, text string, s1 long, s2 long, size long"
    ))
    name = ["vk", "vk2", "side", "s1", "s2", "size"]
    classes = cut(signed.groupBy(*name).agg(F.min("ident").alias("rep"), F.count(F.lit(1)).alias("copies")))
    copies = signed.select("ident", *name).join(classes.where("copies > 1"), name).where("ident <> rep").select(F.lit(0).alias("kind"), F.col("rep").alias("row_id_a"), F.col("ident").alias("row_id_b"))
    reps = signed.where("size > 0").join(classes.select(F.col("rep").alias("ident"), *name), ["ident", *name]).dropDuplicates(["ident", *name])
    dealt = reps.select("ident", "vk", "vk2", "side", "n", "size", words).mapInArrow(_deal(threshold, errors), PART)
    key = ["vk", "vk2", "part"]
    pairs = cut(dealt.repartition(tasks, *key).groupBy(*key).applyInArrow(_cell(threshold, errors, cross), "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = cut(pairs.select(F.col("a").alias("ident")).unionByName(pairs.select(F.col("b").alias("ident"))).distinct())
    held = attach_small(signed.select("ident", "text"), wanted, ["ident"], "inner", limit=1_000_000).select("ident", words)
    joined = pairs.join(held.select(F.col("ident").alias("a"), F.col("words").alias("words_a")), "a").join(held.select(F.col("ident").alias("b"), F.col("words").alias("words_b")), "b")
    near = joined.select("a", "b", "words_a", "words_b").mapInArrow(_verify(threshold), LINKS)
    out = copies.unionByName(near)
    if cross:  # messages without a word have no symbols; equal ones on both sides are a pair
        blank = classes.where("size = 0").groupBy("vk", "vk2").agg(F.min("rep").alias("row_id_a"), F.max("rep").alias("row_id_b")).where("row_id_a <> row_id_b")
        out = out.unionByName(blank.select(F.lit(1).alias("kind"), "row_id_a", "row_id_b"))
    return out


def near_links(rows: DataFrame, threshold: float = 0.75, errors: int = 1, cross: bool = False, local: int = LOCAL, shingle: int = 1) -> DataFrame:
    """``kind, row_id_a, row_id_b`` over ``rows`` (``ident, video, side, text``): kind 0 binds a copy b to the representative a of
    its class of equal bags, kind 1 is a pair of representatives (the smaller first) whose similarity is ``threshold`` or more.

    ``errors`` (0 or 1) symbols of a chunk may differ: 1 is the multi-index join, 0 is plain banding of minwise hashes. Elements are
    single words, or runs of ``shingle`` words (texts with fewer words are one element). With ``cross`` there are two sides, a class
    is of one of them and only pairs of different sides count; else ``side`` isn't looked at. Rows with a null video, text or
    ident (with ``cross``: or side) have no links; two messages without words are equal. Repeated rows are copies. Whole texts are compared.
    """
    if errors not in (0, 1):
        raise ValueError("errors must be 0 or 1")
    side = F.when(F.col("side").isNotNull(), (F.col("side") > 1).cast("int")) if cross else F.lit(0)
    rows = rows.where("video is not null and text is not null and ident is not null").select("ident", "video", side.alias("side"), "text").where("side is not null")
    keyed = rows.withColumns({"vk": F.xxhash64("video"), "vk2": F.xxhash64(F.lit(1), F.col("video"))})
    sizes = cut(keyed.groupBy("vk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local))
    scales = {int(r["e"]): r["k"] for r in sizes.groupBy(F.ceil(F.log2("n")).alias("e")).agg(F.count(F.lit(1)).alias("k")).collect()}
    tagged = attach_small(keyed, sizes, ["vk"], rows=sum(scales.values()))
    small = tagged.where("n is null").select("ident", "vk", "vk2", "side", "text").repartition("vk").sortWithinPartitions("vk", "ident")
    words = word_hashes(F.col("text"), shingle).alias("words")
    links = small.select("ident", "vk", "vk2", "side", words).mapInArrow(_search_videos(threshold, errors, cross), LINKS)
    if scales:
        parts = sum(k * (bundles(2**e, m) if shards(2**e) == 1 else m * (1 + errors) * shards(2**e)) for e, k in scales.items() for m in [layout(2**e, errors, threshold)[1]])
        links = links.unionByName(_spread(tagged.where("n is not null"), threshold, errors, cross, shingle, min(parts + 1, MOST_TASKS)))
    return links


def expand(links: DataFrame, cross: bool = False) -> DataFrame:
    """All pairs of rows that the links stand for, ``row_id_a < row_id_b``. ``links`` should be a checkpointed table."""
    copies = links.where("kind = 0").select(F.col("row_id_a").alias("rep"), F.col("row_id_b").alias("row"))
    pairs = links.where("kind = 1").select("row_id_a", "row_id_b")
    ends = pairs.select(F.col("row_id_a").alias("rep")).unionByName(pairs.select(F.col("row_id_b").alias("rep")))
    members = copies.unionByName(copies.select("rep", F.col("rep").alias("row"))).unionByName(ends.select("rep", F.col("rep").alias("row"))).distinct()
    a, b = (members.select(F.col("rep").alias(f"row_id_{x}"), F.col("row").alias(x)) for x in "ab")
    out = pairs.join(a, "row_id_a").join(b, "row_id_b").select("a", "b")
    if not cross:
        more = members.join(copies.select("rep").distinct(), "rep", "left_semi")
        inside = more.alias("p").join(more.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.row") < F.col("q.row"))).select(F.col("p.row").alias("a"), F.col("q.row").alias("b"))
        out = out.unionByName(inside)
    return out.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))
