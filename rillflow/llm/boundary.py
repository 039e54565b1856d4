"""What a corpus itself says about sentence boundaries: words of spaceless scripts, opening and final words, and abbreviations.

Everything is counted over whole texts at places that leave no doubt (line ends, full stops of spaceless scripts outside quotations) and
combined before it is shuffled; only the model, whose size is a parameter, reaches the driver.

* A run of characters is a *word* if it recurs, coheres (its parts meet far more often than by chance) and is free on both sides (the
  entropy of what stands before and after it).
* A run *opens* if it is far more frequent behind a sure end than inside sentences, *continues* if it recurs and never stands there;
  likewise *final* and not final before a sure end.
* A token of two letters or more, outside quotations, is an *abbreviation* by the log-likelihood ratio of its use with and without a
  dot, weighed down by its length; one that (almost) never stands before a line's end doesn't end a sentence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.scale import cut

#: Longest run that is counted, least uses of a run or token, least share by which a run opens or closes more often than by chance.
LONGEST, LEAST, TIMES = 4, 20, 4.0
#: Of a word: times its parts meet more often than by chance, and the entropy (nats) on each side.
COHESION, FREEDOM = 8.0, 0.6
#: Least score of an abbreviation, longest one, and the share of line ends from which it may end a sentence.
SCORE, LETTERS, AT_END = 0.3, 10, 0.01
#: Entries of each kind that a model holds, the most frequent first.
ENTRIES = 100_000
#: Counters that a task holds before it hands them on.
HELD = 500_000

#: Stand for what is beside a run's first and last character.
EDGES = "<>"
#: Scripts without spaces between words: Han, Kana, Thai, Lao, Tibetan, Burmese, Khmer.
SPACELESS = "ก-ฺเ-๎ກ-ຽເ-໎ໜ-ໟཀ-ྼက-၉ၐ-႟ក-៓ៗៜ-៩々ぁ-ゟァ-ヿ㐀-䶿一-鿿豈-﫿"
_RUN = re.compile(f"[{SPACELESS}]+")
_SURE_END = "。！？｡!?"
_CLOSING = "”’」』）)》〉\"'"
#: Quotations, whose short exclamations would look like abbreviations.
_QUOTED = regex.compile("\"[^\"\n]{0,200}\"|[“„”][^“”\n]{0,200}[”“]|«[^«»\n]{0,200}»|(?<![\\p{L}\\p{N}])'[^'\n]{0,200}'(?![\\p{L}\\p{N}])")
#: A token with the dot behind it, if there is one and not several.
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*+(?:[./'’-](?=\p{L})[\p{L}\p{M}]++)*+(?:\.(?![.…]))?+")


@dataclass(frozen=True)
class Model:
    """``words``: cost of each word in nats; ``opens`` and ``final``: whether a run does so; ``never``: abbreviations that don't end
    a sentence."""

    words: dict[str, float] = field(default_factory=dict)
    opens: dict[str, bool] = field(default_factory=dict)
    final: dict[str, bool] = field(default_factory=dict)
    never: frozenset[str] = frozenset()

    def opening(self, text: str, at: int, end: int) -> bool | None:
        """Whether what stands at ``at`` opens a sentence, by the longest run that is known; None if none is."""
        for n in range(min(LONGEST, end - at), 1, -1):
            if (known := self.opens.get(text[at : at + n])) is not None:
                return known
        return None

    def closes(self, text: str, start: int, at: int) -> bool | None:
        for n in range(min(LONGEST, at - start), 1, -1):
            if (known := self.final.get(text[at - n : at])) is not None:
                return known
        return None


NO_MODEL = Model()


def _count(text: str, runs: Counter, opens: Counter, finals: Counter, pieces: Counter, last: Counter) -> None:
    """Add a text's runs of spaceless scripts, and its pieces between blanks (and those before a line's end) outside quotations."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        held = f"{EDGES[0]}{m.group()}{EDGES[1]}"
        for n in range(1, LONGEST + 1):
            runs.update([held[i : i + n] for i in range(len(held) - n + 1)])
        before, after = text[a - 1 : a], text[b : b + 1]
        if not before or before in _SURE_END or before in "\r\n":
            opens.update([text[a : a + n] for n in range(2, min(LONGEST, b - a) + 1)])
        if not after or after in "\r\n" or after in _SURE_END and text[b + 1 : b + 2] not in _CLOSING:
            finals.update([text[b - n : b] for n in range(2, min(LONGEST, b - a) + 1)])
    for line in _QUOTED.sub(" ", text).splitlines():
        said = line.split()
        pieces.update(said)
        if said and said[-1].endswith("."):
            last[said[-1]] += 1


def _tokens(pieces: Counter) -> tuple[Counter, Counter]:
    """Tokens with a dot behind them and tokens without, of counted pieces."""
    dotted, plain = Counter(), Counter()
    for piece, n in pieces.items():
        for token in _TOKEN.findall(piece.casefold()):
            word = token.removesuffix(".")
            if 1 < len(word) <= LETTERS and not _RUN.match(word):
                (plain if word == token else dotted)[word] += n
    return dotted, plain


def _line_ends(last: Counter) -> Counter:
    ends = Counter()
    for piece, n in last.items():
        found = _TOKEN.findall(piece.casefold())
        if found and found[-1].endswith(".") and 1 < len(found[-1]) - 1 <= LETTERS:
            ends[found[-1][:-1]] += n
    return ends


KINDS = ("run", "opens", "final", "dotted", "ending", "plain")


def counts(df: DataFrame, text: str) -> DataFrame:
    """``kind, key, n`` over all texts; tasks add up what they meet before it moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(5)]

        def flush() -> Iterator[pa.RecordBatch]:
            runs, opens, finals, pieces, last = held
            dotted, plain = _tokens(pieces)
            for kind, found in zip(KINDS, (runs, opens, finals, dotted, _line_ends(last), plain)):
                if found:
                    yield pa.record_batch({"kind": pa.array([kind] * len(found)), "key": pa.array(list(found)), "n": pa.array(list(found.values()), pa.int64())})
            for found in held:
                found.clear()

        for batch in batches:
            for t in batch["_text"].to_pylist():
                if t:
                    _count(t, *held)
            if sum(map(len, held)) > HELD:
                yield from flush()
        yield from flush()

    return df.select(F.col(text).alias("_text")).mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_share(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def abbreviations(counted: DataFrame) -> DataFrame:
    """``key, never`` of the tokens that are abbreviations."""
    pivoted = counted.where("kind in ('dotted', 'ending', 'plain')").groupBy("key").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in ("dotted", "ending", "plain")])
    total = pivoted.agg(F.sum("dotted").alias("dots"), F.sum(F.col("dotted") + F.col("plain")).alias("tokens"))
    scored = pivoted.where(F.col("dotted") >= LEAST).crossJoin(F.broadcast(total))  # one row
    n = F.col("dotted") + F.col("plain")
    by_chance = F.col("dots") / F.col("tokens")
    ratio = 2 * (_log_share(F.col("dotted"), n, F.lit(0.99)) - _log_share(F.col("dotted"), n, by_chance))
    letters = F.length(F.regexp_replace("key", r"[^\p{L}\p{M}]", ""))
    inner = F.length("key") - F.length(F.replace("key", F.lit("."), F.lit(""))) + 1
    score = ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -F.col("plain"))
    return scored.where(score >= SCORE).select("key", (F.col("ending") < AT_END * F.col("dotted")).alias("never"), F.col("dotted").alias("n"))


def learn(df: DataFrame, text: str, entries: int = ENTRIES) -> Model:
    """The model of all texts of ``df.text``. Null and empty texts count nothing; no texts give an empty model."""
    counted = cut(counts(df, text))
    runs = counted.where((F.col("kind") == "run") & (F.col("n") >= LEAST)).select("key", "n")
    inside = ~F.col("key").rlike(f"[{EDGES}]")
    size = float(counted.where("kind = 'run' and length(key) = 1").where(inside).agg(F.sum("n")).first()[0] or 0)
    if size:
        shape = F.length("key")
        part = lambda side, n: F.expr(f"{side}(key, {n})")
        # every run says to what it is made of how often and how freely they are completed: one shuffle
        weight = F.struct(F.col("n").cast("double").alias("n"), (F.col("n") * F.log("n")).alias("l"))
        told = runs.where(shape <= LONGEST).select(F.explode(F.array(
            F.struct(F.col("key"), F.lit("own").alias("as"), weight.alias("w")),
            F.struct(F.when(shape >= 3, part("left", "length(key) - 1")).alias("key"), F.lit("after").alias("as"), weight.alias("w")),
            F.struct(F.when(shape >= 3, part("right", "length(key) - 1")).alias("key"), F.lit("before").alias("as"), weight.alias("w")),
        )).alias("t")).select("t.*").where("key is not null")
        of = lambda kind, c: F.sum(F.when(F.col("as") == kind, F.col(c)))
        entropy = lambda kind: F.log(of(kind, "w.n")) - of(kind, "w.l") / of(kind, "w.n")
        known = cut(told.groupBy("key").agg(of("own", "w.n").alias("n"), entropy("after").alias("after"), entropy("before").alias("before")).where("n is not null"))
        part_of = lambda name: known.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"))
        some = known.where((shape >= 2) & (shape < LONGEST) & inside & (F.col("after") >= FREEDOM) & (F.col("before") >= FREEDOM))
        for name, side, n in (("head", "left", "length(key) - 1"), ("tail", "right", "length(key) - 1"), ("first", "left", "1"), ("end", "right", "1")):
            some = some.withColumn(name, part(side, n)).join(part_of(name), name)
        meets = F.least(F.col("n") * size / (F.col("n_head") * F.col("n_end")), F.col("n") * size / (F.col("n_first") * F.col("n_tail")))
        found = some.where(meets >= COHESION).select("key", "n").orderBy(F.desc("n"), "key").limit(entries).collect()
        words = {r["key"]: -math.log(r["n"] / size) for r in found}
        sides = [_side(counted, runs, kind, size, entries) for kind in ("opens", "final")]
    else:
        words, sides = {}, [{}, {}]
    short = abbreviations(counted).where("never").orderBy(F.desc("n"), "key").limit(entries).collect()
    return Model(words, *sides, frozenset(r["key"] for r in short))


def _side(counted: DataFrame, runs: DataFrame, kind: str, size: float, entries: int) -> dict[str, bool]:
    at = counted.where(F.col("kind") == kind).select("key", F.col("n").alias("at"))
    places = float(at.where("length(key) = 2").agg(F.sum("at")).first()[0] or 0)
    if not places:
        return {}
    joined = runs.where((F.length("key") >= 2) & ~F.col("key").rlike(f"[{EDGES}]")).join(at, "key", "left").withColumn("at", F.coalesce("at", F.lit(0)))
    share = F.col("at") / F.col("n") / (places / size)  # 1: as often as by chance
    known = joined.withColumn("yes", F.when((share >= TIMES) & (F.col("at") >= LEAST / 2), True).when((F.col("at") == 0) & (F.col("n") * places / size >= 3), False)).where("yes is not null")
    return {r["key"]: r["yes"] for r in known.orderBy(F.desc("n"), "key").limit(entries).collect()}
