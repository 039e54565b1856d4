"""Each operator on nulls, ties, repeats, hot groups, empty tables and clashing names."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rillflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from rillflow.llm import near as N  # noqa: E402
from rillflow.llm.cap import cap_contributors  # noqa: E402
from rillflow.llm.cutoff import score_cutoffs  # noqa: E402
from rillflow.llm.identity import connected_components, find_videos  # noqa: E402
from rillflow.llm.mix import balance, blend  # noqa: E402
from rillflow.llm.pack import fill, pack, plan  # noqa: E402
from rillflow.llm.sample import Members, pivotal, plan_goals, plan_rates, sample_to_targets, tilt  # noqa: E402
from rillflow.llm.boundary import NO_MODEL, learn  # noqa: E402
from rillflow.llm.sentences import PLAIN, Lexicon, sentence_ends, sentences  # noqa: E402
from rillflow.llm.splits import assign_splits  # noqa: E402
from rillflow.llm.text import spelled, user_message, word_hashes  # noqa: E402
from rillflow.llm.tokens import VOCABULARY, with_tokens  # noqa: E402

# 1


def cutoffs(spark, rows, targets, **more):
    df = spark.createDataFrame(rows, "s string, x double")
    t = spark.createDataFrame(targets, "source string, target double")
    return {r["source"]: (r["cutoff"], r["known"], r["kept"]) for r in score_cutoffs(df, F.col("s"), F.col("x"), t, **more).collect()}


def test_cutoffs_against_sorting(spark):
    rng = random.Random(5)
    rows = [(s, rng.choice([0.0, 0.25, 0.3333, 1e-12, 2e-12, rng.random()])) for s in "aab" for _ in range(400)]
    got = cutoffs(spark, rows, [("a", 0.37), ("b", 0.9)], bins=4)
    for s, target in (("a", 0.37), ("b", 0.9)):
        values = sorted(x for k, x in rows if k == s)
        best = min(((abs(sum(v <= c for v in values) / len(values) - target), c) for c in set(values)), key=lambda t: t)
        assert abs(got[s][2] / len(values) - target) == pytest.approx(best[0]) and got[s][0] == best[1]


def test_cutoffs_on_odd_input(spark):
    nan = float("nan")
    got = cutoffs(spark, [("a", None), ("a", nan), ("b", 0.5), ("b", 0.5), (None, 0.1), ("c", float("inf")), ("d", 0.2)], [("a", 0.5), ("b", 0.4), ("c", 0.5), ("d", nan), ("e", 0.1), ("b", 0.4)])
    assert got == {"a": (None, 0, 0), "b": (None, 2, 0), "c": (None, 0, 0), "d": (None, 1, 0), "e": (None, 0, 0)}
    assert cutoffs(spark, [], [("a", 0.5)]) == {"a": (None, 0, 0)}
    assert cutoffs(spark, [("a", 0.5)], []) == {}
    wide = cutoffs(spark, [("a", x) for x in (-1.7e308, 0.0, 1.7e308, 5e-324)], [("a", 0.5)])
    assert wide == {"a": (0.0, 4, 2)}


# 2


def capped(spark, rows, **more):
    df = spark.createDataFrame(rows, "id long, who string, q double, n int, name string")
    return cap_contributors(df, "who", "q", "id", name="name", **more)


def test_cap_keeps_the_best(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("hhhhhab"), rng.choice([None, float("nan"), 0.1, 0.5, 0.5001, rng.random()]), i, "x") for i in range(600)]
    got = capped(spark, rows, cap=7)
    kept = {r["id"] for r in got.kept.collect()}
    level = lambda q: -1 if q is None or q != q else q
    for who in "hab":
        best = sorted((r for r in rows if r[1] == who), key=lambda r: (-level(r[2]), r[0]))[:7]
        assert {r[0] for r in best} == {i for i in kept if rows[i][1] == who}
    assert got.kept.columns == ["id", "who", "q", "n", "name"]


def test_cap_on_odd_input(spark):
    rows = [(1, None, 0.5, 1, None), (2, None, 0.5, 1, "a"), (3, "w", None, 1, None), (3, "w", None, 1, None), (4, "w", 2.0, 1, "b"), (5, "w", -1.0, 1, "a")]
    got = capped(spark, rows, cap=2)
    assert sorted(r["id"] for r in got.kept.collect()) == [1, 2, 4, 5]
    assert [tuple(r) for r in got.report.collect()] == [("w", "a", 4, 2, 2)]
    assert capped(spark, rows, cap=0).kept.count() == 2
    assert capped(spark, rows, share=0.5).report.first()["kept"] == 3
    assert capped(spark, [], cap=3).kept.count() == 0
    with pytest.raises(ValueError):
        capped(spark, rows)


def test_cap_of_a_hot_contributor_with_ties(spark):
    """Shares above all in one bin: the border is ranked over ranges."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 700)).alias("who"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.5 + (F.col("id") % 97) / 1e6).alias("q"))
    got = cap_contributors(df, "who", "q", "id", share=0.3)
    assert [tuple(r)[2:] for r in got.report.where("contributor = 'hot'").collect()] == [(8000, 6000, 2000)]
    kept = {r["id"] for r in got.kept.where("who = 'hot'").collect()}
    best = sorted((-(0.5 if i % 3 == 0 else 0.5 + (i % 97) / 1e6), i) for i in range(20_000) if i % 5 < 2)[:6000]
    assert kept == {i for _, i in best}


# 3


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(str(rng.randrange(300)), str(rng.randrange(300))) for _ in range(220)] + [("hub", f"leaf{i}") for i in range(80)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("x", "x"), (None, "y")]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[find(a)] = find(b)
    want = defaultdict(set)
    for x in list(parent):
        want[find(x)].add(x)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: min(group) for group in want.values() for x in group}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


NAMES = [
    ("lumen_01", "lumen_01"), ("LUMEN_01 ", "lumen_01"), ("file:///pool/proxy_lumen_1f/lumen_01.mp4", "lumen_01"), ("lumen%5F01", "lumen_01"), ("s3://other/deep/er/root/lumen_01.webm", "lumen_01"), ("\ufefflumen_01", "lumen_01"),
    ("/a/b/seq_1/take2.MP4", "seq_1/take2"), ("seq_1/take2", "seq_1/take2"), ("seq%5F1%2Ftake2", "seq_1/take2"), ("seq_2/take2", "seq_2/take2"), ("twin", "lumen_01"), ("far", "lumen_01"), ("zero_a", "zero_a"), ("zero_b", "zero_b"),
    ("C:\\\\clips\\lumen_01.mp4", "lumen_01"), ("file:/pool/lumen_01.mp4#t=3", "lumen_01"), ("100%", "100%"), ("", None), ("  ", None), (None, None),
]


def test_video_names(spark):
    files = spark.createDataFrame(
        [("lumen_01", 5, "AA"), ("twin", 5, "aa"), ("twin", 6, "bb"), ("bridge", 6, "bb"), ("bridge", 7, "cc"), ("far", 7, "cc"), ("zero_a", 0, "dd"), ("zero_b", 0, "dd"), ("seq_2/take2", 9, None), ("seq_1/take2", 9, ""), (None, 5, "aa")],
        "video_id string, n_bytes long, content_sha1 string",
    )
    names = spark.createDataFrame([(n,) for n, _ in NAMES], "video_id string")
    videos = find_videos(names, files)
    got = {r["video_id"]: r["video"] for r in videos.attach(names.withColumn("name", F.lit(1)), F.col("video_id")).collect()}
    smallest = min(n for n in ("lumen_01", "twin", "far", "bridge"))
    want = {n: (smallest if v == "lumen_01" else v) for n, v in NAMES}
    assert got == want
    empty = find_videos(names.limit(0), files.limit(0))
    assert empty.attach(names, F.col("video_id")).where("video_id = 'twin'").first()["video"] == "twin"


def test_ids_of_many_folders(spark):
    files = spark.createDataFrame([("a/b/c/d/e", 5, "aa"), ("/mnt/s/t/u/v/videos/deep_filed", 6, "bb")], "video_id string, n_bytes long, content_sha1 string")
    want = {"a/b/c/d/e": "a/b/c/d/e", "/mnt/disk/A/b/c/d/e.mp4": "a/b/c/d/e", "s3://bucket/x/y/a/b/c/d/e.webm": "a/b/c/d/e", "1/2/3/4/5/6/7": "1/2/3/4/5/6/7", "/root/1/2/3/4/5/6/7.mp4": "1/2/3/4/5/6/7",
            "deep_filed": "deep_filed", "/mnt/s/t/u/v/videos/deep_filed.mp4": "deep_filed", "p/q/r/s/videos/lone": "lone", "lone": "lone", "/p/q/r/s/t/lone": "lone"}
    names = spark.createDataFrame([(n,) for n in want], "video_id string")
    assert {r["video_id"]: r["video"] for r in find_videos(names, files).attach(names, F.col("video_id")).collect()} == want


def test_spelling_is_an_expression(spark):
    df = spark.createDataFrame([("a+b%20c.mp4",), ("%zz",)], "v string")
    assert [r[0] for r in df.select(spelled(F.col("v"))).collect()] == ["a+b c", "%zz"]


def test_splits_balance_hot_groups(spark):
    rows = [(i, "hot" if i < 900 else f"g{i % 700}", "s1" if i % 3 else "s2", "clash") for i in range(3000)] + [(5000 + i, None, None, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, s string, assigned string")
    got = assign_splits(df, "g", "s", "id", [("train", 0.8), ("val", 0.1), ("test", 0.1)]).toPandas()
    assert len(got) == len(rows) and got["assigned"].notna().all()
    assert (got[~got["g"].str.startswith("\x00")].groupby("g")["assigned"].nunique() == 1).all()
    share = got["assigned"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.04 and abs(share["val"] - 0.1) < 0.03
    assert assign_splits(df.limit(0), "g", "s", "id", [("train", 1.0)]).count() == 0


# 4


def members(moments):
    cell, target = np.nonzero(np.array(moments))
    return Members(cell, target)


def test_tilting_meets_its_goals():
    count, goals = np.array([100.0, 50.0, 10.0]), np.array([20.0, 30.0, 4.0])
    assert count * tilt(count, members(np.eye(3)), goals, 0.2) == pytest.approx(goals)
    two = np.array([[1.0, 0], [1, 1], [0, 1]])
    p = tilt(count, members(two), np.array([60.0, 30.0]), 0.2)
    assert two.T @ (count * p) == pytest.approx([60, 30])


def test_tilting_of_very_many_targets():
    rng = np.random.default_rng(3)
    count = rng.integers(5, 500, 100_000).astype(float)
    rows, columns = rng.integers(0, 300, 100_000), 300 + rng.integers(0, 400, 100_000)
    margins = Members(np.tile(np.arange(100_000), 2), np.concatenate([rows, columns]))
    goals = margins.over_cells(count * 0.2 * np.exp(rng.normal(0, 0.3, 300)[rows] + rng.normal(0, 0.3, 400)[columns - 300]), 700)
    began = time.time()
    assert margins.over_cells(count * tilt(count, margins, goals, 0.2), 700) == pytest.approx(goals, rel=1e-6)
    each = Members(np.arange(100_000), np.arange(100_000))
    assert count * tilt(count, each, count * 0.3, 0.2) == pytest.approx(count * 0.3)
    assert time.time() - began < 60


def test_rates_of_short_and_small_categories():
    count, own = np.array([1000.0, 5.0, 100.0, 0.0]), members(np.eye(4))
    goals = plan_goals(count, np.array([0.5, 0.3, 0.01, 0.19]), np.array([0.0, 0, 20, 5]), 200.0, np.zeros(4, int))
    rate = plan_rates(count, own, goals, 0.2)
    assert rate[1] == 1 and rate[2] == pytest.approx(0.2) and rate[3] == 0
    assert count @ rate == pytest.approx(200)
    tight = plan_rates(np.array([10.0, 100.0, 100.0]), members([[1, 1], [1, 0], [0, 1]]), np.array([90.0, 50.0]), 0.3)  # the first would be drawn 1.3 times
    assert (tight <= 1).all() and 10 * tight[0] + 100 * tight[1] == pytest.approx(90) and 10 * tight[0] + 100 * tight[2] == pytest.approx(50)


def test_sample_of_margins(spark):
    rows = [(f"r{i}", "xyz"[i % 3] if i % 50 else None, (i * i) % 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, band string, hops long")
    targets = spark.createDataFrame([("x", None, 0.6, 0), ("y", None, 0.3, 0), ("z", None, 0.1, 0), (None, 0, 0.3, 0), (None, 1, 0.7, 0)], "band string, hops long, target_share double, min_rows long")
    got = sample_to_targets(df, ["band", "hops"], "id", targets, 0.2)
    report = {(r["band"], r["hops"]): r for r in got.report.collect()}
    want = {("x", None): 360, ("y", None): 180, ("z", None): 60, (None, 0): 180, (None, 1): 420}
    assert {k: round(r["planned"], 3) for k, r in report.items()} == want and all(abs(report[k]["sampled"] - n) <= 4 for k, n in want.items())
    assert got.rows.count() == got.rows.distinct().count() == 600 and got.rows.schema == df.schema


def test_pivotal_keeps_probabilities():
    rng, p, hits = np.random.default_rng(1), np.array([0.2, 0.7, 0.6, 0.5, 1.0, 0.0]), np.zeros(6)
    for _ in range(4000):
        taken, at, a = pivotal(p, rng.random(6))
        assert at < 0 and taken.sum() == 3
        hits += taken
    assert hits / 4000 == pytest.approx(p, abs=0.03)


def test_sample_on_odd_input(spark):
    rows = [(i, "a" if i % 3 else None, i % 2, "c") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, band string, hops long, cat string")
    targets = spark.createDataFrame([("a", 0, 0.9, 1), ("a", 1, 0.1, 30), ("none", 1, 0.5, 4), ("a", 0, 0.9, 1)], "band string, hops long, target_share double, min_rows long")
    got = sample_to_targets(df, ["band", "hops"], "id", targets, 0.3)
    report = {(r["band"], r["hops"]): r for r in got.report.collect()}
    assert got.rows.count() == 60 and report["a", 1]["sampled"] == 30 and report["none", 1]["short"] and report["none", 1]["gap"] == 30
    assert got.rows.columns == df.columns
    empty = sample_to_targets(df.limit(0), ["band", "hops"], "id", targets, 0.3)
    assert empty.rows.count() == 0 and empty.report.count() == 3


# 5 and 6


def messages(rng, n, videos):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.45:
            video, _, text = rng.choice(rows)[1:]
            said = text.split()
            for _ in range(rng.randrange(0, 4)):
                if said:
                    said[rng.randrange(len(said))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(said)
            text = " ".join(said)
        else:
            video, text = rng.choice(videos), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        rows.append((i, video, rng.randrange(1, 3), text))
    return rows


def brute(rows, cross):
    bags = {i: Counter(t.split()) for i, _, _, t in rows}
    out = set()
    for i, v, s, _ in rows:
        for j, w, r, _ in rows:
            if i < j and v == w and (not cross or s != r):
                both = sum((bags[i] & bags[j]).values())
                whole = sum((bags[i] | bags[j]).values())
                if both >= 0.75 * whole:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("local", [4096, 30])
def test_near_pairs_against_brute_force(spark, cross, local):
    rows = messages(random.Random(9), 500, ["hot", "hot", "hot", "a", "b"])
    df = spark.createDataFrame(rows, "ident long, video string, side int, text string").repartition(5)
    links = N.near_links(df, errors=0 if cross else 1, cross=cross, local=local)
    got = {tuple(r) for r in N.expand(links.cache(), cross).collect()}
    want = brute(rows, cross)
    assert got == want


@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("local", [100_000, 4096, 30])
def test_no_pair_at_the_limit_is_missed(spark, cross, local):
    rng, rows = random.Random(4), []
    for k in range(2500):  # 36 of 48 words in common
        words = [f"w{x}" for x in rng.sample(range(3000), 48)]
        rows += [(2 * k, "hot", 1, " ".join(words[:42])), (2 * k + 1, "hot", 2, " ".join(words[6:]))]
    df = spark.createDataFrame(rows, "ident long, video string, side int, text string").repartition(5)
    links = N.near_links(df, errors=0 if cross else 1, cross=cross, local=local)
    assert {(r["row_id_a"], r["row_id_b"]) for r in links.collect()} == {(2 * k, 2 * k + 1) for k in range(2500)}


def test_near_bags_of_all_sizes(spark):
    rng, rows = random.Random(5), []
    for k, n in enumerate([1, 2, 3, 4, 7, 8, 40, 84, 85, 112, 168, 169, 400, 1000, 5000] * 6):
        words = [f"w{x}" for x in rng.sample(range(60_000), n)]
        common = -(-3 * n // 4)
        near, far = words[:common], words[: common - 1] + [f"x{x}" for x in range(n // 50)]
        rows += [(3 * k + i, "v", 1 + i % 2, " ".join(w)) for i, w in enumerate((words, near, far))]
    want = {cross: brute(rows, cross) for cross in (False, True)}
    df = spark.createDataFrame(rows, "ident long, video string, side int, text string")
    for cross, local in [(False, 4096), (True, 4096), (False, 30), (True, 30)]:
        assert {tuple(r) for r in N.expand(N.near_links(df, cross=cross, local=local).cache(), cross).collect()} == want[cross]


def test_messages_on_odd_input(spark):
    rows = [(1, "v", 0, ""), (2, "v", 0, "!!"), (3, "v", 0, None), (4, None, 0, "a b"), (5, None, 0, "a b"), (6, "w", 0, "one two"), (6, "w", 0, "one two"), (7, "w", 0, "ONE, two!"), (8, "w", 0, "x " * 50_000), (9, "w", 0, "x " * 50_001)]
    df = spark.createDataFrame(rows, "ident long, video string, side int, text string").withColumns({"vk": F.lit(1), "n": F.lit(2)})
    got = {tuple(r) for r in N.expand(N.near_links(df).cache()).collect() if r[0] != r[1]}
    assert got == {(1, 2), (6, 7), (8, 9)}
    assert N.expand(N.near_links(df.limit(0)).cache()).count() == 0


def test_layout_grows_slowly():
    assert N.layout(64, 1) == (4, 9) and N.layout(300_000, 0)[0] == 10
    assert N.layout(10**9, 1)[1] < 200


@pytest.mark.parametrize("n", [8, 4096, 1 << 19, 1 << 26])
@pytest.mark.parametrize("errors", [0, 1])
def test_layout_misses_no_more_than_it_says(n, errors):
    c, m = N.layout(n, errors, 0.75, 1e-2)
    assert m * c < N.layout(n, errors)[1] * c
    rng = np.random.default_rng(n + errors)
    missed, tries = 0, 3000
    for _ in range(tries):
        differ = rng.random((m, c)) >= 0.75
        missed += (differ.sum(axis=1) > errors).all()
    assert missed / tries < 0.017
    assert (1 - sum(math.comb(c, i) * 0.25**i * 0.75 ** (c - i) for i in range(errors + 1))) ** N.layout(n, errors)[1] <= 1e-5


def test_minwise_symbols_agree_as_often_as_bags():
    rng = random.Random(8)
    for share in (0.3, 0.75):
        common, n = round(share * 120), 120
        words = rng.sample(range(1 << 40), n)
        a, b = words[: n - (n - common) // 2], words[(n - common) // 2 + (n - common) % 2 :]
        a, b = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = N.Bags(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).minwise(6000)
        assert (s[0] == s[1]).mean() == pytest.approx(both + (1 - both) / 256, abs=0.025)


def test_rows_of_many_blocks(spark, monkeypatch):
    """Parts dealt by halves of chunks give the same pairs."""
    rng, rows = random.Random(14), []
    for k in range(300):
        words = [f"w{x}" for x in rng.sample(range(3000), 48)]
        rows += [(2 * k, "hot", 1, " ".join(words[:42])), (2 * k + 1, "hot", 2, " ".join(words[6:]))]
    ident = np.arange(600)
    bags = [sorted(hash(w) & (2**64 - 1) for w in r[3].split()) for r in rows]
    held = N.Bags(np.array(sum(bags, []), np.uint64), np.cumsum([0, *map(len, bags)]))
    monkeypatch.setattr(N, "BLOCK", 100)
    for errors in (0, 1):
        c, m = N.layout(1024, errors)
        symbols, found = held.minwise(c * m), set()
        for part, chunk in N._parts(symbols, 1024, c, m, errors):
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                table = pa.table({
                    "ident": ident[at], "side": np.array([r[2] - 1 for r in rows])[at], "size": held.size[at], "n": np.full(len(at), 1024), "part": part[at],
                    "parity": pa.array([x.tobytes() for x in N.parities(held.take(at))], pa.binary()), "symbols": N._binary(chunk[at]),
                })
                for cross in (False, True):
                    out = N._cell(0.75, errors, cross)(table)
                    found |= {(cross, min(a, b), max(a, b)) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
        assert {(x, 2 * k, 2 * k + 1) for x in (False, True) for k in range(300)} <= found and len(found) < 700


def test_shingles_see_the_order_of_words(spark):
    rows = [(1, "v", 1, "a b c d e f"), (2, "v", 2, "f e d c b a"), (3, "v", 2, "A, b c d e f!"), (4, "v", 1, "x"), (5, "v", 2, "x"), (6, "v", 2, "")]
    df = spark.createDataFrame(rows, "ident long, video string, side int, text string")
    one, five = ({tuple(r) for r in N.expand(N.near_links(df, shingle=k).cache()).collect()} for k in (1, 5))
    assert one == {(1, 2), (1, 3), (2, 3), (4, 5)} and five == {(1, 3), (4, 5)}


def test_user_messages(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "<video>\nA b"), ("User", None)],), ([],), (None,)], "p array<struct<role:string,content:string>>")
    assert [r[0].split() for r in df.select(user_message(F.col("p"))).collect()] == [["A", "b"], [], []]
    assert [len(r[0]) for r in df.select(word_hashes(user_message(F.col("p")))).collect()] == [2, 0, 0]


# 7


def test_fill_is_the_closest_sum():
    assert fill([7, 5, 3], {7: 1, 5: 1, 3: 1}, 10) == {7: 1, 3: 1}
    assert fill([4], {4: 9}, 10) == {4: 2}
    assert fill([50], {50: 1}, 10) == {}
    rng = random.Random(3)
    for _ in range(60):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 30), 5)}
        room = rng.randrange(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        used = fill(sorted(counts, reverse=True), counts, room)
        assert sum(n * c for n, c in used.items()) == max(sums) and all(c <= counts[n] for n, c in used.items())


def test_plan_uses_every_item_once():
    histogram = {n: (n * 37) % 11 + 1 for n in range(1, 200)}
    patterns = plan(histogram, 256)
    used = Counter()
    for p in patterns:
        assert sum(n * c for n, c, _ in p.parts) <= 256
        for n, c, _ in p.parts:
            used[n] += c * p.times
    assert used == Counter(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert sum(p.times for p in patterns) <= -(-total // 256) + 1


def test_pack_on_odd_input(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 25), ("e", -3), ("a", 10), ("f", 1)], "piece string, start long")
    caps = spark.createDataFrame([("p", 10), ("q", None), ("r", 0), ("p", 8), (None, 5)], "pack_name string, capacity long")
    got = pack(sizes.toDF("doc", "size"), "doc", "size", caps).toPandas()
    assert set(got["pack_name"]) == {"p"} and got.groupby("container_id")["size"].sum().max() == 10
    assert got["size"].sum() == 46 and got.groupby("doc")["size"].sum().to_dict() == {"a": 20, "d": 25, "f": 1}
    assert pack(sizes.limit(0).toDF("doc", "size"), "doc", "size", caps).count() == 0
    assert pack(sizes.toDF("doc", "size"), "doc", "size", caps.limit(0)).count() == 0


def test_pack_in_units_and_by_join(spark, monkeypatch):
    from rillflow.llm import pack as P

    monkeypatch.setattr(P, "UNITS", 64)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 3)
    sizes = spark.createDataFrame([(f"d{i}", 1 + (i * 37) % 450) for i in range(700)], "doc string, size long")
    caps = spark.createDataFrame([("large", 1000), ("small", 60), ("odd", 129)], "pack_name string, capacity long")
    got = pack(sizes, "doc", "size", caps).toPandas()
    total = sum(1 + (i * 37) % 450 for i in range(700))
    for name, capacity in (("large", 1000), ("small", 60), ("odd", 129)):
        part = got[got["pack_name"] == name]
        held = part.groupby("container_id")["size"].sum()
        assert part["size"].sum() == total and held.max() <= capacity and (part.groupby("doc").size() == [-(-n // capacity) for n in part.groupby("doc")["size"].sum()]).all()
        assert len(held) <= 1.08 * total / capacity + 1


def test_pack_spreads_a_hot_length(spark):
    sizes = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50 + 1).alias("n"))
    caps = spark.createDataFrame([("p", 64)], "pack_name string, capacity long")
    got = pack(sizes, "id", "n", caps)
    assert got.count() == 5000 and got.groupBy("container_id").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 64
    assert got.select("container_id").distinct().count() <= 1.005 * sizes.agg(F.sum("n")).first()[0] / 64


# 8


def test_balance_reaches_goals_or_limits():
    size, count = np.array([5, 50, 500]), np.array([40, 10, 3])
    whole = float(size @ count)
    for goal in (1.0, 0.01 * whole, 0.3 * whole, whole, 1.7 * whole, 2.9999 * whole):
        for moments in (("tokens",), ("tokens", "records")):
            rate = balance(size, count, goal, 3, moments)
            assert count @ (size * rate) == pytest.approx(goal, rel=1e-8) and (rate <= 3 + 1e-12).all()
    less, same = balance(size, count, 0.3 * whole, 3), balance(size, count, 0.3 * whole, 3, ("tokens", "records"))
    assert less[0] > less[1] > less[2] and np.log(less) / size == pytest.approx([np.log(less[0]) / 5] * 3) and same == pytest.approx([0.3] * 3)
    assert balance(size, count, 9 * whole, 3).tolist() == [3, 3, 3] and not balance(size, count, 0, 3).any() and not balance(size, count, 5, 0).any()


def test_blend_passes_gaps_on(spark):
    sizes = spark.createDataFrame([(i, "abc"[i % 3] if i < 300 else "few", 10 + i % 40) for i in range(330)], "id long, source string, n long")
    targets = spark.createDataFrame([("few", 0.5, 2), ("a", 0.25, 9), ("b", 0.25, 2)], "source string, target_share double, max_repeats long")
    for fill in (False, True):
        report = {r["source"]: r for r in blend(sizes, "id", "source", "n", targets, fill_gaps=fill).report.collect()}
        assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1) and [s for s, r in report.items() if r["short"]] == ["few"]
        total = sum(r["reached_share"] for r in report.values())
        assert total == pytest.approx(1, abs=0.01) if fill else total < 0.75
    assert abs(report["a"]["blended_tokens"] - report["b"]["blended_tokens"]) <= 50


def test_blend_on_odd_input(spark):
    rows = [(i, "a" if i % 4 else "hot", 5 + i % 90, 1) for i in range(900)] + [(1000, None, 40, 1), (1001, "a", None, 1), (1002, "a", 0, 1), (1002, "a", -5, 1)]
    sizes = spark.createDataFrame(rows, "id long, source string, n long, copies int")
    targets = spark.createDataFrame([("a", 0.5, 3), ("hot", 0.9, 2), ("gone", 0.1, 5), ("a", 0.5, 3), (None, 0.2, 1), ("zero", None, None)], "source string, target_share double, max_repeats long")
    got = blend(sizes, "id", "source", "n", targets)
    report = {r["source"]: r for r in got.report.collect()}
    total = sum(r[2] for r in rows if r[2] and r[2] > 0)
    assert report["hot"]["short"] and report["hot"]["most_copies"] == 2
    assert abs(report["a"]["blended_tokens"] - total / 2) <= 50 and report["gone"]["short"] and not report["zero"]["short"]
    assert blend(sizes.limit(0), "id", "source", "n", targets).copies.count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 20_000), (5, "नमस्ते 你好")], "id long, t string")
    got = {r["id"]: r["n_tokens"] for r in with_tokens(df, "id", "t").collect()}
    assert got[1] >= 2 and got[2] == 0 and got[3] == 0 and got[4] > 100 and got[5] > 2


# 9


def cut_at(marked):
    """A text with | after each sentence, as text and ends."""
    ends, text = [], ""
    for part in marked.split("|"):
        text += part
        ends.append(len(text))
    return text, ends[:-1]


CASES = [
    "See Eq. 3 and Eqs. 4 to 6.| Siehe Abschn. 4 dazu.| Call tel. 555 now.|",
    "Dr. Besmin lifts it.| Mr. A. B. Cole leaves at 6 a.m.| The bell rings.|",
    "It seems... or appears... that it stays dry.| The girl waits...| A man leaves…| iCam footage gives 5.78 as the reading.|",
    'A board reading "Stop. Look. Listen." hangs here.| The boy says, "It is open!"| (A man waits.)| Is F really 16, or is it 9?|',
    "Wait... 65 was counted twice, i.e. F stays at 16.| Price: 22.41 per kg.| Gate 2 closes at 2:36 p.m. sharp.|",
    "Give the value of A + B + C.| Hop 3 is ambiguous (see seg. 12, approx. 20.3 s).| Next one.|The last.|",
    "Shot list|\n[seg 0 | 0.0-4.5 s] He waits?!| She goes|\r\n1. One.| Two|\n- Three.|".replace("seg 0 | 0.0", "seg 0 / 0.0"),
    "Hr. Wendolt misst z. B. Holz um 7.30 Uhr seit dem 3. Juni.| Sie ruft: „Wer hält die Kanne?“| Das Schild „Halt. Nicht betreten.“ fällt im 2. Stock.|",
    "M. Tervois tourne le panneau « Halte. Danger ! » près de la fenêtre.| Elle dit : « Qui tient le seau ? »| Où est-il ?|",
    "¿Quién gira el balde?| La Dra. Ontier mira a las 7.30 p. m. en el andén.| Entonces dice: «¿Dónde está?»| Fin.|",
    "А. Б. Торвин идёт на ул. Садовой 3,5 с.| Она говорит: «Где ведро?»| Чашки, ложки и т. д. подряд.|",
    "Ποιος κρατά τη σκάλα;| Η κα. Μυρτάνη ανοίγει, π.χ. λάμπα, για 3,5 δ. συνολικά.|",
    "骑车的邮差说：“门还没有关好。”|随后，No. 7号选手举起写着“请勿入内。闲人止步。”的牌子。|（画面中，下雨了。）|大约3.5秒后……|两个孩子笑？！|",
    "「早く見て。」|白黒の猫が「静かに。まだです。」と言いながら手を振る｡|No. 7の選手がclip_2.mp4を再生する……|青い帽子！|",
    "요리사가 “멈추시오. 위험.”이라는 표지판을 돌린다.| 양동이를 어디에 있는가?|",
    "डॉ. वेलारी 2.5 मी. लंबी रस्सी देखता है।| वह कहती है, “छाता कहाँ है?”| बूढ़ी औरत “रुकिए। खतरा।” लिखा बोर्ड रंगता है.| अंत।|",
    "د. نوارين يدفع لافتة «قف. خطر!» في المطبخ.| من يحمل الدلو؟| ثم يقول: «أين السلم؟»| انظر ص. 12 هنا.|",
    "سرخ کوٹ والا ”رکیں۔ خطرہ۔“ لکھا بورڈ دیکھتا ہے۔| پیالہ کہاں ہے؟|",
    "ሰውየው «ቁም። አደጋ።» የሚለውን ሰሌዳ ያያል።| ዶ/ር ተላሪ ቁ. 7 ሰዓቱን ያነሳል።|",
    "แมวสีดำวางถ้วย 3 ใบหน้าเวที| พ่อครัวถือป้าย “หยุด. อันตราย” ไว้ในห้องครัวครับ| หญิงชราปรับเป็น 2.5 องศา| A man waits.|",
]


@pytest.mark.parametrize("marked", CASES)
def test_sentence_cases(marked):
    text, ends = cut_at(marked)
    assert sentence_ends(text) == ends, [text[a:b] for a, b in zip([0, *sentence_ends(text)], sentence_ends(text))]


@pytest.mark.parametrize("marked", [
    "まだ見ていません……|と彼は言った。|", "もう行きましょう……|とにかく急ぐ。|", "猫が……の上にいる。|", "「はい……と答えた。」|",
    "她说：“快走吧！”|地球在转动。|", "她说：“快走吧！”|或许下雨了。|", "“快走吧！”的声音传来。|", "「早く来て。」|とにかく急ぐ。|", "「早く来て。」|にわとりが鳴く。|", "「早く来て。」と呼ぶ。|",
    "ឆ្មាដេក។| ឆ្កែរត់។|", "ឆ្មាដេក ហើយឆ្កែរត់។|ក្មេងយំ។|", "ကြောင်အိပ်သည်။| ခွေး၊ ငှက်ပြေးသည်။|ကလေးငိုသည်။|", "བཀྲ་ཤིས། །|བདེ་ལེགས།| ཁྱི་རྒྱུག།|",
    "ແມວນອນ| ໝາແລ່ນ 3 ຕົວ| ເດັກໄຫ້|", "ܫܠܡܐ܀| ܟܬܒܐ܂|", "ᠮᠣᠷᠢ᠃| ᠨᠣᠬᠠᠢ᠃|", "ꦏꦸꦕꦶꦁ꧉| ꦲꦱꦸ꧉|", "Value 3․5 holds.| Next.|",
    "ขอบคุณครับ| 3 คนเดินไป|", "ไปไหมคะ| 2 คนตอบ|", "ทีมชนะ 3 ครั้ง|", "ไปแล้ว 3 ครั้ง|",
])
def test_particles_and_words_beside_gaps(marked):
    text, ends = cut_at(marked)
    assert sentence_ends(text) == ends, [text[a:b] for a, b in zip([0, *sentence_ends(text)], sentence_ends(text))]


def test_sentences_on_odd_input(spark):
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n\ufeff\t") == sentence_ends("...\n!!") == []
    assert sentence_ends("1.\nThe end.") == [11] and sentence_ends("no mark") == [7]
    assert sentence_ends('He said "never closed. Then left. ') == [22, 33]
    assert len(sentence_ends("A cat sat. " * 20_000)) == 20_000
    df = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, "  ")], "doc_id long, end_char string")
    assert sorted(tuple(r) for r in sentences(df, "doc_id", "end_char").select("doc_id", "end_char").collect()) == [(1, 4), (1, 4), (1, 9), (1, 9)]
    assert sentences(df.limit(0), "doc_id", "end_char").count() == 0


def test_lattice_prefers_whole_words():
    first_word = PLAIN.first_word
    assert first_word("的牌子", 0, 3) == "的" and first_word("的确如此", 0, 4) == "的确"
    assert first_word("と書かれた", 0, 5) == "と書かれた" and first_word("とても", 0, 3) == "とても"


def test_a_model_of_the_corpus(spark):
    """Words, openers and abbreviations that no list holds."""
    rng, texts = random.Random(2), []
    nouns, verbs = ["地蔵", "少年", "料理", "黒猫"], ["走る", "歩く", "見る", "休む"]
    for _ in range(400):
        first, second = rng.choice(nouns), rng.choice(nouns)
        texts.append(f"{first}が{second}を{rng.choice(verbs)}。{second}が{first}と{rng.choice(verbs)}。")
        texts.append(f"The box of qty. {rng.choice(['Nine', 'Ten', 'four'])} stands by the {rng.choice(['wall', 'door'])}. It is left there with a note of {rng.choice(['wall', 'door'])} and glass.")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "")], "id long, text string")
    model = learn(df, "text")
    assert {"地蔵", "少年"} <= set(model.words) and model.opens["少年が"] and "qty" in model.never and not {"wall", "door", "glass"} & model.never
    lexicon = Lexicon(model)
    assert lexicon.first_word("地蔵が走る", 0, 5) == "地蔵" and PLAIN.first_word("地蔵が走る", 0, 5) == "地"
    text = "「早く見て。」地蔵が走る。See qty. Nine here."
    assert sentence_ends(text, lexicon) == [7, 13, len(text)] and sentence_ends(text) == [13, 21, len(text)]
    got = [r["end_char"] for r in sentences(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", model).collect()]
    assert got == sentence_ends(text, lexicon)
    assert learn(df.limit(0), "text") == NO_MODEL
