"""Queries of the nine problems over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.cap import Capped, cap_contributors
from rillflow.llm.cutoff import score_cutoffs
from rillflow.llm.identity import Videos, connected_components, find_videos
from rillflow.llm.mix import Blend, blend
from rillflow.llm.near import expand, near_links
from rillflow.llm.pack import fill_report, pack
from rillflow.llm.sample import Sample, sample_to_targets
from rillflow.llm.sentences import sentences
from rillflow.llm.splits import assign_splits
from rillflow.llm.text import clean_name, known_rate, user_message
from rillflow.llm.tokens import with_tokens
from rillflow.scale import cut

#: Rows of a video that p2 leaves, share of the corpus that p4 draws, similarity of near messages, allowance of p1_found.
CAP, FRACTION, NEAR, WITHIN = 15, 0.2, 0.75, 0.02
#: Rows of split_targets that the driver takes.
MOST_SPLITS = 1000


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _videos(spark: SparkSession, d: str) -> Videos:
    return find_videos(_read(spark, d, "corpus_rows").select("extra_info.video_id"), _read(spark, d, "video_files").select("video_id", "n_bytes", "content_sha1"))


# 1: cutoffs


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    targets = _read(spark, d, "keep_targets").select(clean_name(F.col("data_source")).alias("source"), F.col("target_keep").alias("target"))
    rows = _read(spark, d, "corpus_rows")
    out = score_cutoffs(rows, clean_name(F.col("data_source")), known_rate(F.col("extra_info.solve_rate")), targets)
    return out.select(F.col("source").alias("data_source"), F.col("target").alias("target_keep"), "cutoff", F.col("known").alias("known_rows"), F.col("kept").alias("kept_rows"), F.col("share").alias("kept_share"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    off = F.col("kept_share").isNull() | (F.abs(F.col("kept_share") - F.col("target_keep")) > WITHIN + 1e-9)
    return p1_cutoffs(spark, d).where(off).select("data_source")


# 2: caps


def _capped(spark: SparkSession, d: str) -> Capped:
    rows = _read(spark, d, "corpus_rows").select("row_id", F.col("extra_info.video_id").alias("video_id"), known_rate(F.col("extra_info.solve_rate")).alias("rate"))
    # a rate near one half teaches most; always right or always wrong teaches nothing
    useful = _videos(spark, d).attach(rows, F.col("video_id")).withColumn("useful", 1 - F.abs(2 * F.col("rate") - 1))
    return cap_contributors(useful, "video", "useful", "row_id", cap=CAP, name="video_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).report.where("lost > 0").select(F.col("name").alias("video_id"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).report.select(F.col("name").alias("video_id"), "total", "kept", "lost")


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).kept.select("row_id", "video_id", "rate")


# 3: splits


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stored = _read(spark, d, "corpus_rows").select(F.col("extra_info.video_id").alias("video_id")).where("video_id is not null").distinct()
    named = _videos(spark, d).attach(stored, F.col("video_id")).where("video is not null")
    a, b = named.alias("a"), named.alias("b")
    same = a.join(b, (F.col("a.video") == F.col("b.video")) & (F.col("a.video_id") < F.col("b.video_id")))
    return same.select(F.col("a.video_id").alias("video_id_a"), F.col("b.video_id").alias("video_id_b"))


def p3_videos(spark: SparkSession, d: str) -> DataFrame:
    """Every stored name with its video's: the classes behind the pairs of p3_found."""
    stored = _read(spark, d, "corpus_rows").select(F.col("extra_info.video_id").alias("video_id")).where("video_id is not null").distinct()
    named = _videos(spark, d).attach(stored, F.col("video_id")).where("video is not null")
    sizes = named.groupBy("video").agg(F.min("video_id").alias("first_id"), F.count(F.lit(1)).alias("names"))
    return named.join(sizes, "video").select("video_id", "first_id", "names")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "corpus_rows").select("row_id", F.col("extra_info.video_id").alias("video_id"), clean_name(F.col("data_source")).alias("data_source"))
    targets = [(r["split"], r["target_share"]) for r in _read(spark, d, "split_targets").limit(MOST_SPLITS + 1).collect()]
    if len(targets) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    return assign_splits(_videos(spark, d).attach(rows, F.col("video_id")), "video", "data_source", "row_id", targets)


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every row has one, and no video has two."""
    splits = cut(p3_splits(spark, d))
    torn = splits.where("video is not null").groupBy("video").agg(F.countDistinct("assigned").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn_videos"))
    return splits.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("assigned").isNull()).alias("unassigned")).join(F.broadcast(torn))  # one row each


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = p3_splits(spark, d).groupBy("data_source", "assigned").agg(F.count(F.lit(1)).alias("n_rows"))
    both = counts.unionByName(counts.groupBy("assigned").agg(F.sum("n_rows").alias("n_rows")).withColumn("data_source", F.lit("(all)")))
    whole = both.groupBy("data_source").agg(F.sum("n_rows").alias("of_rows"))
    return both.join(whole, "data_source").withColumn("share", F.col("n_rows") / F.col("of_rows"))


# 4: samples


def _sampled(spark: SparkSession, d: str) -> Sample:
    rows = _read(spark, d, "corpus_rows").select("row_id", clean_name(F.col("extra_info.difficulty_band")).alias("difficulty_band"), F.col("extra_info.num_hops").alias("num_hops"))
    targets = _read(spark, d, "sample_targets").withColumn("difficulty_band", clean_name(F.col("difficulty_band")))
    return sample_to_targets(rows, ["difficulty_band", "num_hops"], "row_id", targets, FRACTION)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).report.where("short").select("difficulty_band", "num_hops")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).report


def p4_goals(spark: SparkSession, d: str) -> DataFrame:
    """Of the report what doesn't hang on the draw, and whether the drawn rows are within one of their plan."""
    near = F.abs(F.col("sampled") - F.col("planned")) < 1 + 1e-6
    return p4_report(spark, d).select("difficulty_band", "num_hops", "available", F.round("wanted", 6).alias("wanted"), "short", near.alias("near_plan"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d).rows


# 5 and 6: near messages


def _messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "corpus_rows").select(F.col("row_id").alias("ident"), F.col("extra_info.video_id").alias("video_id"), "split", clean_name(F.col("data_source")).alias("data_source"), clean_name(F.col("extra_info.question_id")).alias("question_id"), user_message(F.col("prompt")).alias("text"))
    return _videos(spark, d).attach(rows, F.col("video_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(cut(near_links(_messages(spark, d).withColumn("side", F.lit(0)), NEAR)))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """``row_id, class_id, group_id, n_links``: rows of groups of near messages; a class is of equal messages, links are its near classes."""
    links = cut(near_links(_messages(spark, d).withColumn("side", F.lit(0)), NEAR))
    grouped = connected_components(links.select(F.col("row_id_a").alias("u"), F.col("row_id_b").alias("v")))
    classes = links.where("kind = 0").select(F.col("row_id_b").alias("row_id"), F.col("row_id_a").alias("class_id"))
    pairs = links.where("kind = 1")
    degree = pairs.select(F.col("row_id_a").alias("class_id")).unionByName(pairs.select(F.col("row_id_b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    rows = grouped.select(F.col("node").alias("row_id"), F.col("component").alias("group_id")).join(classes, "row_id", "left").withColumn("class_id", F.coalesce("class_id", "row_id"))
    return rows.join(degree, "class_id", "left").select("row_id", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """``train, held, by_question, by_message`` of every pair of a train row and a row of another split."""
    split = clean_name(F.col("split"))
    side = F.when(split == "train", 1).when(split.isin("val", "validation", "test"), 2)
    rows = _messages(spark, d).withColumn("side", side).where("side is not null and video is not null")
    near = cut(near_links(rows, NEAR, errors=0, cross=True))
    message = expand(near, cross=True)
    keyed = rows.where("question_id <> ''").select("ident", "video", "question_id", "side")
    a, b = keyed.where("side = 1"), keyed.where("side = 2")
    question = a.join(b.withColumnRenamed("ident", "held"), ["video", "question_id"]).select(F.least("ident", "held").alias("row_id_a"), F.greatest("ident", "held").alias("row_id_b"))
    both = message.withColumn("m", F.lit(1)).withColumn("q", F.lit(0)).unionByName(question.withColumn("m", F.lit(0)).withColumn("q", F.lit(1)))
    return both.groupBy("row_id_a", "row_id_b").agg((F.max("q") == 1).alias("by_question"), (F.max("m") == 1).alias("by_message"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("row_id_a", "row_id_b")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the held-out row: pairs with train, by question and by message, and the rows they touch."""
    pairs = _overlaps(spark, d)
    split = clean_name(F.col("split"))
    held = _read(spark, d, "corpus_rows").select("row_id", F.when(split == "validation", "val").otherwise(split).alias("split"), clean_name(F.col("data_source")).alias("data_source")).where("split in ('val', 'test')")
    ends = pairs.withColumn("row_id", F.explode(F.array("row_id_a", "row_id_b"))).join(held, "row_id")
    flag = [F.sum(F.col(c).cast("long")).alias(c) for c in ("by_question", "by_message")]
    each = ends.groupBy("split", "data_source", "row_id").agg(F.count(F.lit(1)).alias("pairs"), *flag)
    return each.groupBy("split", "data_source").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("held_rows"), *[F.sum(c).alias(c) for c in ("by_question", "by_message")])


# 7: containers


def _sizes(spark: SparkSession, d: str, keep: list[str] = ()) -> DataFrame:
    return cut(with_tokens(_read(spark, d, "documents").withColumn("source", clean_name(F.col("source"))), "doc_id", "text", keep))


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pack_sizes").select("pack_name", F.col("capacity_tokens").alias("capacity"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), "doc_id", "n_tokens", _packs(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: none is overfull, no text that fits is cut, numbers run on without gaps."""
    packs = _packs(spark, d).groupBy("pack_name").agg(F.max("capacity").alias("capacity"))
    placed = cut(p7_containers(spark, d)).join(F.broadcast(packs), "pack_name")  # a few capacities
    held = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("held"), F.first("capacity").alias("capacity"))
    full = held.groupBy("pack_name").agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"), (F.max("container_id") + 1 - F.count(F.lit(1))).alias("numbers_missing"))
    texts = placed.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.first("capacity").alias("capacity"))
    cuts = texts.groupBy("pack_name").agg(F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("cut_needlessly"))
    return packs.join(full, "pack_name").join(cuts, "pack_name").select("pack_name", "capacity", "overfull", "cut_needlessly", "numbers_missing")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_containers(spark, d), "n_tokens", _packs(spark, d))


# 8: mixing


def _blended(spark: SparkSession, d: str) -> Blend:
    targets = _read(spark, d, "mix_targets").withColumn("source", clean_name(F.col("source")))
    return blend(_sizes(spark, d, ["source"]), "doc_id", "source", "n_tokens", targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d).report.where("short").select("source")


def p8_blend(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d).copies


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d).report


# 9: sentences


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", "end_char")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(_read(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_cutoffs, p2_found, p2_report, p2_kept, p3_found, p3_videos, p3_splits, p3_shares, p3_checks, p4_found, p4_report, p4_goals, p4_sample, p5_found, p5_groups,
        p6_found, p6_counts, p7_containers, p7_fill, p7_checks, p8_found, p8_blend, p8_report, p9_found, p9_sentences,
    )
    return {f.__name__: f for f in named}
