"""Which stored video names are one video: spellings, places of files, and files of equal content.

Names are brought to one spelling by an expression; places lose their root by a join with the ids that are known; ids that share
content are joined by connected components (alternating large-star and small-star steps). Only distinct names ever move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.text import spelled
from rillflow.scale import attach_small, cut

#: SHA-1 of no bytes: the hash of a failed copy.
EMPTY_SHA1 = "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the undirected edges ``u, v``; a component is named by its smallest node.

    Large-star hangs each node's larger neighbours under its smallest neighbour, small-star its smaller ones; both are repeated
    until no edge changes. The rounds grow with the logarithm of the longest path, a hot node's edges are combined before they
    move and its join is left to adaptive skew handling. Null ends and loops are dropped; repeated edges count once. No edges: no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = cut(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge of large points from the larger node u to a smaller v
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def resolve_places(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, canon`` of each distinct spelled name: the longest tail of its folders that is a known id, else by its last root folder.

    ``names`` has the distinct spelled names that hold a folder, ``known`` the ids (``name, tier``; tier 0: of a file, 1: bare in
    the corpus). Names without a folder are ids already and don't come here.
    """
    pieces = F.split("name", "/")
    size = F.size(pieces)
    tails = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), size), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(pieces, size - k + 1, k), "/").alias("tail")))).alias("t")).select("name", "t.k", "t.tail")
    hits = tails.join(known.withColumnRenamed("name", "tail"), "tail").groupBy("name").agg(F.max_by("tail", F.struct(-F.col("tier"), "k")).alias("hit"))
    plain = F.regexp_replace("name", r"^.*/(?:videos|proxy_[^/]+)/", "")
    fallback = F.when(plain.startswith("/"), F.element_at(pieces, -1)).otherwise(plain)
    return names.join(hits, "name", "left").select("name", F.coalesce("hit", F.nullif(fallback, F.lit("")), "name").alias("canon"))


@dataclass
class Videos:
    """``special``: ``name, video`` of the spelled names that aren't their own video's name; all others are."""

    special: DataFrame
    rows: int

    def attach(self, df: DataFrame, stored: Column, out: str = "video") -> DataFrame:
        """``df`` with the video of each stored name; null and blank names have none."""
        named = df.withColumn("__name", spelled(stored))
        small = self.special.select(F.col("name").alias("__name"), F.col("video").alias("__video"))
        return attach_small(named, small, ["__name"], rows=self.rows).withColumn(out, F.coalesce("__video", "__name")).drop("__name", "__video")


def find_videos(names: DataFrame, files: DataFrame) -> Videos:
    """Resolve the stored names in ``names.video_id`` by the files' ``video_id, n_bytes, content_sha1``.

    Two ids are one video if a file of each has the same hash, letter case aside; files of 0 bytes, blank or null hashes and the
    hash of nothing link nothing. Links also run over ids that only the files have. Empty tables are allowed.
    """
    # distinct names before their spelling, which costs more; both tables are read once
    stored = cut(names.select("video_id").distinct().select(spelled(F.col("video_id")).alias("name")).where("name is not null").distinct())
    filed = cut(files.select("video_id", F.lower(F.trim("content_sha1")).alias("sha"), "n_bytes").distinct().select(spelled(F.col("video_id")).alias("name"), "sha", "n_bytes").where("name is not null"))
    has_folder = F.col("name").contains("/")
    # a place is no id, or it would be its own longest tail
    rooted, below_videos = F.col("name").startswith("/") | F.col("name").rlike("^[a-z]:/"), F.col("name").rlike("/(?:videos|proxy_[^/]+)/")
    known = (
        filed.where(~rooted).select("name", F.lit(0).alias("tier"))
        .unionByName(stored.where(~rooted & ~below_videos).select("name", F.lit(1).alias("tier")))
        .groupBy("name").agg(F.min("tier").alias("tier"))
    )
    places = cut(resolve_places(stored.unionByName(filed.select("name")).where(has_folder).distinct(), known).where("canon <> name"))
    n_places = places.count()
    content = attach_small(filed, places, ["name"], rows=n_places).select(F.coalesce("canon", "name").alias("id"), "sha").where(
        (F.coalesce("n_bytes", F.lit(1)) > 0) & (F.col("sha") != "") & (F.col("sha") != EMPTY_SHA1)
    )
    shared = content.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("sha", F.col("first").alias("v"))
    linked = cut(connected_components(content.join(shared, "sha").select(F.col("id").alias("u"), "v")).where("node <> component"))
    joined = linked.select(F.col("node").alias("canon"), "component")
    named = places.join(joined, "canon", "left").select("name", F.coalesce("component", "canon").alias("video"))
    special = cut(named.unionByName(linked.select(F.col("node").alias("name"), F.col("component").alias("video"))).dropDuplicates(["name"]))
    return Videos(special, special.count())
