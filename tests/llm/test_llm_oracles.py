"""Queries of the nine problems against SQL by other ways, and invariants where SQL can't say it."""

import pytest

pytest.importorskip("rillflow.llm.queries")
from rillflow.llm import oracles, queries  # noqa: E402

Q = queries.queries()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_against_sql(name, spark, data, duck, same):
    same(Q[name](spark, data).toPandas(), duck.sql(oracles.oracle_sql()[name]).df())


def test_found_columns(spark, data):
    want = {
        "p1_found": [("data_source", "string")], "p2_found": [("video_id", "string")], "p3_found": [("video_id_a", "string"), ("video_id_b", "string")], "p4_found": [("difficulty_band", "string"), ("num_hops", "bigint")],
        "p5_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")], "p6_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")], "p8_found": [("source", "string")], "p9_found": [("doc_id", "bigint"), ("end_char", "bigint")],
    }
    for name, kinds in want.items():
        assert Q[name](spark, data).dtypes == kinds, name


def test_splits_keep_videos_together(spark, data):
    got = Q["p3_splits"](spark, data).toPandas()
    assert len(got) == spark.read.parquet(f"{data}/corpus_rows.parquet").count() and got["assigned"].notna().all()
    known = got[got["video"].notna() & ~got["video"].str.startswith("\x00")]
    assert (known.groupby("video")["assigned"].nunique() == 1).all()
    shares = got["assigned"].value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.08


def test_too_many_splits_are_an_error(spark, data, tmp_path):
    import os

    for f in os.listdir(data):
        if not f.startswith("split_targets"):
            (tmp_path / f).symlink_to(f"{data}/{f}")
    for n in (1000, 1001):
        spark.range(n).selectExpr("concat('s', id) AS split", "1.0D AS target_share").write.mode("overwrite").parquet(f"{tmp_path}/split_targets.parquet")
        if n == 1000:
            assert queries.p3_splits(spark, str(tmp_path)).columns
        else:
            with pytest.raises(ValueError, match="splits"):
                queries.p3_splits(spark, str(tmp_path))


def test_sample_is_near_its_plan(spark, data):
    report = Q["p4_report"](spark, data).toPandas()
    assert ((report["sampled"] - report["planned"]).abs() < 1 + 1e-6).all()
    assert (report["sampled"] <= report["available"]).all()
    drawn = Q["p4_sample"](spark, data)
    assert drawn.count() == report["sampled"].sum() == round(report["planned"].sum())
    assert drawn.select("row_id").distinct().count() == drawn.count()


def test_groups_hold_all_links(spark, data):
    groups = {r["row_id"]: r["group_id"] for r in Q["p5_groups"](spark, data).collect()}
    pairs = Q["p5_found"](spark, data).collect()
    assert all(groups[r["row_id_a"]] == groups[r["row_id_b"]] for r in pairs)
    assert set(groups) == {x for r in pairs for x in (r["row_id_a"], r["row_id_b"])}


def test_containers_hold_every_token_once(spark, data):
    from rillflow.llm.queries import _sizes

    sizes = {r["doc_id"]: r["n_tokens"] for r in _sizes(spark, data).collect() if r["n_tokens"]}
    placed = Q["p7_containers"](spark, data).toPandas()
    for capacity in spark.read.parquet(f"{data}/pack_sizes.parquet").collect():
        part = placed[placed["pack_name"] == capacity["pack_name"]]
        assert part.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
        held = part.groupby("container_id")["n_tokens"].sum()
        assert held.max() <= capacity["capacity_tokens"] and set(held.index) == set(range(len(held)))
        for doc, pieces in part.groupby("doc_id"):
            assert (len(pieces) > 1) == (sizes[doc] > capacity["capacity_tokens"])
            ordered = pieces.sort_values("piece")
            assert (ordered["start"] == ordered["n_tokens"].cumsum().shift(fill_value=0)).all()


def test_blend_reaches_its_shares(spark, data):
    report = Q["p8_report"](spark, data).toPandas()
    copies = Q["p8_blend"](spark, data).toPandas()
    assert (copies["copies"] >= 1).all() and (report["most_copies"] <= report["max_repeats"]).all()
    fine = report[~report["short"]]
    assert ((fine["blended_tokens"] - fine["wanted_tokens"]).abs() <= 0.02 * fine["wanted_tokens"] + 200).all()
    short = report[report["short"]]
    assert (short["blended_tokens"] == short["tokens"] * short["max_repeats"]).all()


def test_sentences_cover_their_texts(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = Q["p9_sentences"](spark, data).toPandas()
    for doc, part in got.groupby("doc_id"):
        part, text, at = part.sort_values("sentence_no"), texts[doc], 0
        for start, stop, said in part[["start_char", "end_char", "sentence"]].itertuples(index=False):
            assert text[start:stop] == said and not said[-1].isspace() and not text[at:start].strip("﻿ \t\r\n\xa0　")
            at = stop
    assert set(got["doc_id"]) == {d for d, t in texts.items() if t and any(c.isalnum() for c in t)}
