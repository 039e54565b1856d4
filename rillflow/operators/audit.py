"""Audits of corpus rows: structure, schema, release gates and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of the released corpus (fixed value).
CORPUS_SCHEMA = """prompt array<struct<role:string,content:string>>, images array<struct<bytes:binary,path:string>>,
videos array<struct<fps:bigint,max_frames:bigint,max_pixels:bigint,min_pixels:bigint,type:string,video:string>>, data_source string, ability string,
reward_model struct<ground_truth:string,style:string>, extra_info struct<reward_type:string,answer:string,answer_type:string,num_hops:bigint,hop_types:array<string>,question_id:string,video_id:string,solve_rate:double,difficulty_band:string>"""
REWARD_TYPES = ("numeric", "multiple_choice")


def audit_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``faults``, the names of all checks they fail, in a fixed order. Missing parts count as empty."""
    prompt = F.coalesce("prompt", F.array().cast("array<struct<role:string,content:string>>"))
    role = lambda name: F.size(F.filter(prompt, lambda m: m["role"] == name))
    said = F.array_join(F.transform(prompt, lambda m: F.coalesce(m["content"], F.lit(""))), "")
    marks = (F.length(said) - F.length(F.replace(said, F.lit("<video>"), F.lit("")))) / 7
    gold = F.col("reward_model.ground_truth")
    checks = {
        "user_turns": role("user") != 1, "no_system": role("system") == 0, "marks": marks != F.size(F.coalesce("videos", F.array().cast(rows.schema["videos"].dataType))),
        "no_gold": F.coalesce(F.trim(gold), F.lit("")) == "", "answer": ~gold.eqNullSafe(F.col("extra_info.answer")), "reward_type": ~F.coalesce("extra_info.reward_type", F.lit("")).isin(*REWARD_TYPES),
    }
    return rows.withColumn("faults", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda f: f.isNotNull()))


def fault_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n_rows"))


def schema_faults(df: DataFrame, wanted: str | T.StructType) -> DataFrame:
    """``field, fault``: fields that are missing, extra, or of another type than wanted (nullability aside)."""
    target = T.StructType.fromDDL(wanted) if isinstance(wanted, str) else wanted
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (df.schema, target))
    faults = [(n, "missing") for n in want if n not in have] + [(n, "extra") for n in have if n not in want] + [(n, "type") for n in want if n in have and have[n] != want[n]]
    return df.sparkSession.createDataFrame(faults, "field string, fault string")


def split_name(c: Column) -> Column:
    """A split in lower case without outer spaces; validation is the older name of val."""
    plain = F.lower(F.trim(c))
    return F.when(plain == "validation", "val").otherwise(plain)


def release_gates(rows: DataFrame) -> DataFrame:
    r = rows.select(F.col("extra_info.video_id").alias("v"), split_name(F.col("split")).alias("split"), F.col("reward_model.ground_truth").alias("gt"), F.col("extra_info.answer").alias("a"), F.col("extra_info.reward_type").alias("t"), F.col("videos")[0]["max_frames"].alias("f"), F.length(F.array_join(F.transform("prompt", lambda m: m["content"]), "")).alias("n"))
    numeric = F.col("t") == "numeric"
    one = r.agg(F.count_if(numeric & ~F.coalesce("a", F.lit("")).rlike(r"^-?[0-9]+$")).alias("not_whole"), F.count_if(~F.col("a").eqNullSafe(F.col("gt"))).alias("answer_differs"), F.count_if(numeric & (F.col("f") != 140)).alias("frames"), F.max("n").cast("long").alias("longest_prompt"))
    both = r.where("v is not null").groupBy("v").agg(F.bool_or(F.col("split") == "train").alias("tr"), F.bool_or(F.col("split") == "val").alias("va"))
    return both.agg(F.count_if(F.col("tr") & F.col("va")).alias("shared_videos")).join(F.broadcast(one))  # one row each


def phases(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All phases, in order; a key in two phases is an error that the action raises."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.withColumns({"phase": F.lit(name), "phase_no": F.lit(i)})
        out = one if out is None else out.unionByName(one)
    seen = out.groupBy(key).agg(F.countDistinct("phase").alias("_p")).where("_p > 1").select(key)
    twice = out.join(seen.withColumn("_bad", F.lit(True)), key, "left")
    return twice.withColumn("phase", F.when(F.col("_bad"), F.raise_error(F.lit("a key is in two phases"))).otherwise(F.col("phase"))).drop("_bad")
