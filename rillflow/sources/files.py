"""Readers and writers of the files that corpora come in: Parquet, JSON lines with bad lines counted, id lists, maps per run."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.text import stem
from rillflow.scale import ensure_checkpoint_dir

READERS = {".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def read_many(spark: SparkSession, paths: list[str], schema: str | T.StructType | None = None) -> DataFrame:
    """Files of one or more kinds one after the other, with ``file_no``, their place in the list; an unknown ending is an error."""
    out = None
    for i, path in enumerate(paths):
        kind = READERS.get(os.path.splitext(path.rstrip("/"))[1])
        if kind is None:
            raise ValueError(f"no reader for {path}")
        reader = spark.read if schema is None else spark.read.schema(schema)
        part = reader.format(kind).load(path).withColumn("file_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("name a file")
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by ``schema`` with ``bad``: true where a line can't be read. Blank lines are skipped, not counted."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = f"{schema}, _corrupt string"
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*").withColumn("bad", F.col("_corrupt").isNotNull()).drop("_corrupt")


def line_counts(parsed: DataFrame, ident: str) -> DataFrame:
    """Lines, lines that can't be read, and lines without an id."""
    none = F.col(ident).isNull() | F.trim(F.col(ident).cast("string")).isin("", "None")
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("unreadable"), F.count_if(~F.col("bad") & none).alias("without_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id, copies``: ids one a line or in a table's first column; comments and endings of videos are taken off."""
    ids = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("id")).where((F.col("id") != "") & ~F.col("id").startswith("#"))
    return ids.select(F.regexp_replace("id", r"\.mp4$", "").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


def read_run_maps(spark: SparkSession, pattern: str, runs: list[str] | None = None) -> DataFrame:
    """``run, key, n, c`` of JSON objects key -> [n, correct], a file per run; ``runs`` names the runs to keep."""
    files = spark.read.text(pattern, wholetext=True).select(stem(F.input_file_name()).alias("run"), F.from_json("value", "map<string,array<bigint>>").alias("m"))
    if runs is not None:
        files = files.where(F.col("run").isin(runs))
    return files.select("run", F.explode("m").alias("key", "v")).select("run", "key", F.col("v")[0].alias("n"), F.col("v")[1].alias("c"))


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``stem, path, root`` of the files under several roots; of files with one stem the first root's wins."""
    out = None
    for i, root in enumerate(roots):
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.lit(i).alias("root"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy(stem(F.col("path")).alias("stem")).agg(F.min(F.struct("root", "path")).alias("f"))
    return best.select("stem", "f.path", "f.root")


def to_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Columns of a declared schema, in its order and types; one that is missing or can't be cast is an error."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*target.names).to(target)


def write_parquet(df: DataFrame, path: str, schema: str | T.StructType | None = None, compression: str = "snappy") -> None:
    (df if schema is None else to_schema(df, schema)).write.mode("overwrite").option("compression", compression).parquet(path)


def write_checked(df: DataFrame, schema: str) -> DataFrame:
    """Write by a schema into the shared folder, read again and give the rows found; another number than written is an error."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/checked-{uuid.uuid4().hex}"
    write_parquet(df, path, schema)
    wrote, read = df.count(), spark.read.parquet(path).count()
    if wrote != read:
        raise ValueError(f"wrote {wrote} rows, read {read}")
    return spark.createDataFrame([(read,)], "n_rows long")


def write_text(df: DataFrame, path: str) -> None:
    """One text file of that very name with the rows of ``df``, which one task holds."""
    spark = df.sparkSession
    part = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.text(part)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(hadoop.Path(f"{part}/part-*"))]
    fs.rename(found[0], hadoop.Path(path))
    fs.delete(hadoop.Path(part), True)


def cached_step(spark: SparkSession, path: str, step: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The batch of a step as it was written before, or made, written and read back: a run that is repeated generates nothing twice."""
    folder = f"{path}/step={step}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Write only entities that ``path`` doesn't have yet, a folder each; a run that is repeated resumes. Returns rows written."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = df
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").partitionBy(key).parquet(path)
    return n


def dump_json(df: DataFrame, path: str, cap: int | None = None) -> dict[str, int]:
    """JSON lines of at most ``cap`` rows, with how many there were: a bounded look at generations, not a copy."""
    total = df.count()
    (df if cap is None else df.limit(cap)).write.mode("overwrite").json(path)
    return {"rows": total, "written": total if cap is None else min(cap, total)}
