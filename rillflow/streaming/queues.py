"""The bounded queue between rollout producers and a trainer, as a stateful stream and as a batch replay of its log.

Both run the same step function; a queue's rows pass it in order of their sequence number, and only its state (at most the
queue's capacity) is held.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.scale import ensure_checkpoint_dir, parted, running

OUT = "queue long, seq long, op string, item long, dropped_item long, size long, produced long, consumed long, dropped long"


class Queue:
    """First in, first out; a put into a full queue drops the oldest item and says so."""

    def __init__(self, capacity: int, state: str | None = None):
        self.capacity = capacity
        kept = json.loads(state) if state else {"items": [], "produced": 0, "consumed": 0, "dropped": 0}
        self.items, self.produced, self.consumed, self.dropped = deque(kept["items"]), kept["produced"], kept["consumed"], kept["dropped"]

    def dump(self) -> str:
        return json.dumps({"items": list(self.items), "produced": self.produced, "consumed": self.consumed, "dropped": self.dropped})

    def step(self, op: str, item: int | None) -> tuple[int | None, int | None]:
        """The item that came out of a get (none from an empty queue), or the one that a put pushed out."""
        if op == "put":
            out = None
            if len(self.items) >= self.capacity:
                out, self.dropped = self.items.popleft(), self.dropped + 1
            self.items.append(item)
            self.produced += 1
            return item, out
        if not self.items:
            return None, None
        self.consumed += 1
        return self.items.popleft(), None

    def row(self, queue: int, seq: int, op: str, item: float | None) -> tuple:
        got, pushed = self.step(op, None if pd.isna(item) else int(item))
        return (queue, seq, op, got, pushed, len(self.items), self.produced, self.consumed, self.dropped)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return frame.astype({"item": "Int64", "dropped_item": "Int64"})


def queue_stream(log: DataFrame, capacity: int) -> DataFrame:
    """A streaming log (``queue, seq, op, item``) as the queue's answers; the state survives restarts in the stream's checkpoint.
    Rows of one micro-batch are put in order; later batches must not hold earlier sequence numbers."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        q = Queue(capacity, state.get[0] if state.exists else None)
        log = pd.concat(list(parts)).sort_values("seq")
        yield _frame([q.row(key[0], *r) for r in zip(log["seq"].tolist(), log["op"].tolist(), log["item"].tolist())])
        state.update((q.dump(),))

    return log.groupBy("queue").applyInPandasWithState(run, OUT, "kept string", "append", "NoTimeout")


def queue_replay(log: DataFrame, capacity: int) -> DataFrame:
    """The same over a finished log: rows are sorted by queue and sequence and streamed through, never a whole queue at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, q = None, None
        for batch in batches:
            out = []
            for key, seq, op, item in zip(*(batch[c].tolist() for c in ("queue", "seq", "op", "item"))):
                if key != name:
                    name, q = key, Queue(capacity)
                out.append(q.row(key, seq, op, item))
            yield _frame(out)

    return log.select("queue", "seq", "op", "item").repartition("queue").sortWithinPartitions("queue", "seq").mapInPandas(run, OUT)


def capacity_of(required: int, staleness: float, sync_every: int) -> int:
    """Samples that may be under way: those of one version, with the allowed staleness on top, cut to a whole number."""
    return int(required * (staleness + 1) * sync_every)


def version_of(step: Column, sync_every: int) -> Column:
    return F.floor(step / sync_every)


def count_windows(df: DataFrame, queue: str, seq: str, k: int) -> DataFrame:
    """Groups of exactly ``k`` rows by arrival ordinal (0, 1, ...) within a queue; the incomplete last group is left out."""
    grouped = df.withColumn("window_no", F.floor(F.col(seq) / k))
    full = grouped.groupBy(queue, "window_no").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")
    return grouped.join(full, [queue, "window_no"], "left_semi")


def staleness_stats(df: DataFrame, least: str, greatest: str) -> DataFrame:
    """Spans of versions in samples: mean and greatest span, share of samples over several versions, versions seen."""
    span = F.col(greatest) - F.col(least)
    return df.agg(F.count(F.lit(1)).alias("samples"), F.avg(span).alias("mean_span"), F.max(span).alias("max_span"), F.avg((span > 0).cast("int")).alias("partial_share"), F.countDistinct(greatest).alias("versions"))


def ready_partitions(status: DataFrame, partition: str, key: str, at: str, state: str) -> DataFrame:
    """Partitions of a replay buffer none of whose keys is running by its latest status; unknown statuses hold nobody back."""
    latest = status.groupBy(partition, key).agg(F.max_by(state, at).alias("s"))
    return latest.groupBy(partition).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("s") == "finished").alias("finished"), F.coalesce(F.bool_or(F.col("s") == "running"), F.lit(False)).alias("_r")).where("not _r").drop("_r")


def pop_once(df: DataFrame, key: str, at: str) -> DataFrame:
    """The first row of each key: later answers to the same request find nothing."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), at).alias("_r")).select(key, "_r.*")


def pop_once_stream(df: DataFrame, key: str, time: str, keep: str) -> DataFrame:
    """The same on a stream; keys are forgotten ``keep`` after their event time."""
    return df.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, label: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and means per window of event time and label; on a stream ``late`` bounds how late rows may come."""
    source = df if late is None else df.withWatermark(time, late)
    return source.groupBy(F.window(time, width).alias("w"), label).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), label, "n", "total")


def token_bucket(log: DataFrame, key: str, seq: str, at: str, cost: str, rate: float, burst: float) -> DataFrame:
    """When each request may start (``start``, in the units of ``at``) under a bucket of ``burst`` tokens refilled at ``rate``: a request
    waits for its tokens in order; one larger than the bucket waits for a full one and leaves a debt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, level, clock = None, burst, 0.0
        for batch in batches:
            starts = []
            for k, t, c in zip(batch[key], batch[at], batch[cost]):
                if k != name:
                    name, level, clock = k, burst, float(t)
                now = max(clock, float(t))
                level = min(burst, level + (now - clock) * rate)
                need = min(float(c), burst)
                if level < need:
                    now += (need - level) / rate
                    level = need
                level -= float(c)
                clock = now
                starts.append(now)
            yield batch[[key, seq]].assign(start=starts)

    kinds = dict(log.dtypes)
    sorted_log = log.select(key, seq, F.col(at).cast("double").alias(at), F.col(cost).cast("double").alias(cost)).repartition(key).sortWithinPartitions(key, seq)
    return sorted_log.mapInPandas(run, f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, start double")


def paused_steps(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """Replay of the producer's state: ``stale`` samples since the last sync (which leaves those in flight), paused at capacity.

    ``log`` has ``op`` start, finish or sync per key in order of ``seq``; counts between syncs come from running sums within the
    key's versions, so nothing is folded row by row and no task sees all of a key's rows.
    """
    sync, start = (F.col("op") == "sync").cast("int"), (F.col("op") == "start").cast("int")
    change = F.when(F.col("op") == "start", 1).when(F.col("op") == "finish", -1).otherwise(0)
    rows = parted(log.select(key, seq, "op"), [key], [seq])
    rows = running(rows, [key], [seq], sync, "_v", is_parted=True).withColumn("version", F.col("_v") + sync)
    rows = running(rows, [key], [seq], change, "_f", is_parted=True).withColumn("flying", F.col("_f") + change)
    rows = running(rows, [key, "version"], [seq], start, "_s", is_parted=True)
    at_sync = rows.where("op = 'sync'").select(key, "version", F.col("flying").alias("carried"))
    joined = rows.join(at_sync, [key, "version"], "left").withColumn("stale", F.coalesce("carried", F.lit(0)) + F.col("_s") + start)
    return joined.select(key, seq, "op", "version", "flying", "stale", (F.col("stale") >= capacity).alias("paused"))


def second_waves(stream: DataFrame, anchors: int, most_var: float, most_mean: float) -> DataFrame:
    """``uid, n, mean, variance, explore`` on a stream of ``uid, seq, score``: when a prompt's first ``anchors`` scores have come, whether they
    are flat and weak enough for its second wave to explore. The state is three numbers per open prompt (a mean and squares about it) and
    survives restarts; later scores change nothing. Null scores aren't counted; those of one micro-batch come in order of ``seq``."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, squares = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values("seq")
        open_ = n < anchors
        for score in rows["score"].dropna().tolist()[: max(0, anchors - n)]:
            n += 1
            off = score - mean
            mean += off / n
            squares += off * (score - mean)
        state.update((n, mean, squares))
        done = open_ and n == anchors
        yield pd.DataFrame([(key[0], n, mean, squares / n, bool(squares / n <= most_var and mean <= most_mean))] if done else [], columns=["uid", "n", "mean", "variance", "explore"])

    kind = dict(stream.dtypes)["uid"]
    return stream.groupBy("uid").applyInPandasWithState(run, f"uid {kind}, n long, mean double, variance double, explore boolean", "n long, mean double, squares double", "append", "NoTimeout")


def feed(df: DataFrame, ordinal: str, epochs: int, start: int = 0) -> DataFrame:
    """``epochs`` passes over numbered rows (0, 1, ...) with ``epoch`` and ``ordinal``, which grows over all of them; only rows from the
    ordinal ``start`` on, so that a feed goes on where it stopped."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    each = df.join(F.broadcast(total)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))  # one row
    return each.withColumn("ordinal", F.col(ordinal) + F.col("epoch") * F.col("_n")).where(F.col("ordinal") >= start).drop("_n")


def metric_sink(path: str, step: str, names: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: metrics in long form (``step, metric, value, epoch``), a folder per micro-batch that a repeated one replaces."""

    def write(batch: DataFrame, epoch: int) -> None:
        each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        batch.select(F.col(step).cast("long").alias("step"), F.explode(each).alias("m")).select("step", "m.*").where("value is not null").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there now into Parquet files, and wait for its end."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of a directory as a stream of its files, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{directory}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


