import random

from rillflow.streaming import queues as Q


def log(spark, n=120):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.randrange(3), i, rng.choice(["put", "put", "get"]), i) for i in range(n)], "queue long, seq long, op string, item long")


def expected(rows, capacity):
    out, state = {}, {}
    for q, seq, op, item in rows:
        items, c = state.setdefault(q, ([], [0, 0, 0]))
        got = pushed = None
        if op == "put":
            if len(items) == capacity:
                pushed = items.pop(0)
                c[2] += 1
            items.append(item)
            c[0] += 1
            got = item
        elif items:
            got = items.pop(0)
            c[1] += 1
        out[seq] = (got, pushed, len(items), *c)
    return out


def as_dict(df):
    return {r["seq"]: (r["item"], r["dropped_item"], r["size"], r["produced"], r["consumed"], r["dropped"]) for r in df.collect()}


def test_replay_is_the_queue(spark):
    rows = [tuple(r) for r in log(spark).collect()]
    assert as_dict(Q.queue_replay(log(spark), 4)) == expected(rows, 4)


def test_stream_equals_replay(spark, tmp_path):
    log(spark).coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    stream = Q.table_stream(spark, str(tmp_path), "in")
    Q.run_to_files(Q.queue_stream(stream, 4), str(tmp_path / "run"))
    assert as_dict(spark.read.parquet(str(tmp_path / "run/out"))) == as_dict(Q.queue_replay(log(spark), 4))


def test_empty_log(spark):
    assert Q.queue_replay(log(spark).limit(0), 4).count() == 0


def test_capacity():
    assert Q.capacity_of(8, 0.5, 4) == 48
    assert Q.capacity_of(3, 0.1, 1) == 3


def test_bucket_waits_and_owes(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 0.0, 5.0), (1, 2, 0.0, 25.0), (1, 3, 100.0, 10.0)], "k int, seq int, at double, cost double")
    got = [r["start"] for r in Q.token_bucket(df, "k", "seq", "at", "cost", 1.0, 10.0).orderBy("seq").collect()]
    assert got == [0.0, 0.0, 10.0, 100.0]
