"""Streams over several micro-batches against their batch twins."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bitextra.operators.joblog import lifecycle, rate_limit
from bitextra.streaming import logs, state

SCHEMA = "event_id LONG, ts TIMESTAMP, job_id STRING, status STRING"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Three files in time order, read one per micro-batch."""
    base = spark.range(300).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 900).alias("ts"),
        (F.col("id") % 11).cast("string").alias("job_id"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("pending", "running", "failed", "running", "cancelled")]),
            (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int"),
        ).alias("status"),
    )
    folder = tmp_path_factory.mktemp("events")
    for part in range(3):
        (base.filter(F.floor(F.col("event_id") / 100) == part).coalesce(1)
         .write.mode("append").json(str(folder)))
    return base, str(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)


def test_lifecycle_over_batches(spark, arriving):
    base, folder = arriving
    with state.rocksdb(spark):
        got = logs.run_available(state.stream_job_state(stream(spark, folder)))
    columns = ["job_id", "from_status", "to_status", "event_id"]
    assert set(map(tuple, got.select(columns).collect())) == set(
        map(tuple, lifecycle(base).select(columns).collect())
    )


def test_rate_limit_over_batches(spark, arriving):
    base, folder = arriving
    with state.rocksdb(spark):
        got = logs.run_available(state.stream_rate_limit(stream(spark, folder), "job_id", 1, 15000))
    exp = rate_limit(base, "job_id", 1, 15000)
    assert set(map(tuple, got.select("event_id", "allowed").collect())) == set(
        map(tuple, exp.select("event_id", "allowed").collect())
    )


@pytest.mark.parametrize("seconds", [9000, 40000])
def test_silent_jobs_over_batches(spark, arriving, seconds):
    base, folder = arriving
    with state.rocksdb(spark):
        got = logs.run_available(state.stream_stale_jobs(stream(spark, folder), seconds)).collect()
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    newest = base.agg(F.max("ts")).first()[0]
    exp = base.withColumn("next", F.coalesce(F.lead("ts").over(order), F.lit(newest))).filter(
        F.col("status").isin("pending", "running")
        & (F.unix_timestamp("next") - F.unix_timestamp("ts") > seconds)
    )
    assert {(r.job_id, r.status, r.since) for r in got} == {(r.job_id, r.status, r.ts) for r in exp.collect()}


def test_state_is_forgotten(spark, tmp_path):
    """With a watermark a job that was silent for long starts anew; without one it is remembered."""
    start = 1700000000
    rows = [(0, 0, "a", "pending"), (1, 100_000, "b", "pending"), (2, 200_000, "b", "running"),
            (3, 300_000, "a", "pending"), (4, 300_100, "a", "running")]
    for e, at, job, status in rows:
        spark.createDataFrame([(e, start + at, job, status)], "event_id LONG, t LONG, job_id STRING, status STRING").select(
            "event_id", F.timestamp_seconds("t").alias("ts"), "job_id", "status"
        ).coalesce(1).write.mode("append").json(str(tmp_path))
    with state.rocksdb(spark):
        anew = logs.run_available(state.stream_job_state(stream(spark, str(tmp_path)), "1 minute", 50_000))
        once = logs.run_available(state.stream_job_state(stream(spark, str(tmp_path))))
        limited = logs.run_available(
            state.stream_rate_limit(stream(spark, str(tmp_path)), "job_id", 1, 150, "1 minute"))
    opened = "job_id = 'a' AND from_status IS NULL"
    assert {r.event_id for r in anew.filter(opened).collect()} == {0, 3}
    assert {r.event_id for r in once.filter(opened).collect()} == {0}
    assert {r.event_id: r.allowed for r in limited.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False}


def write_batches(spark, folder, batches):
    """One file, so one micro-batch, for each list of (event_id, seconds or None, job, status)."""
    for rows in batches:
        spark.createDataFrame(rows, "event_id LONG, t DOUBLE, job_id STRING, status STRING").select(
            "event_id", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")).alias("ts"), "job_id", "status"
        ).coalesce(1).write.mode("append").json(str(folder))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Entries up to 600 s late over six micro-batches, some without a time; the last moves the watermark past all."""
    import random

    rng = random.Random(3)
    rows = []
    for e in range(240):
        at = 1_700_000_000 + 60.0 * e + rng.random()
        status = rng.choice(["pending", "running", "failed", "running", "cancelled"])
        rows.append((e, at, f"j{rng.randrange(9)}", status))
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 590)
    batches = [arrival[k : k + 40] for k in range(0, 240, 40)]
    for k in range(4):
        batches[k].append((900 + k, None, f"j{k}", "pending"))
    batches.append([(999, 1_700_000_000 + 60.0 * 240 + 5_000_000, "end", "pending")])
    folder = tmp_path_factory.mktemp("shuffled")
    write_batches(spark, folder, batches)
    every = [r for b in batches for r in b]
    base = spark.createDataFrame(every, "event_id LONG, t DOUBLE, job_id STRING, status STRING").select(
        "event_id", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")).alias("ts"), "job_id", "status"
    )
    return base.filter("job_id <> 'end'"), str(folder)


def test_late_and_timeless_entries_give_the_batch_lifecycle(spark, shuffled):
    base, folder = shuffled
    with state.rocksdb(spark):
        got = logs.run_available(state.stream_job_state(stream(spark, folder), "600 seconds", 100_000, ordered=True))
    columns = ["job_id", "from_status", "to_status", "event_id", "ts"]
    exp = set(map(tuple, lifecycle(base).select(columns).collect()))
    assert set(map(tuple, got.select(columns).collect())) == exp


def test_late_and_timeless_requests_give_the_batch_decisions(spark, shuffled):
    base, folder = shuffled
    with state.rocksdb(spark):
        got = logs.run_available(
            state.stream_rate_limit(stream(spark, folder), "job_id", 2, 900, "600 seconds", ordered=True))
        plain = logs.run_available(state.stream_rate_limit(stream(spark, folder), "job_id", 2, 900))
    exp = {(r.event_id, r.allowed) for r in rate_limit(base, "job_id", 2, 900).collect()}
    assert {(r.event_id, r.allowed) for r in got.collect()} == exp
    assert {r.event_id for r in plain.collect()} == {e for e, _ in exp} | {999}


def test_late_and_timeless_entries_of_silent_jobs(spark, shuffled):
    base, folder = shuffled
    with state.rocksdb(spark):
        got = logs.run_available(
            state.stream_stale_jobs(stream(spark, folder), 700, "600 seconds", ordered=True)).collect()
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    exp = base.filter("ts IS NOT NULL").withColumn("next", F.lead("ts").over(order)).filter(
        F.col("status").isin("pending", "running")
        & (F.col("next").isNull() | (F.unix_micros("next") - F.unix_micros("ts") > 700_000_000))
    )
    assert {(r.job_id, r.status, r.since) for r in got} == {(r.job_id, r.status, r.ts) for r in exp.collect()}


def test_a_late_entry_moves_no_timer_back(spark, tmp_path):
    """An entry out of turn from before does not shorten what a job is remembered for."""
    start = 1_700_000_000
    batches = [[(0, start + 1000.0, "a", "pending")], [(1, start + 700.0, "a", "failed"), (2, start + 1750.0, "b", "pending")],
               [(3, start + 1250.0, "a", "running")], [(4, start + 9000.0, "b", "running")]]
    write_batches(spark, tmp_path, batches)
    for ordered in (False, True):
        with state.rocksdb(spark):
            got = logs.run_available(
                state.stream_job_state(stream(spark, str(tmp_path)), "600 seconds", 300, ordered=ordered))
        assert {(r.event_id, r.to_status) for r in got.filter("job_id = 'a'").collect()} == {(0, "pending"), (3, "running")}


def test_days_and_duplicates_over_batches(spark, arriving):
    base, folder = arriving
    days = logs.latest(logs.run_available(logs.retain_days(stream(spark, folder)), "update"), ["log_date"])
    exp = base.groupBy(F.to_date("ts").alias("log_date")).agg(F.count(F.lit(1)).alias("n"))
    assert set(map(tuple, days.collect())) == set(map(tuple, exp.collect()))
    once = logs.run_available(logs.dedup_transitions(stream(spark, folder)))
    pairs = [(r.job_id, r.status) for r in once.collect()]
    assert len(pairs) == len(set(pairs)) == base.select("job_id", "status").distinct().count()
