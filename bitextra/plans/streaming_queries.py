"""Bound queries: streams over the events table and over written pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.joblog_queries import LIFECYCLE, RATE
from bitextra.plans.registry import query
from bitextra.plans.source_queries import PAGE_FIELDS, write_pages
from bitextra.plans.text_queries import GLUE_CTE, q_reason, q_trim
from bitextra.streaming import logs, state


STATUS_OF_EVENT = {"signup": "pending", "purchase": "completed", "error": "failed"}


def events(spark, d):
    """The events table as a stream, with the monitoring columns."""
    schema = fx.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    status = F.create_map(*[F.lit(x) for kv in STATUS_OF_EVENT.items() for x in kv])
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        (F.col("event_id") % 500).cast("string").alias("job_id"),
        F.coalesce(status[F.col("event_type")], F.lit("running")).alias("status"),
    )


@query(
    "stream_daily_counts",
    check_sql(
        """SELECT cast(ts AS DATE) AS log_date, status, count(*) AS n FROM monitoring_fx
        GROUP BY ALL""",
        "monitoring",
    ),
)
def stream_daily_counts(spark, d):
    counts = logs.stream_daily_counts(events(spark, d))
    return logs.latest(logs.run_available(counts, "update"), ["log_date", "status"])


@query(
    "stream_job_state",
    check_sql(f"WITH {LIFECYCLE} SELECT job_id, from_status, to_status, event_id FROM moves",
              "monitoring"),
)
def stream_job_state(spark, d):
    with state.rocksdb(spark):
        return logs.run_available(state.stream_job_state(events(spark, d))).drop("ts")


def _silent_sql(seconds: int, statuses: str) -> str:
    """Entries after which a job was silent for so long, up to the last time seen."""
    return check_sql(
        f"""SELECT job_id, status, epoch_us(ts) AS since FROM (
          SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS following,
            (SELECT max(ts) FROM monitoring_fx) AS newest FROM monitoring_fx)
        WHERE {statuses} AND epoch_us(coalesce(following, newest)) - epoch_us(ts) > {seconds * 1_000_000}""",
        "monitoring",
    )


@query("stream_stale_jobs", _silent_sql(300, "status IN ('pending', 'running')"))
def stream_stale_jobs(spark, d):
    with state.rocksdb(spark):
        found = logs.run_available(state.stream_stale_jobs(events(spark, d)))
    return found.select("job_id", "status", F.unix_micros("since").alias("since"))


@query("stream_expire_jobs", _silent_sql(604800, "true"))
def stream_expire_jobs(spark, d):
    with state.rocksdb(spark):
        found = logs.run_available(state.stream_expire_jobs(events(spark, d)))
    return found.select("job_id", "status", F.unix_micros("since").alias("since"))


@query(
    "stream_rate_limit",
    f"SELECT cast(user_id AS VARCHAR) AS key, event_id, allowed FROM ({RATE})",
)
def stream_rate_limit(spark, d):
    with state.rocksdb(spark):
        return logs.run_available(state.stream_rate_limit(events(spark, d), "user_id", 2, 3600))


@query(
    "stream_dedup",
    check_sql("SELECT DISTINCT job_id, status FROM monitoring_fx", "monitoring"),
)
def stream_dedup(spark, d):
    kept = logs.dedup_transitions(events(spark, d), "60 days")
    return logs.run_available(kept.select("job_id", "status"))


@query(
    "stream_page_scan",
    check_sql(
        f"""WITH {GLUE_CTE}
        SELECT {PAGE_FIELDS}, 'leak' AS kind, reason, {q_trim('target')} AS detail
        FROM (SELECT *, {q_reason('target')} AS reason FROM units_fx) WHERE reason IS NOT NULL
        UNION ALL SELECT {PAGE_FIELDS}, 'glue', reason, token FROM found""",
        "units",
    ),
)
def stream_page_scan(spark, d):
    return logs.run_available(logs.stream_scan(spark, write_pages(spark, d)))
