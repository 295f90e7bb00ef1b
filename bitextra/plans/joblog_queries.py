"""Bound queries: jobs, monitoring, journal, retention and rate windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.operators import joblog as J
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.registry import query

NOW = "2001-08-01 00:02:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def jobs(spark, d):
    return fx.shared(spark, d, "jobs").withColumn("started_at", F.lit(None).cast("timestamp_ntz"))


def monitoring(spark, d):
    return fx.shared(spark, d, "monitoring")


def journal(spark, d):
    return fx.shared(spark, d, "journal")


@query(
    "file_formats",
    check_sql(
        """SELECT job_id, upper(regexp_extract(filename, '\\.([^.]+)$', 1)) AS format,
          CASE lower(regexp_extract(filename, '\\.([^.]+)$', 1)) WHEN 'dxf' THEN '.dwg'
            WHEN 'pdf' THEN '.docx' WHEN 'docx' THEN '.docx' WHEN 'xlsx' THEN '.xlsx' END AS output
        FROM jobs_fx""",
        "jobs",
    ),
)
def file_formats(spark, d):
    return jobs(spark, d).select(
        "job_id", J.derive_format(F.col("filename")).alias("format"),
        J.output_suffix(F.col("filename")).alias("output"),
    )


@query(
    "job_progress",
    check_sql(
        """SELECT job_id, round(CASE
            WHEN current_stage = 'translation' AND total_batches > 0
              THEN 0.20 + 0.75 * completed_batches / total_batches
            WHEN current_stage = 'conversion' AND total_batches > 0
              THEN 0.05 + 0.15 * completed_batches / total_batches
            ELSE CASE current_stage WHEN 'validation' THEN 0.05 WHEN 'conversion' THEN 0.12
              WHEN 'extraction' THEN 0.20 WHEN 'glossary' THEN 0.25 WHEN 'translation' THEN 0.80
              WHEN 'save' THEN 0.95 ELSE 0.0 END END::DOUBLE, 4) AS progress,
          cast(floor(CASE WHEN completed_batches > 0 AND total_batches > 0
            THEN elapsed_seconds / completed_batches * (total_batches - completed_batches)
            ELSE 0.0 END) AS BIGINT) AS eta,
          status IN ('pending', 'running') AS active,
          status IN ('completed', 'failed', 'cancelled') AS terminal, status = 'running' AS can_cancel
        FROM jobs_fx""",
        "jobs",
    ),
)
def job_progress(spark, d):
    return jobs(spark, d).select(
        "job_id", F.round(J.job_progress(), 4).alias("progress"),
        F.floor(J.job_eta()).alias("eta"), *J.job_flags(),
    )


@query(
    "manifest_validation",
    check_sql(
        """SELECT filename, job_id, error_code, error_code IS NULL AS valid,
          CASE WHEN NOT docx AND size IS NOT NULL AND size <= 134217728
            THEN 'STRUCTURE_NOT_CHECKED' END AS warning_code
        FROM (SELECT *, CASE WHEN size IS NULL THEN 'FILE_SIZE_ERROR'
            WHEN size > 134217728 THEN 'FILE_SIZE_EXCEEDED'
            WHEN docx AND seq % 5 = 0 THEN 'STRUCTURE_BAD_ZIP'
            WHEN docx AND seq % 5 = 1 THEN 'STRUCTURE_INVALID'
            WHEN seq % 3 = 0 THEN 'LANGUAGE_MISMATCH' END AS error_code
          FROM (SELECT *, seq % 4 = 0 AS docx, CASE WHEN seq % 17 = 0 THEN NULL
              ELSE cast(floor(elapsed_seconds) AS BIGINT) * 400 END AS size FROM jobs_fx))""",
        "jobs",
    ),
)
def manifest_validation(spark, d):
    n = F.col("seq")
    files = jobs(spark, d).select(
        "filename", "job_id",
        F.when(n % 17 != 0, F.floor("elapsed_seconds") * 400).alias("size"),
        F.lit("ru").alias("source_language"),
        F.when(n % 3 == 0, "RU").otherwise("en").alias("target_language"),
        F.when(n % 5 != 0, n % 5 != 1).alias("has_document"),
    )
    return J.validate_manifest(files).select(
        "filename", "job_id", "error_code", "valid", "warning_code"
    )


@query(
    "recent_jobs",
    check_sql("SELECT * FROM jobs_fx ORDER BY created_at DESC, seq DESC LIMIT 200", "jobs"),
)
def recent_jobs(spark, d):
    return J.recent_jobs(fx.shared(spark, d, "jobs"), 900)


@query(
    "recent_monitoring",
    check_sql(
        "SELECT event_id, job_id, status, ts FROM monitoring_fx ORDER BY ts DESC, event_id DESC LIMIT 100",
        "monitoring",
    ),
)
def recent_monitoring(spark, d):
    return J.recent_monitoring(monitoring(spark, d)).select("event_id", "job_id", "status", "ts")


@query(
    "audit_feed",
    """SELECT event_id, cast(user_id AS VARCHAR) AS actor, event_type AS action, ts AS created_at
       FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""",
)
def audit_feed(spark, d):
    audit = fx.table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("actor"),
        F.col("event_type").alias("action"), F.col("ts").alias("created_at"),
    )
    return J.audit_feed(audit, 1000)


@query(
    "recent_journals",
    check_sql(
        """SELECT event_id, log_date, level, stage FROM journal_fx WHERE log_date IN
          (SELECT DISTINCT log_date FROM journal_fx ORDER BY log_date DESC LIMIT 5)""",
        "journal",
    ),
)
def recent_journals(spark, d):
    return J.recent_journals(journal(spark, d)).select("event_id", "log_date", "level", "stage")


@query(
    "jobs_by_user",
    check_sql(
        """SELECT user_id, count(*) AS n, count(*) FILTER (status IN ('pending', 'running'))
          AS n_active FROM jobs_fx GROUP BY user_id""",
        "jobs",
    ),
)
def jobs_by_user(spark, d):
    return jobs(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*J.ACTIVE)).alias("n_active")
    )


@query(
    "active_jobs",
    check_sql(
        "SELECT job_id, user_id, status FROM jobs_fx WHERE status IN ('pending', 'running')", "jobs"
    ),
)
def active_jobs(spark, d):
    return jobs(spark, d).filter(F.col("status").isin(*J.ACTIVE)).select(
        "job_id", "user_id", "status"
    )


@query(
    "journal_summary",
    check_sql(
        """SELECT log_date, count(*) AS entry_count, bool_or(level = 'error') AS has_errors
        FROM journal_fx GROUP BY log_date""",
        "journal",
    ),
)
def journal_summary(spark, d):
    return J.journal_summary(journal(spark, d))


@query(
    "job_latest",
    check_sql(
        """SELECT job_id, status, ts, event_id FROM monitoring_fx
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1""",
        "monitoring",
    ),
)
def job_latest(spark, d):
    return J.job_latest(monitoring(spark, d))


@query(
    "transition_history",
    check_sql(
        """SELECT job_id, event_id, status, lag(status) OVER (PARTITION BY job_id
          ORDER BY ts, event_id) AS previous FROM monitoring_fx""",
        "monitoring",
    ),
)
def transition_history(spark, d):
    return J.transition_history(monitoring(spark, d)).select(
        "job_id", "event_id", "status", "previous"
    )


@query(
    "queue_positions",
    check_sql(
        """SELECT job_id, user_id, row_number() OVER (PARTITION BY user_id
          ORDER BY created_at, seq) - 1 AS position FROM jobs_fx WHERE status = 'pending'""",
        "jobs",
    ),
)
def queue_positions(spark, d):
    return J.queue_positions(jobs(spark, d))


@query(
    "retained_artifacts",
    check_sql(
        f"""SELECT job_id FROM jobs_fx WHERE epoch({NOW_SQL}) - epoch(created_at) <= 63072000
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, seq DESC) <= 3""",
        "jobs",
    ),
)
def retained_artifacts(spark, d):
    artifacts = jobs(spark, d).select(
        "job_id", F.col("user_id").alias("root"), F.col("seq").alias("artifact_id"),
        F.col("created_at").alias("retained_at"),
    )
    return J.retained(artifacts, now(), 730 * J.DAY, 3).select("job_id")


@query(
    "stale_jobs",
    check_sql(
        f"""SELECT job_id FROM jobs_fx WHERE status IN ('pending', 'running')
          AND epoch({NOW_SQL}) - epoch(created_at) > 300""",
        "jobs",
    ),
)
def stale_jobs(spark, d):
    return J.stale_jobs(jobs(spark, d), now()).select("job_id")


@query(
    "concurrent_submissions",
    check_sql(
        f"""SELECT event_id AS request_id, m.filename, blocking_job FROM monitoring_fx m
        JOIN (SELECT filename, min(job_id) AS blocking_job FROM jobs_fx
              WHERE status IN ('pending', 'running')
                AND NOT epoch({NOW_SQL}) - epoch(created_at) > 8640000 GROUP BY filename)
        USING (filename)""",
        "jobs", "monitoring",
    ),
)
def concurrent_submissions(spark, d):
    requests = monitoring(spark, d).select(F.col("event_id").alias("request_id"), "filename")
    return J.concurrent_submissions(requests, jobs(spark, d), now(), 100 * J.DAY)


@query(
    "expire_days",
    check_sql(
        """SELECT event_id FROM journal_fx WHERE log_date >= DATE '2024-02-15' - INTERVAL 30 DAY""",
        "journal",
    ),
)
def expire_days(spark, d):
    return J.expire_days(journal(spark, d), F.lit("2024-02-15").cast("date")).select("event_id")


@query(
    "expire_jobs",
    check_sql(
        f"""SELECT job_id, ttl, epoch({NOW_SQL}) - epoch(created_at) > ttl AS expired FROM (
          SELECT *, CASE WHEN keep_artifacts THEN 1209600 ELSE 604800 END AS ttl FROM jobs_fx)""",
        "jobs",
    ),
)
def expire_jobs(spark, d):
    return J.expire_jobs(jobs(spark, d), now()).select("job_id", "ttl", "expired")


@query(
    "cleanup_terminal",
    check_sql(
        f"""SELECT job_id FROM jobs_fx WHERE NOT keep_artifacts
          AND status IN ('completed', 'failed', 'cancelled')
          AND epoch({NOW_SQL}) - epoch(created_at) > 86400""",
        "jobs",
    ),
)
def cleanup_terminal(spark, d):
    return J.cleanup_terminal(jobs(spark, d), now()).select("job_id")


@query(
    "owner_names",
    check_sql(
        """SELECT event_id, coalesce(username, owner_id) AS owner_name FROM monitoring_fx
        LEFT JOIN users_fx ON owner_id = user_id""",
        "monitoring", "users",
    ),
)
def owner_names(spark, d):
    return J.resolve_owner(monitoring(spark, d), fx.shared(spark, d, "users")).select(
        "event_id", "owner_name"
    )


LIFECYCLE = """
    opened AS (SELECT job_id, 'pending' AS to_status, ts, event_id FROM monitoring_fx
      WHERE status = 'pending'
      QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1),
    started AS (SELECT m.job_id, m.status AS to_status, m.ts, m.event_id FROM monitoring_fx m
      JOIN opened o ON m.job_id = o.job_id AND m.status = 'running'
        AND (m.ts, m.event_id) > (o.ts, o.event_id)
      QUALIFY row_number() OVER (PARTITION BY m.job_id ORDER BY m.ts, m.event_id) = 1),
    ended AS (SELECT m.job_id, m.status AS to_status, m.ts, m.event_id FROM monitoring_fx m
      JOIN started o ON m.job_id = o.job_id AND m.status IN ('completed', 'failed', 'cancelled')
        AND (m.ts, m.event_id) > (o.ts, o.event_id)
      QUALIFY row_number() OVER (PARTITION BY m.job_id ORDER BY m.ts, m.event_id) = 1),
    moves AS (SELECT job_id, NULL AS from_status, to_status, ts, event_id FROM opened
      UNION ALL SELECT job_id, 'pending', to_status, ts, event_id FROM started
      UNION ALL SELECT job_id, 'running', to_status, ts, event_id FROM ended)"""


@query("job_lifecycle", check_sql(f"WITH {LIFECYCLE} SELECT * FROM moves", "monitoring"))
def job_lifecycle(spark, d):
    return J.lifecycle(monitoring(spark, d))


RATE = """
    WITH RECURSIVE req AS (
      SELECT user_id, event_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (
      SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS allowed, 0::BIGINT AS t,
             NULL::BIGINT AS a1, NULL::BIGINT AS a2
      FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT user_id, n, event_id, ok, t, CASE WHEN ok THEN live2 ELSE live1 END,
             CASE WHEN ok THEN t ELSE live2 END
      FROM (SELECT *, live1 IS NULL AS ok FROM (
        SELECT r.user_id, r.n, r.event_id, r.t,
               CASE WHEN w.a1 > r.t - 3600000000 THEN w.a1 END AS live1,
               CASE WHEN w.a2 > r.t - 3600000000 THEN w.a2 END AS live2
        FROM walk w JOIN req r ON r.user_id = w.user_id AND r.n = w.n + 1)))
    SELECT user_id, event_id, allowed,
           2 - (CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END)
             AS remaining,
           CASE WHEN NOT allowed THEN (3600000000 - (t - a1)) / 1e6 END AS retry_after
    FROM walk WHERE n > 0"""


@query("rate_limit", RATE)
def rate_limit(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", "ts")
    return J.rate_limit(e, "user_id", 2, 3600)
