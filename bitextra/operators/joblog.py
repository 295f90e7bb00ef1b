"""Jobs, monitoring and journal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitextra.operators.lookup import lookup
from bitextra.operators.ranking import chunked_previous, chunked_rank, first_n, salted_lookup
from bitextra.session import cut_lineage

# Stages with their share of the work, statuses and limits.
STAGE_WEIGHTS = {
    "queued": 0.0,
    "received": 0.0,
    "validation": 0.05,
    "conversion": 0.12,
    "extraction": 0.20,
    "glossary": 0.25,
    "translation": 0.80,
    "save": 0.95,
    "completed": 1.0,
    "failed": 1.0,
}
ACTIVE = ("pending", "running")
TERMINAL = ("completed", "failed", "cancelled")
OUTPUT_SUFFIX = {
    ".dxf": ".dwg",
    ".dwg": ".dwg",
    ".pdf": ".docx",
    ".docx": ".docx",
    ".doc": ".docx",
    ".xlsx": ".xlsx",
    ".xls": ".xlsx",
}
MAX_UPLOAD_BYTES = 128 * 1024 * 1024
STALE_SECONDS = 300
DAY = 86400
TERMINAL_TTL, ACTIVE_TTL, RETAINED_TTL = 7 * DAY, 7 * DAY, 14 * DAY


def suffix(filename: Column) -> Column:
    return F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1)


def derive_format(filename: Column) -> Column:
    """Upper-case extension without the dot, empty when there is none."""
    return F.upper(F.ltrim(suffix(filename), F.lit(".")))


def output_suffix(filename: Column) -> Column:
    """Suffix of the translated file; unknown ones are kept."""
    known = F.create_map(*[F.lit(x) for kv in OUTPUT_SUFFIX.items() for x in kv])
    return F.coalesce(known[F.lower(suffix(filename))], suffix(filename))


def job_progress() -> Column:
    """Stage weight, interpolated by batches while converting or translating."""
    weight = F.create_map(*[F.lit(x) for kv in STAGE_WEIGHTS.items() for x in kv])
    share = F.col("completed_batches") / F.nullif(F.col("total_batches"), F.lit(0))

    def between(a: str, b: str) -> Column:
        return STAGE_WEIGHTS[a] + (STAGE_WEIGHTS[b] - STAGE_WEIGHTS[a]) * share

    batched = F.col("total_batches") > 0
    return (
        F.when((F.col("current_stage") == "translation") & batched, between("extraction", "save"))
        .when((F.col("current_stage") == "conversion") & batched,
              between("validation", "extraction"))
        .otherwise(F.coalesce(weight[F.col("current_stage")], F.lit(0.0)))
    )


def job_eta() -> Column:
    """Elapsed time per batch times the batches left; 0 before the first."""
    done, total = F.col("completed_batches"), F.col("total_batches")
    return F.when(
        (done > 0) & (total > 0), F.col("elapsed_seconds") / F.nullif(done, F.lit(0)) * (total - done)
    ).otherwise(F.lit(0.0))


def job_flags() -> list[Column]:
    """active, terminal and can_cancel."""
    s = F.col("status")
    return [
        s.isin(*ACTIVE).alias("active"),
        s.isin(*TERMINAL).alias("terminal"),
        (s == "running").alias("can_cancel"),
    ]


def validate_manifest(files: DataFrame) -> DataFrame:
    """First error of each submitted file and its warning, if any.

    ``files``: filename, size, source_language, target_language, and
    has_document - null when the archive could not be opened.
    """
    docx = F.lower(suffix(F.col("filename"))) == ".docx"
    same = (
        (F.col("source_language") != "") & (F.col("target_language") != "")
        & (F.lower("source_language") == F.lower("target_language"))
    )
    too_big = F.col("size") > MAX_UPLOAD_BYTES
    error = (
        F.when(F.col("size").isNull(), "FILE_SIZE_ERROR")
        .when(too_big, "FILE_SIZE_EXCEEDED")
        .when(docx & F.col("has_document").isNull(), "STRUCTURE_BAD_ZIP")
        .when(docx & ~F.col("has_document"), "STRUCTURE_INVALID")
        .when(same, "LANGUAGE_MISMATCH")
    )
    warning = F.when(
        ~docx & F.col("size").isNotNull() & ~too_big, F.lit("STRUCTURE_NOT_CHECKED")
    )
    return files.withColumn("error_code", error).withColumn("warning_code", warning).withColumn(
        "valid", F.col("error_code").isNull()
    )


def newest(df: DataFrame, order: list[Column], n: int, most: int) -> DataFrame:
    """Newest rows first, the limit clamped to 1..most (O1, O2, O3)."""
    return df.orderBy(*order).limit(max(1, min(n, most)))


def recent_jobs(jobs: DataFrame, n: int = 10) -> DataFrame:
    return newest(jobs, [F.desc("created_at"), F.desc("seq")], n, 200)


def recent_monitoring(monitoring: DataFrame, n: int = 100) -> DataFrame:
    return newest(monitoring, [F.desc("ts"), F.desc("event_id")], n, 500)


def audit_feed(audit: DataFrame, n: int = 100) -> DataFrame:
    return newest(audit, [F.desc("created_at"), F.desc("event_id")], n, 500)


def recent_journals(journal: DataFrame, k: int = 5) -> DataFrame:
    """Entries of the newest ``k`` days."""
    days = journal.select("log_date").distinct().orderBy(F.desc("log_date")).limit(k)
    return journal.join(days, "log_date", "left_semi")


def journal_summary(journal: DataFrame) -> DataFrame:
    """entry_count and has_errors per day."""
    return journal.groupBy("log_date").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.bool_or(F.col("level") == "error").alias("has_errors"),
    )


def job_latest(monitoring: DataFrame) -> DataFrame:
    """Latest status of each job (W7) by a map-side combined maximum."""
    return monitoring.groupBy("job_id").agg(
        F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("m")
    ).select("job_id", "m.status", "m.ts", "m.event_id")


def transition_history(monitoring: DataFrame) -> DataFrame:
    """Every entry with the status before it (W7), cut by minute; entries without time come first."""
    return chunked_previous(
        monitoring, ["job_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), "status",
        "previous",
    )


def queue_positions(jobs: DataFrame) -> DataFrame:
    """0-based place of every pending job in its owner's queue."""
    return chunked_rank(
        jobs.filter("status = 'pending'"), ["user_id"], [F.col("created_at"), F.col("seq")],
        F.date_trunc("minute", "created_at"),
    ).select("job_id", "user_id", (F.col("rank") - 1).alias("position"))


def retained(
    artifacts: DataFrame, now: Column, max_age: int, max_dirs: int = 20, by: str = "root"
) -> DataFrame:
    """Artifacts kept after the age rule and the newest-N rule per root."""
    age = F.unix_timestamp(now) - F.unix_timestamp("retained_at")
    young = artifacts.filter(age <= max_age)
    return first_n(
        young, [by], [F.desc("retained_at"), F.desc("artifact_id")], max_dirs,
        F.col("artifact_id"),
    )


def stale(now: Column, ttl: int = STALE_SECONDS) -> Column:
    """No progress for more than ``ttl`` seconds (T5)."""
    since = F.coalesce("started_at", "created_at")
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(since) > ttl, F.lit(True))


def stale_jobs(jobs: DataFrame, now: Column, ttl: int = STALE_SECONDS) -> DataFrame:
    return jobs.filter(F.col("status").isin(*ACTIVE) & stale(now, ttl))


def concurrent_submissions(
    requests: DataFrame, jobs: DataFrame, now: Column, ttl: int = STALE_SECONDS
) -> DataFrame:
    """Requests for a file that an active, fresh job already works on.

    Jobs are first reduced to one row per filename, so a popular file meets
    its requests once and not pair by pair.
    """
    busy = (
        jobs.filter(F.col("status").isin(*ACTIVE) & ~stale(now, ttl))
        .groupBy("filename").agg(F.min("job_id").alias("blocking_job"))
    )
    return salted_lookup(requests, busy, ["filename"], ["request_id"], how="inner")


def expire_days(df: DataFrame, today: Column, days: int = 30, day: str = "log_date") -> DataFrame:
    """Rows not older than ``days``; the cut-off day itself stays."""
    return df.filter(F.col(day) >= F.date_sub(today, days))


def expire_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with their time to live and whether it has passed (T4)."""
    ttl = (
        F.when(F.col("keep_artifacts"), RETAINED_TTL)
        .when(F.col("status").isin(*TERMINAL), TERMINAL_TTL)
        .otherwise(ACTIVE_TTL)
    )
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return jobs.withColumn("ttl", ttl.cast("long")).withColumn("expired", age > F.col("ttl"))


def cleanup_terminal(jobs: DataFrame, now: Column, max_age: int = DAY) -> DataFrame:
    """Terminal jobs past ``max_age``; retained ones are left to their own rule (T4)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    return jobs.filter(
        ~F.col("keep_artifacts") & F.col("status").isin(*TERMINAL) & (age > max_age)
    )


def resolve_owner(events: DataFrame, users: DataFrame) -> DataFrame:
    """Owner ids replaced by user names, the id where unknown."""
    names = users.select(F.col("user_id").alias("owner_id"), "username")
    return salted_lookup(events, names, ["owner_id"], ["event_id"]).withColumn(
        "owner_name", F.coalesce("username", "owner_id")
    ).drop("username")


def lifecycle(events: DataFrame) -> DataFrame:
    """Legal transitions of every job: pending, running, one terminal status.

    Batch form. The first pending entry opens a job, the first running entry
    after it starts it, the first terminal entry after that ends it; entries
    out of turn and entries without a time are ignored. Each step is a map-side combined minimum, so the
    job with most entries is as cheap as any other.
    """
    at = F.struct("ts", "event_id", "status")

    def step(rows: DataFrame, after: DataFrame | None, statuses, before: str | None):
        rows = rows.filter(F.col("status").isin(*statuses))
        if after is not None:
            rows = lookup(
                rows, after.select("job_id", F.struct("ts", "event_id").alias("_after")),
                ["job_id"], ["event_id"], how="inner",
            ).filter(F.struct("ts", "event_id") > F.col("_after"))
        return (
            rows.groupBy("job_id").agg(F.min(at).alias("m"))
            .select("job_id", F.lit(before).cast("string").alias("from_status"),
                    F.col("m.status").alias("to_status"), "m.ts", "m.event_id")
        )

    rows = events.select("job_id", "ts", "event_id", "status").filter(F.col("ts").isNotNull())
    # Written once each: the later steps and the result read them instead of computing them again.
    opened = cut_lineage(step(rows, None, ("pending",), None))
    started = cut_lineage(step(rows, opened, ("running",), "pending"))
    ended = step(rows, started, TERMINAL, "running")
    return opened.unionByName(started).unionByName(ended)


def rate_limit(
    events: DataFrame, key: str = "key", max_requests: int = 5, window_seconds: int = 60
) -> DataFrame:
    """Sliding-log decision for every request (T6): allowed, remaining, retry_after.

    A request passes when fewer than ``max_requests`` accepted ones lie less
    than a window back; rejected ones do not count. The decision depends on
    the ones before, so a key's log is cut wherever a whole window-sized bucket
    is empty - nothing carries over such a gap - and the pieces run in
    parallel. Inside a piece rows are streamed in time order with a state of at
    most ``max_requests`` times; a piece is never held in memory. Requests
    without key are those of one more key; one without time has no place in
    the log: it is returned undecided (allowed, remaining, retry_after null).
    """
    from pyspark.sql import Window

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # A null key is the empty string, any other one is marked.
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    all_rows = events.select(named.alias("_key"), "event_id", micros.alias("_t"))
    rows = all_rows.filter(F.col("_t").isNotNull()).withColumn(
        "_bucket", F.floor(F.col("_t") / (window_seconds * 1_000_000))
    )
    buckets = rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy("_key").orderBy("_bucket")
    pieces = buckets.select(
        "_key", "_bucket", (F.col("_bucket") - F.row_number().over(by_key)).alias("_piece")
    )
    cut = rows.join(pieces, ["_key", "_bucket"])
    ordered = cut.repartition("_key", "_piece").sortWithinPartitions("_key", "_piece", "_t", "event_id")
    schema = T.StructType([
        T.StructField("_key", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("allowed", T.BooleanType()),
        T.StructField("remaining", T.LongType()),
        T.StructField("retry_after", T.DoubleType()),
    ])
    span = window_seconds * 1_000_000

    def decide(batches):
        from collections import deque

        current, accepted = None, deque()
        for pdf in batches:
            out = []
            for k, piece, t in zip(pdf["_key"], pdf["_piece"], pdf["_t"]):
                if (k, piece) != current:
                    current, accepted = (k, piece), deque()
                while accepted and accepted[0] <= t - span:
                    accepted.popleft()
                ok = len(accepted) < max_requests
                wait = None if ok else (span - (t - accepted[0])) / 1e6
                if ok:
                    accepted.append(t)
                out.append((ok, max_requests - len(accepted), wait))
            yield pdf[["_key", "event_id"]].assign(
                allowed=[o[0] for o in out],
                remaining=[o[1] for o in out],
                retry_after=[o[2] for o in out],
            )

    decided = ordered.select("_key", "event_id", "_piece", "_t").mapInPandas(decide, schema)
    undecided = all_rows.filter(F.col("_t").isNull()).select(
        "_key", "event_id", *[F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names[2:]]
    )
    back = F.when(F.col("_key") != "", F.substring("_key", 2, 2**31 - 1)).cast(events.schema[key].dataType)
    return decided.unionByName(undecided).select(back.alias(key), *schema.names[1:])
