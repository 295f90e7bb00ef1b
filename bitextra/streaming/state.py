"""Keyed state: job lifecycle and the sliding-log rate limit."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from bitextra.operators.joblog import ACTIVE, STALE_SECONDS, TERMINAL, TERMINAL_TTL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """State on local disk with snapshots in the checkpoint, for the time of a query."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# An entry of a key: time in microseconds, number, status.
ENTRY = "us BIGINT, event_id BIGINT, status STRING"


def _entries(pdf) -> list[tuple]:
    return list(zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["status"].tolist(), strict=True))


class _Keyed(StatefulProcessor):
    """Entries of one key in the order of their times, and what the key remembers.

    ``keep_ms`` after its last entry a key is forgotten, in event time; None
    remembers for ever. With ``ordered`` entries wait in the state, chunk by
    chunk as they come, until the watermark has passed them; no earlier entry
    can come then, so however they were spread over micro-batches they are
    taken in order. Otherwise those of one micro-batch are sorted and taken at
    once. Each key has one timer; what it remembers of time never goes back.
    """

    keep_ms: int | None = None
    ordered = False

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ENTRY)
        # Time of the newest entry taken (microseconds) and of the timer (milliseconds).
        self.clock = handle.getValueState("clock", "newest BIGINT, wake BIGINT")

    def take(self, key, entries: list[tuple]) -> list[tuple]:
        """Result rows of entries in order."""
        raise NotImplementedError

    def expire(self, key) -> list[tuple]:
        """Result rows of a key about to be forgotten."""
        return []

    def forget(self) -> None:
        raise NotImplementedError

    def frame(self, found: list[tuple]):
        raise NotImplementedError

    def _set(self, newest: int | None, held_from: int | None, before: int | None) -> None:
        """The key's one timer: when the next held entry is due or the key is to be forgotten."""
        wakes = []
        if held_from is not None:
            wakes.append(-(-held_from // 1000))
        if newest is not None and self.keep_ms is not None:
            # One more, as silence must exceed the limit.
            wakes.append(newest // 1000 + self.keep_ms + 1)
        wake = min(wakes) if wakes else None
        if before is not None and before != wake:
            self.handle.deleteTimer(before)
        if wake is not None and before != wake:
            self.handle.registerTimer(wake)
        self.clock.update((newest, wake))

    def handleInputRows(self, key, rows, timerValues):
        newest, wake = self.clock.get() if self.clock.exists() else (None, None)
        if self.ordered:
            first = None
            for pdf in rows:
                chunk = _entries(pdf)
                self.held.appendList(chunk)
                least = min(e[0] for e in chunk)
                first = least if first is None else min(first, least)
            # An earlier entry may be held already: its time is that of the timer or later.
            if wake is not None and (newest is None or wake != newest // 1000 + (self.keep_ms or 0) + 1):
                first = min(first, wake * 1000)
            self._set(newest, first, wake)
            return iter(())
        entries = sorted(e for pdf in rows for e in _entries(pdf))
        found = self.take(key, entries)
        newest = entries[-1][0] if newest is None else max(newest, entries[-1][0])
        if self.keep_ms is not None:
            self._set(newest, None, wake)
        return iter([self.frame(found)] if found else ())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        newest, _ = self.clock.get()
        held = list(self.held.get()) if self.held.exists() else []
        due = sorted(tuple(e) for e in held if e[0] <= now * 1000)
        rest = [tuple(e) for e in held if e[0] > now * 1000]
        found: list[tuple] = []
        if due:
            found += self.take(key, due)
            newest = due[-1][0] if newest is None else max(newest, due[-1][0])
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if newest is not None and self.keep_ms is not None and newest // 1000 + self.keep_ms < now:
            found += self.expire(key)
            self.forget()
            newest = None
        if newest is None and not rest:
            self.clock.clear()
        else:
            self._set(newest, min((e[0] for e in rest), default=None), None)
        return iter([self.frame(found)] if found else ())

    def close(self) -> None:
        pass


class _Lifecycle(_Keyed):
    """pending, running, terminal; entries out of turn change nothing."""

    def __init__(self, keep_seconds: int | None, ordered: bool):
        self.keep_ms = None if keep_seconds is None else keep_seconds * 1000
        self.ordered = ordered

    def init(self, handle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status STRING, us BIGINT")

    def forget(self) -> None:
        self.status.clear()

    def frame(self, found):
        import pandas as pd

        out = pd.DataFrame(found, columns=["job_id", "from_status", "to_status", "ts", "event_id"])
        return out.assign(ts=pd.to_datetime(out["ts"], unit="us"))

    def take(self, key, entries):
        current, since = self.status.get() if self.status.exists() else (None, None)
        moves = []
        for us, event_id, status in entries:
            if current is not None and since is not None and self.ordered and us - since > self.keep_ms * 1000:
                current = None  # silent for longer than it is remembered
            legal = (
                (current is None and status == "pending")
                or (current == "pending" and status == "running")
                or (current == "running" and status in TERMINAL)
            )
            if legal:
                moves.append((key[0], current, status, us, event_id))
                current = status
            since = us if since is None else max(since, us)
        if current is not None:
            self.status.update((current, since))
        return moves


def _mode(delay: str | None) -> str:
    return "None" if delay is None else "EventTime"


def _timed(events: DataFrame, *columns, delay: str | None) -> DataFrame:
    """Entries with a time, and their microseconds."""
    if delay is not None:
        events = events.withWatermark("ts", delay)
    at = F.col("ts").cast("timestamp")
    named = events.select(*columns, at.alias("ts"), "event_id", F.unix_micros(at).alias("us"))
    return named.filter(F.col("us").isNotNull())


def _need_delay(ordered: bool, delay: str | None) -> None:
    if ordered and delay is None:
        raise ValueError("entries can be put in order only up to a watermark: name a delay")


def stream_job_state(
    events: DataFrame, delay: str | None = None, keep_seconds: int = TERMINAL_TTL, ordered: bool = False
) -> DataFrame:
    """One row per legal transition of every job (T3); state is one status per job.

    With a watermark ``delay`` a job leaves the state ``keep_seconds`` after its
    last entry; entries that come later than the watermark are not seen.
    Without one every job is remembered and no entry is too late. ``ordered``
    holds entries until the watermark has passed them: entries that come in
    any order within the delay then give the transitions of the batch form.
    Entries without a time change nothing.
    """
    _need_delay(ordered, delay)
    schema = "job_id STRING, from_status STRING, to_status STRING, ts TIMESTAMP, event_id BIGINT"
    return (
        _timed(events, "job_id", "status", delay=delay)
        .groupBy("job_id")
        .transformWithStateInPandas(
            _Lifecycle(None if delay is None else keep_seconds, ordered), schema,
            outputMode="Append", timeMode=_mode(delay),
        )
    )


class _Silent(_Keyed):
    """Reports a job that has had no entry for ``keep_ms``, then forgets it."""

    def __init__(self, seconds: int, statuses: tuple[str, ...] | None, ordered: bool):
        self.keep_ms, self.statuses, self.ordered = seconds * 1000, statuses, ordered

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us BIGINT, status STRING")

    def forget(self) -> None:
        self.last.clear()

    def frame(self, found):
        import pandas as pd

        out = pd.DataFrame(found, columns=["job_id", "status", "since"])
        return out.assign(since=pd.to_datetime(out["since"], unit="us"))

    def _watched(self, last) -> bool:
        return last is not None and (self.statuses is None or last[1] in self.statuses)

    def take(self, key, entries):
        last, found = (self.last.get() if self.last.exists() else None), []
        for us, _, status in entries:
            if last is not None and us < last[0]:
                continue
            if self._watched(last) and us - last[0] > self.keep_ms * 1000:
                found.append((key[0], last[1], last[0]))
            last = (us, status)
        self.last.update(tuple(last))
        return found

    def expire(self, key):
        last = self.last.get() if self.last.exists() else None
        return [(key[0], last[1], last[0])] if self._watched(last) else []


def _silent(events: DataFrame, seconds: int, statuses, delay: str, ordered: bool) -> DataFrame:
    return (
        _timed(events, "job_id", "status", delay=delay)
        .groupBy("job_id")
        .transformWithStateInPandas(
            _Silent(seconds, statuses, ordered), "job_id STRING, status STRING, since TIMESTAMP",
            outputMode="Append", timeMode="EventTime",
        )
    )


def stream_stale_jobs(
    events: DataFrame, ttl: int = STALE_SECONDS, delay: str = "0 seconds", ordered: bool = False
) -> DataFrame:
    """Active jobs without progress for ``ttl`` seconds of event time (T5): job_id, status, since.

    Entries without a time are no progress. ``ordered`` as in the job states.
    """
    return _silent(events, ttl, ACTIVE, delay, ordered)


def stream_expire_jobs(
    events: DataFrame, ttl: int = TERMINAL_TTL, delay: str = "0 seconds", ordered: bool = False
) -> DataFrame:
    """Jobs whose time to live has passed since their last entry (T4), as they leave the state."""
    return _silent(events, ttl, None, delay, ordered)


class _Limiter(_Keyed):
    """Accepted times of the last window, at most ``most`` of them."""

    def __init__(self, most: int, window_seconds: int, forgets: bool, ordered: bool):
        self.most, self.span, self.ordered = most, window_seconds * 1_000_000, ordered
        self.keep_ms = window_seconds * 1000 if forgets else None

    def init(self, handle) -> None:
        super().init(handle)
        self.log = handle.getListState("accepted", "t BIGINT")

    def forget(self) -> None:
        self.log.clear()

    def frame(self, found):
        import pandas as pd

        return pd.DataFrame(found, columns=["key", "event_id", "allowed"])

    def take(self, key, entries):
        kept = sorted(t[0] for t in self.log.get()) if self.log.exists() else []
        out = []
        for us, event_id, _ in entries:
            kept = [t for t in kept if t > us - self.span]
            ok = len(kept) < self.most
            if ok:
                kept.append(us)
            out.append((key[0], event_id, ok))
        if kept:
            self.log.put([(t,) for t in kept])
        else:
            self.log.clear()
        return out


def stream_rate_limit(
    events: DataFrame, key: str, max_requests: int = 5, window_seconds: int = 60,
    delay: str | None = None, ordered: bool = False,
) -> DataFrame:
    """Sliding-log decisions on a stream (T6); the state holds accepted times only.

    With a watermark ``delay`` a key leaves the state one window after its last
    request; requests later than the watermark are not seen. ``ordered`` as in
    the job states: decisions then follow once the watermark has passed the
    requests. A request without a time has no place in the log and is returned
    undecided (allowed null).
    """
    _need_delay(ordered, delay)
    named = F.col(key).cast("string").alias("key")
    timed = _timed(events, named, F.lit(None).cast("string").alias("status"), delay=delay)
    decided = timed.groupBy("key").transformWithStateInPandas(
        _Limiter(max_requests, window_seconds, delay is not None, ordered),
        "key STRING, event_id BIGINT, allowed BOOLEAN",
        outputMode="Append", timeMode=_mode(delay),
    )
    untimed = events.filter(F.col("ts").cast("timestamp").isNull())
    return decided.unionByName(untimed.select(named, "event_id", F.lit(None).cast("boolean").alias("allowed")))
