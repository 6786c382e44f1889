"""Streams of change, progress, request and head events.

Every function takes a batch or a streaming DataFrame with `ts` as TIMESTAMP. Streams get a watermark (one minute unless
told otherwise); rows later than that are dropped by Spark, which counts them in its progress reports.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import PRUNED, glob_regex

LATE, QUIET, THROTTLE, SPACED_MS = "1 minute", "30 seconds", "250 milliseconds", 500
PER_MINUTE, PER_DAY = 60, 900
IGNORED = tuple(f"**/{d}/**" for d in PRUNED)


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def debounce_changes(events: DataFrame, quiet: str = QUIET, ignored: tuple[str, ...] = IGNORED, late: str = LATE) -> DataFrame:
    """project_id, start, fire_at, changes: one re-index per project once `quiet` has passed without a change. events: project_id, path, ts."""
    for glob in ignored:
        events = events.filter(~F.col("path").rlike(glob_regex(glob)))
    session = F.session_window("ts", quiet)
    return _marked(events, late).groupBy("project_id", session.alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("project_id", F.col("w.start").alias("start"), F.col("w.end").alias("fire_at"), "changes")


def throttle_progress(events: DataFrame, every: str = THROTTLE, late: str = LATE) -> DataFrame:
    """project_id, start, the latest update of each interval of the clock. events: project_id, event_id, phase, done, ts."""
    newest = F.max_by(F.struct("event_id", "phase", "done", "ts"), F.struct("ts", "event_id")).alias("u")
    return _marked(events, late).groupBy("project_id", F.window("ts", every).alias("w")).agg(newest).select("project_id", F.col("w.start").alias("start"), "u.event_id", "u.phase", "u.done", "u.ts")


def coalesced(rows: list[tuple], last: tuple | None, held: tuple | None, spaced_ms: int) -> tuple[list[tuple], tuple | None, tuple | None]:
    """(rows to emit, last emitted, row held back) for rows (ts in ms, phase, done) in order: changes of phase, after the last row held in the old phase, and rows spaced_ms after the last one."""
    out = []
    for row in rows:
        if last is None or row[1] != last[1]:
            if held is not None:
                out.append(held)
            out.append(row)
            last, held = row, None
        elif row[0] - last[0] >= spaced_ms:
            out.append(row)
            last, held = row, None
        else:
            held = row
    return out, last, held


def coalesce_progress(events: DataFrame, spaced_ms: int = SPACED_MS, late: str = LATE, idle_ms: int = 3_600_000) -> DataFrame:
    """project_id, ts, phase, done. Streaming only; a project's state goes after idle_ms without events, its held row is then emitted.

    No phase is a phase of its own; rows without time are left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = held = None
        if state.exists:
            a, b, c, d, e, f = state.get
            last, held = (a, b, c) if a is not None else None, (d, e, f) if d is not None else None
        if state.hasTimedOut:
            state.remove()
            out = [held] if held else []
        else:
            rows = [(int(r.ts.value // 1_000_000), None if pd.isna(r.phase) else r.phase, float("nan") if r.done is None else float(r.done)) for f in frames for r in f.itertuples() if not pd.isna(r.ts)]
            # In order of time; rows without phase before those with one.
            rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
            out, last, held = coalesced(rows, last, held, spaced_ms)
            state.update((*(last or (None, None, None)), *(held or (None, None, None))))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"project_id": [key[0]] * len(out), "ts": [pd.Timestamp(r[0], unit="ms") for r in out], "phase": [r[1] for r in out], "done": [r[2] for r in out]})

    kind = events.schema["project_id"].dataType.simpleString()
    state = "a long, b string, c double, d long, e string, f double"
    return _marked(events, late).groupBy("project_id").applyInPandasWithState(step, f"project_id {kind}, ts timestamp, phase string, done double", state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def request_quota(requests: DataFrame, late: str = LATE, minute: int = PER_MINUTE, day: int = PER_DAY, size: str = "1 minute") -> DataFrame:
    """project_id, start, requests, over: by interval (a minute, or `1 day` with the day's limit). requests: project_id, requests, ts."""
    limit = day if "day" in size else minute
    out = _marked(requests, late).groupBy("project_id", F.window("ts", size).alias("w")).agg(F.sum("requests").cast("long").alias("requests"))
    return out.select("project_id", F.col("w.start").alias("start"), "requests", (F.col("requests") > limit).alias("over"))


def latest_status(jobs: DataFrame) -> DataFrame:
    """project_id, job_id, status, done (whether it is an end): the newest row; for streams in update mode. jobs: project_id, job_id, status, ts."""
    newest = jobs.groupBy("project_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("ts", "job_id")).alias("j"))
    return newest.select("project_id", "j.job_id", "j.status", F.col("j.status").isin("succeeded", "failed", "cancelled").alias("done"))


def head_moved(polls: DataFrame, indexed: DataFrame) -> DataFrame:
    """Polls whose revision isn't the indexed one. polls: project_id, revision, ts; indexed: project_id, head_revision (a table)."""
    return polls.join(indexed, "project_id").filter(~F.col("revision").eqNullSafe(F.col("head_revision"))).select("project_id", "revision", "ts")


def dedupe_requests(requests: DataFrame, late: str = LATE) -> DataFrame:
    """One request for each project and revision while its state is held. Batches: the first of each."""
    if requests.isStreaming:
        return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["project_id", "revision"])
    columns = [c for c in requests.columns if c not in ("project_id", "revision")]
    first = requests.groupBy("project_id", "revision").agg(F.min(F.struct("ts", *[c for c in columns if c != "ts"])).alias("r"))
    return first.select("project_id", "revision", *[F.col(f"r.{c}").alias(c) for c in columns])


def incremental_index(files: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands each batch of changed files to `index`, which must be idempotent by content hash; says the query."""
    return files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
