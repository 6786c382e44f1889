"""Batch forms of the stream operators, over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as S
from .derive import EVENTS, JOBS, events, jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _plain(df, *columns):
    """Timestamps without zone, as the SQL has them."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query(f"""WITH {EVENTS}, g AS (SELECT *, sum(CASE WHEN ts > prev + INTERVAL 6 HOUR OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS prev FROM ev))
SELECT project_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS fire_at, count(*) AS changes FROM g GROUP BY project_id, s""")
def debounce_changes(spark, sf_dir):
    return _plain(S.debounce_changes(events(spark, sf_dir), "6 hours"), "start", "fire_at")


@query(f"WITH {EVENTS} SELECT project_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, event_id, phase FROM ev QUALIFY row_number() OVER (PARTITION BY project_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts DESC, event_id DESC) = 1")
def throttle_progress(spark, sf_dir):
    return _plain(S.throttle_progress(events(spark, sf_dir), "1 hour"), "start").select("project_id", "start", "event_id", "phase")


@query(f"WITH {EVENTS} SELECT project_id, time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS requests, count(*) > 3 AS over FROM ev GROUP BY ALL".replace("AS over", 'AS "over"'))
def request_quota(spark, sf_dir):
    return _plain(S.request_quota(events(spark, sf_dir).withColumn("requests", F.lit(1)), day=3, size="1 day"), "start")


@query(f"WITH {JOBS} SELECT project_id, job_id, status, false AS done FROM jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, job_id DESC) = 1")
def latest_status(spark, sf_dir):
    return S.latest_status(jobs(spark, sf_dir).withColumnRenamed("created_at", "ts"))


@query(f"WITH {EVENTS} SELECT e.project_id, e.phase AS revision, e.ts FROM ev e JOIN (SELECT project_id, min(phase) AS head FROM ev GROUP BY 1) h USING (project_id) WHERE e.phase <> h.head")
def head_moved(spark, sf_dir):
    e = events(spark, sf_dir)
    polls = e.select("project_id", F.col("phase").alias("revision"), "ts")
    return _plain(S.head_moved(polls, e.groupBy("project_id").agg(F.min("phase").alias("head_revision"))), "ts")


@query(f"WITH {EVENTS} SELECT project_id, phase AS revision, ts, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY project_id, phase ORDER BY ts, event_id) = 1")
def dedupe_requests(spark, sf_dir):
    return _plain(S.dedupe_requests(events(spark, sf_dir).select("project_id", F.col("phase").alias("revision"), "ts", "event_id")), "ts")
