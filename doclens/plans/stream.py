"""Streams over the events, run to their end; batch SQL is what they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..sources.corpus import FEEDBACK_SQL, table
from ..sources.store import scratch
from ..streaming import cache_state, jobs
from .feedback import LOOKUP_SQL
from .registry import query


def _events(spark, sf_dir):
    # a glob of one file: the stream reads a folder's worth of files
    return jobs.event_stream(spark, f"{sf_dir}/event[s].parquet", files_per_batch=10)


def _paths(spark):
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/checkpoint"


@query(f"WITH {FEEDBACK_SQL} SELECT document_name, round(sum(CASE feedback_type WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -0.5 ELSE 0 END)::DOUBLE, 6) AS relevance_score, count(*) AS n, round(avg(stars), 6) AS avg_stars FROM fb GROUP BY ALL")
def stream_running_scores(spark, sf_dir):
    rows, checkpoint = _paths(spark)
    jobs.latest_into(jobs.running_scores(jobs.as_feedback(_events(spark, sf_dir))), rows, checkpoint, ["document_name"])
    return jobs.newest(spark, rows, ["document_name"])


@query("WITH r AS (SELECT 'component-' || (user_id % 10) AS component, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS n FROM events), c AS (SELECT component, count(*) AS checks, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND n <= 3) AS recent, count(*) FILTER (NOT ok AND n = 1) AS newest FROM r GROUP BY component) SELECT component, checks, failed, CASE WHEN recent = 3 THEN 'unhealthy' WHEN newest = 1 THEN 'degraded' ELSE 'healthy' END AS status FROM c")
def stream_component_status(spark, sf_dir):
    rows, checkpoint = _paths(spark)
    checks = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("component-"), (F.col("user_id") % 10).cast("string")).alias("component"), (F.col("event_type") != "error").alias("ok"))
    jobs.status_into(checks, rows, checkpoint)
    return jobs.status_of(spark, rows)


@query(f"WITH {FEEDBACK_SQL}, e AS (SELECT *, max(ts) OVER () AS last FROM fb), w AS (SELECT document_name, unnest(range(ts::DATE::TIMESTAMP - INTERVAL 6 DAY, ts::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS begin, last FROM e WHERE feedback_type = 'positive') SELECT begin, begin + INTERVAL 7 DAY AS finish, document_name, count(*) AS n FROM w WHERE begin + INTERVAL 7 DAY <= date_trunc('millisecond', last) - INTERVAL 1 DAY GROUP BY ALL")
def stream_windowed_feedback(spark, sf_dir):
    rows, checkpoint = _paths(spark)
    out = jobs.windowed_counts(jobs.as_feedback(_events(spark, sf_dir)))
    jobs.run_available(out, rows, checkpoint)
    return spark.read.schema("begin timestamp, finish timestamp, document_name string, n long").parquet(rows)


@query(f"WITH RECURSIVE {LOOKUP_SQL} SELECT id, ts, key, hit FROM lk")
def stream_cache_lookups(spark, sf_dir):
    """Lookups of all events, in files as they came, through keyed state in several batches."""
    rows, checkpoint = _paths(spark)
    events = table(spark, sf_dir, "events")
    asked = F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"))
    cache_state.replayed(events.select(F.col("event_id").alias("id"), cache_key(asked, F.lit("")).alias("key"), "ts"), f"{rows}-source", 4)
    cache_state.run_lookups(spark, f"{rows}-source", rows, checkpoint)
    return cache_state.judged(spark, rows).select("id", "ts", "key", "hit")
