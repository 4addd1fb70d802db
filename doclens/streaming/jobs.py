"""Incremental forms: event-time windows with watermarks, sums by batch, idempotent merges by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import delta

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_feedback(events: DataFrame) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return events.select(F.col("event_id").alias("feedback_id"), "ts", "user_id", F.concat(F.lit("SPEC-"), (k % 25).cast("string")).alias("document_name"), kind.alias("feedback_type"), (F.col("event_id") % 5 + 1).alias("stars"))


def running_scores(feedback: DataFrame) -> DataFrame:
    """(document_name, relevance_score, n): scores kept up to date with each batch (update mode)."""
    return feedback.groupBy("document_name").agg(F.round(F.sum(delta(F.col("feedback_type"))), 6).alias("relevance_score"), F.count(F.lit(1)).alias("n"), F.round(F.avg("stars"), 6).alias("avg_stars"))


def windowed_counts(feedback: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Positive feedback per document in sliding windows; rows later than `late` are dropped and show in the query's progress."""
    rows = feedback.withWatermark("ts", late).filter("feedback_type = 'positive'")
    return rows.groupBy(F.window("ts", length, slide), "document_name").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("finish"), "document_name", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one user's events with no pause longer than `gap`."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def first_lookups(lookups: DataFrame, lifetime: str = "60 minutes") -> DataFrame:
    """One row per key within the lifetime of its entry: those are the misses."""
    return lookups.withWatermark("ts", lifetime).dropDuplicatesWithinWatermark(["key"])


def status_into(checks: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of checks (id, ts, component, ok) over what is there now; each batch leaves one row per component.

    The row holds the checks, the failures and those behind the last success, made
    by partial sums before any shuffle, so no task holds a component's checks.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("component").agg(F.max(F.when(F.col("ok"), F.struct("ts", "id"))).alias("good"))
        rows = batch.join(F.broadcast(last) if last.count() <= 10_000 else last, "component")
        behind = F.col("good").isNull() | (F.struct("ts", "id") > F.col("good"))
        parts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(behind).alias("behind"), F.max(F.col("good").isNotNull()).alias("any_good"))
        parts.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    checks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def status_of(spark: SparkSession, path: str, failures: int = 3) -> DataFrame:
    """(component, checks, failed, status) after the batches of status_into; a run of failures goes on from batch to batch."""
    rows = spark.read.parquet(path).drop("part")
    last = rows.groupBy("component").agg(F.max(F.when(F.col("any_good"), F.col("batch"))).alias("good"))
    run = F.sum(F.when(F.col("batch") >= F.coalesce("good", F.lit(-1)), F.col("behind")).otherwise(0))
    out = rows.join(last, "component").groupBy("component").agg(F.sum("checks").alias("checks"), F.sum("failed").alias("failed"), run.alias("run"))
    return out.select("component", "checks", "failed", F.when(F.col("run") >= failures, "unhealthy").when(F.col("run") > 0, "degraded").otherwise("healthy").alias("status"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and ends; append mode writes Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Runs an updating stream over what is there now; each batch's rows are written under its id, so a repeated batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that latest_into wrote."""
    rows = spark.read.parquet(path).drop("part")
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")
