"""The response cache as keyed state of a stream: a value per key, judged as lookups arrive, that a timer takes away again."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state of keys is kept in; a session that runs these streams has to use it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "kind string, id long, key string, ts timestamp, hit boolean, lookups long"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(ts: datetime) -> int:
    delta = ts.astimezone(timezone.utc) - EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


class CachedLookups(StatefulProcessor):
    """Per key the time of its last store and the lookups since; one row out for each lookup, and one for each entry that expires.

    A batch's lookups of a key are judged in order of time and id.  A lookup that
    comes later than its turn is judged by the store there is: earlier than that
    store it misses and stores nothing.
    """

    def __init__(self, minutes: int):
        self.lifetime = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stored long, lookups long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.entry.get() if self.entry.exists() else None
        stored, lookups = (held[0], held[1]) if held else (None, 0)
        before = stored
        for at, id_, ts in sorted((_micros(r["ts"]), r["id"], r["ts"]) for r in rows):
            hit = stored is not None and 0 <= at - stored < self.lifetime
            if hit:
                lookups += 1
            elif stored is None or at >= stored:
                stored, lookups = at, 1
            yield Row(kind="lookup", id=id_, key=key[0], ts=ts, hit=hit, lookups=lookups)
        if stored is not None:
            self.entry.update((stored, lookups))
            if stored != before:
                if before is not None:
                    self.handle.deleteTimer(self._due(before))
                self.handle.registerTimer(self._due(stored))

    def _due(self, stored: int) -> int:
        """The first millisecond at which the entry is no longer valid."""
        return -(-(stored + self.lifetime) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists():
            stored, lookups = self.entry.get()
            if self._due(stored) <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield Row(kind="expired", id=None, key=key[0], ts=datetime.fromtimestamp((stored + self.lifetime) / 1e6, timezone.utc), hit=None, lookups=lookups)

    def close(self) -> None:
        pass


def cached_lookups(lookups: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """A stream of lookups (id, key, ts) with hit, and a row for each entry whose time is over: kind `lookup` or `expired`.

    Its state is one entry for each key that was asked in the last `minutes` before the
    watermark.  Lookups without a time or key are left out, as a watermark has no place for
    them; those behind the watermark are dropped and counted in the query's progress.
    """
    ready = lookups.filter("ts IS NOT NULL AND key IS NOT NULL").withWatermark("ts", late)
    return ready.groupBy("key").transformWithState(CachedLookups(minutes), OUT, "Append", "EventTime")


def replayed(rows: DataFrame, path: str, parts: int, by: str = "ts") -> None:
    """rows as files in order of `by`, with file times in that order too, so that a stream reads them as they came."""
    spark = rows.sparkSession
    rows.repartitionByRange(parts, by).sortWithinPartitions(by).write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), 1_600_000_000_000 + 1000 * i, -1)


def run_lookups(spark: SparkSession, source: str, path: str, checkpoint: str, minutes: int = 60, files_per_batch: int = 1, late: str = "10 minutes", schema: str = "id long, key string, ts timestamp", trigger: dict | None = None) -> None:
    """Runs the stream of the Parquet lookups in `source` over what is there now; what a run has done, the next one with this checkpoint goes on from."""
    name, provider = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        out = cached_lookups(rows, minutes, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        out.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def judged(spark: SparkSession, path: str) -> DataFrame:
    """(id, key, ts, hit) of what run_lookups has written."""
    return spark.read.schema(OUT).parquet(path).filter(F.col("kind") == "lookup").select("id", "key", "ts", "hit")
