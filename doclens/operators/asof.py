"""What was newest at each row's time: the last entries before a lookup, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored


def numbered(entries: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries with `n`, their number in order of (ts, id) from 1; lookups with `n`, how many entries were stored strictly before them.

    Both are dealt out together by range of ts; numbers count on from range to
    range by one sum for each of them.
    """
    both = entries.select("ts", F.lit(1).alias("stores"), F.col("key").alias("id"), "vector").unionByName(lookups.select("ts", F.lit(0).alias("stores"), F.col("query_id").alias("id"), "vector"))
    # a lookup stands before the entries of its own moment
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, "ts", "stores", "id").sortWithinPartitions("ts", "stores", "id")
    held = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sums = held.groupBy("part").agg(F.sum("stores").alias("n"))  # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.sum("stores").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = held.withColumn("inside", inside).join(F.broadcast(shift), "part").withColumn("n", F.col("inside") + F.col("shift"))
    return (
        rows.filter("stores = 1").select(F.col("id").alias("key"), "ts", "vector", "n"),
        rows.filter("stores = 0").select(F.col("id").alias("query_id"), "ts", "vector", "n"),
    )


def nearest_before(lookups: DataFrame, entries: DataFrame, least: float = 0.92, recent: int = 100, lifetime: str = "7 days") -> DataFrame:
    """(query_id, key, similarity): for each lookup (query_id, vector, ts) the best of the `recent` entries (key, vector, ts) stored last before it.

    Entries of `lifetime` or older don't count, nor does one with the lookup's own id; only a
    similarity of `least` counts, ties go to the smaller key.  Entries are numbered in
    order of time and stand in blocks of `recent`: those that a lookup sees lie in its own
    block and the one before, so it meets twice `recent` entries at most.  Rows
    without a time or vector take no part.
    """
    own, asked = numbered(entries.filter("ts IS NOT NULL AND vector IS NOT NULL"), lookups.filter("ts IS NOT NULL AND vector IS NOT NULL"))
    block = lambda n: F.floor((n - 1) / recent)
    blocks = own.groupBy(block(F.col("n")).alias("block")).agg(F.collect_list(F.struct("n", "key", "ts", "vector")).alias("held"))
    wanted = asked.filter("n > 0").withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("n")), F.greatest(block(F.col("n")) - 1, F.lit(0))))))
    age = F.expr(f"ts - INTERVAL {lifetime}")
    seen = F.filter("held", lambda e: (e["n"] <= F.col("n")) & (e["n"] > F.col("n") - recent) & (e["ts"] > age) & (e["key"] != F.col("query_id")))
    scored = wanted.join(blocks, "block").select("query_id", F.transform(seen, lambda e: F.struct(F.round(T.cosine(F.col("vector"), e["vector"]), 6).alias("similarity"), (-e["key"]).alias("back"))).alias("found"))
    best = scored.groupBy("query_id").agg(F.max(F.array_max("found")).alias("b"))
    return best.filter(F.col("b.similarity") >= least).select("query_id", (-F.col("b.back")).alias("key"), F.col("b.similarity").alias("similarity"))
