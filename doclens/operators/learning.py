"""Learning after each positive response: counts of documents and pairs over the last days, to which rows are added and from which they are taken again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def as_of(changes: DataFrame, keys: list[str], order: Column, slot: int = DAY) -> DataFrame:
    """changes (keys, at, change, ...) with n: the sum of the key's changes up to and with each row, in `order` (which begins with at).

    Sums by key and slot of time come first, running over slots; rows are ordered only
    within a slot, so a key with a large share of all rows is no single task.
    """
    ready = changes.withColumns({"__slot": F.floor(F.col("at") / slot), "__order": order})
    sums = ready.groupBy(*keys, "__slot").agg(F.sum("change").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__slot", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__slot").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    return ready.withColumn("__in", F.sum("change").over(within)).join(sums, [*keys, "__slot"]).withColumn("n", F.col("__before") + F.col("__in")).drop("__slot", "__order", "__before", "__in")


def _entering_and_leaving(rows: DataFrame, days: int) -> DataFrame:
    """rows (..., basket, at): once as they enter, and once as they leave; a row of exactly `days` ago still counts."""
    step = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("late"), F.lit(1).alias("change")), F.struct(F.lit(days * DAY + 1).alias("late"), F.lit(-1).alias("change"))))
    return rows.withColumn("__s", step).withColumns({"at": F.col("at") + F.col("__s.late"), "change": F.col("__s.change")}).drop("__s")


def learned_pairs(responses: DataFrame, days: int = 7, support: int = 3, least: float = 0.6) -> DataFrame:
    """(basket, ts, doc1, doc2, pairs, n1, n2, confidence, learned): what a run of learning right after each response says of its pairs.

    responses: (basket, ts, document_name), a row for each document of a positive
    response, whose basket is unique; repeated rows count once.  pairs, n1 and n2 count the responses of the
    last `days` up to this one (in order of ts and basket) that hold both, or
    either; confidence is pairs over the larger of n1 and n2; learned is `created`
    where both limits are met for the first time, `strengthened` where they are met
    again, null else.  Rows without basket, time or document count nowhere.  Pairs that a response doesn't
    hold gain nothing by it and get no row.
    """
    rows = responses.filter("basket IS NOT NULL AND ts IS NOT NULL AND document_name IS NOT NULL")
    # a basket has one time, its last
    baskets = rows.groupBy("basket").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("at"), F.array_sort(F.collect_set("document_name")).alias("documents"))
    places = F.posexplode("documents").alias("__i", "doc1")
    pairs = baskets.select("basket", "at", "documents", places).withColumn("doc2", F.explode(F.slice("documents", F.col("__i") + 2, F.size("documents")))).select("basket", "at", "doc1", "doc2")
    # what leaves does so before what enters at the same time; a question comes after its own row
    order = F.struct("at", "change", "basket")
    counted = as_of(_entering_and_leaving(pairs, days), ["doc1", "doc2"], order).filter("change = 1").select("basket", "at", "doc1", "doc2", F.col("n").alias("pairs"))
    single = baskets.select("basket", "at", F.explode("documents").alias("doc"))
    entered = as_of(_entering_and_leaving(single, days), ["doc"], order).filter("change = 1").select("basket", "doc", "n")
    for side in ("1", "2"):
        counted = counted.join(entered.select("basket", F.col("doc").alias(f"doc{side}"), F.col("n").alias(f"n{side}")), ["basket", f"doc{side}"])
    counted = counted.withColumn("confidence", F.round(F.col("pairs") / F.greatest("n1", "n2"), 6))
    good = (F.col("pairs") >= support) & (F.col("pairs") / F.greatest("n1", "n2") >= least)
    first = counted.filter(good).groupBy("doc1", "doc2").agg(F.min(F.struct("at", "basket")).alias("__first"))
    learned = F.when(~good, None).when(F.struct("at", "basket") == F.col("__first"), "created").otherwise("strengthened")
    return counted.join(first, ["doc1", "doc2"], "left").select("basket", F.timestamp_micros("at").alias("ts"), "doc1", "doc2", "pairs", "n1", "n2", "confidence", learned.alias("learned"))


def learning_runs(pairs: DataFrame) -> DataFrame:
    """(day, runs, created, strengthened): what the runs of each day did; pairs as from learned_pairs."""
    return pairs.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("basket").alias("runs"), F.count_if(F.col("learned") == "created").alias("created"), F.count_if(F.col("learned") == "strengthened").alias("strengthened"))
