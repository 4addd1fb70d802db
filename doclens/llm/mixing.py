"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, a target per source follows from the weights, and
target over tokens is the source's repetition rate.  Each document is then
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability
is the fraction of the rate.

The per-source sums are partial sums before any shuffle, so a source with a
third of all rows costs one row per task.  The table of targets (a row for each
source) is stored and counted before it is joined back: up to BROADCAST_BYTES of
them go to every task, so that no text is moved.  Of more sources the largest do so, and the
documents of the others, each of few words beside the whole, are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: 52 bits, so that the quotient is a double without rounding.
_DRAWS = float(1 << 52)
#: Most bytes of targets, some 100 and the longest name for each source, that are sent to every task.
BROADCAST_BYTES = 20_000_000


def n_words(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, weigh `weights` in turn and share
    `share` of all sizes.  A target stops at `most` times its source's size; what
    is above is shared again by weight until no target is above.  That fixed
    point is found in one pass: in order of cap over weight the first k sources
    are capped, k being the first for which the others' common level stays below
    the next cap.  A source of size 0 has target 0.
    """
    k = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % k + 1).cast("int"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("common", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped_before")) / F.col("weight_left"))
    s = s.withColumn("common", F.min(F.when(F.col("common") <= F.col("level"), F.struct("level", "common"))).over(every)["common"])
    target = F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def draw(*columns: str, seed: str = "mix") -> Column:
    """A number in [0, 1) from a hash of the columns: the same in every run and at every size."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(_DRAWS)


def _joined(keyed: DataFrame, targets: DataFrame, key: str, has: str, size: str) -> DataFrame:
    """The documents with their source's row of targets; sources of most words by broadcast, as many as BROADCAST_BYTES holds."""
    n, longest = targets.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length(key)), F.lit(0))).first()
    most = BROADCAST_BYTES // (100 + longest)
    if n <= most:
        return keyed.join(F.broadcast(targets), [key, has])
    largest = written(targets.orderBy(F.desc(size), has, key).limit(most))
    rest = keyed.join(F.broadcast(largest.select(key, has)), [key, has], "left_anti").join(targets, [key, has])
    return keyed.join(F.broadcast(largest), [key, has]).unionByName(rest)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, prefix: str = "mix_") -> DataFrame:
    """The documents with size, source_size, target and copies, under names that start with prefix; all rows of docs kept.

    Null or empty text has size 0; a null source is a source of its own, last in
    order.  Rows that repeat an id draw alike.  An empty table gives an empty
    table.  Columns of docs that carry the names of the added ones are replaced.
    """
    size, source_size, target, copies, key, has = (prefix + n for n in ("size", "source_size", "target", "copies", "source_key", "has_source"))
    docs = docs.drop(size, source_size, target, copies, key, has)
    keyed = docs.withColumns({size: n_words(F.col(text_col)), key: F.coalesce(F.col(source_col), F.lit("")), has: F.col(source_col).isNotNull()})
    sums = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, most).select(F.coalesce("source", F.lit("")).alias(key), F.col("source").isNotNull().alias(has), F.col("source_size").alias(source_size), F.col("target").alias(target))
    out = _joined(keyed, written(targets), key, has, source_size).drop(key, has)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn(copies, (whole + (draw(id_col) < rate - whole).cast("long")).cast("long"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as many times as it is taken, in the columns of docs."""
    taken = mix(docs, prefix="__mix_", **options)
    copies = F.explode(F.when(F.col("__mix_copies") > 0, F.sequence(F.lit(1), F.col("__mix_copies"))).otherwise(F.array().cast("array<bigint>")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias("__copy")).drop("__copy")
