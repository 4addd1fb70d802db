"""Positions of rows in their groups, and hashes of ordered rows, without a group in one task's memory."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, parallelism

#: Rows that `listed_sha256` joins to one before they are sent on.
JOINED_ROWS = 4096


def sorted_rows(df: DataFrame, order: list[Column], steps: Steps, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """then(rows of df in the given order), written, with `at`: a number that rises in that order over all rows.

    The rows are dealt out by range, so a large group lies in several parts.  `then`
    may drop, repeat and change rows where they stand.
    """
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    return steps.written(then(dealt).withColumn("at", F.monotonically_increasing_id()))


def positions(held: DataFrame, group: str) -> DataFrame:
    """Rows of sorted_rows with `pos`, counted from 0 in each group; a group has one row of sums for each part it lies in."""
    part = F.shiftright("at", 33)  # the number's upper bits are those of the part it was given in
    parts = held.groupBy(group, part.alias("__part")).agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    out = held.withColumn("__part", part).join(shifts, [group, "__part"])
    return out.withColumn("pos", F.col("at") + F.col("__shift")).drop("__part", "__shift", "at")


def runs(batches, keys: list[str]):
    """(key, rows) of each run of equal keys in sorted batches, in order; a run that goes on in the next batch comes in parts."""
    for pdf in batches:
        if len(pdf):
            changed = (pdf[keys].ne(pdf[keys].shift())).any(axis=1).to_numpy().nonzero()[0].tolist()
            for a, b in zip(changed, [*changed[1:], len(pdf)]):
                yield tuple(pdf[k].iat[a] for k in keys), pdf.iloc[a:b]


def listed_sha256(rows: DataFrame, group: str, number: str, steps: Steps) -> DataFrame:
    """(group, sha256): SHA-256 of the group's decimal numbers, ascending and comma-joined.

    Numbers are sorted by range and joined to strings of up to JOINED_ROWS of them
    where they lie.  The hash itself has to read a group's strings one after the
    other; it does so as a stream, so a large group costs its task time, not memory.
    """
    spark = rows.sparkSession
    n, kind = parallelism(spark), rows.schema[group].dataType.simpleString()

    def join(batches):
        key, held = None, []
        for pdf in batches:
            out = []
            for found, n_ in zip(pdf[group].tolist(), pdf[number].tolist()):
                if held and (found != key or len(held) >= JOINED_ROWS):
                    out.append((key, held[0], ",".join(map(str, held))))
                    held = []
                key = found
                held.append(n_)
            if out:
                yield pd.DataFrame(out, columns=[group, "first", "text"])
        if held:
            yield pd.DataFrame([(key, held[0], ",".join(map(str, held)))], columns=[group, "first", "text"])

    def fold(batches):
        key, sha = None, None
        for pdf in batches:
            done = []
            for found, text in zip(pdf[group].tolist(), pdf["text"].tolist()):
                if sha is not None and found == key:
                    sha.update(b"," + text.encode())
                    continue
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = found, hashlib.sha256(text.encode())
            if done:
                yield pd.DataFrame(done, columns=[group, "sha256"])
        if sha is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=[group, "sha256"])

    held = steps.written(rows.select(group, number))
    lists = held.repartitionByRange(n, group, number).sortWithinPartitions(group, number).mapInPandas(join, f"{group} {kind}, first long, text string")
    return lists.repartition(n, group).sortWithinPartitions(group, "first").mapInPandas(fold, f"{group} {kind}, sha256 string")
