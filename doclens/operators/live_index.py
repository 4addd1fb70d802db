"""A term index that is kept up to date: segments of postings by append, deletions as marks, merges that sum up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import VersionedTable
from .retrieval import postings

POSTINGS, STATS, SIZES = "postings", "stats", "sizes"


def _stats(entries: DataFrame, sign: int) -> DataFrame:
    return entries.groupBy("term").agg((sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("tf")).alias("cf"))


def _sizes(entries: DataFrame, sign: int) -> DataFrame:
    each = entries.select("id", "length").distinct()
    return each.agg((sign * F.count(F.lit(1))).alias("docs"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("length"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 OR cf <> 0")


class LiveIndex:
    """Postings (id, term, tf, length) with statistics that follow every change, without reading what didn't change.

    An append adds the new documents' statistics, a deletion adds those of the
    documents that go with a minus sign; both are small segments, which merges sum up.
    Documents without a term are in no posting and count nowhere.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Adds documents; their ids must not be live in the index."""
        entries = postings(docs, id_col, text_col)
        return self.table.commit("append", self.table.manifest(), add={POSTINGS: entries, STATS: _stats(entries, 1), SIZES: _sizes(entries, 1)})

    def delete(self, where: Column) -> int:
        """Takes out the documents whose `id` the condition names."""
        base = self.table.manifest()
        live = self.table._live(base, POSTINGS, True)
        if live is None:
            return base["version"]
        gone = live.filter(where)
        return self.table.commit("delete", base, add={STATS: _stats(gone, -1), SIZES: _sizes(gone, -1)}, mark={POSTINGS: gone})

    def merge(self, fanout: int = 4) -> int:
        self.table.merge(POSTINGS, fanout)
        self.table.merge(SIZES, fanout, lambda df: df.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")))
        return self.table.merge(STATS, fanout, _summed)

    def postings(self, version: int | None = None) -> DataFrame | None:
        return self.table.rows(POSTINGS, version)

    def statistics(self, version: int | None = None) -> DataFrame | None:
        """(term, df, cf) of the live documents."""
        rows = self.table.rows(STATS, version)
        return None if rows is None else _summed(rows)

    def size(self, version: int | None = None) -> tuple[int, float]:
        """Documents, and their mean length."""
        rows = self.table.rows(SIZES, version)
        docs, length = (0, 0) if rows is None else rows.agg(F.sum("docs"), F.sum("length")).first()
        return docs, length / docs if docs else 0.0
