"""Stores and indexes that change: what is left after appends, deletions, updates and merges of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.live_index import LiveIndex
from ..sources.corpus import SPEC_SQL, spec_chunks, table
from ..sources.store import scratch
from ..sources.versions import VersionedTable
from .registry import query
from .retrieval import TOKEN_SQL


def _folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {SPEC_SQL}, r AS (SELECT file_name, page_number, chunk_id FROM spec WHERE file_name <> 'SPEC-3' UNION ALL SELECT 'SPEC-3', page_number, chunk_id FROM spec WHERE file_name = 'SPEC-3' AND page_number % 2 = 0),
    c AS (SELECT CASE file_name WHEN 'SPEC-5' THEN 'SPEC-five' ELSE file_name END AS file_name, page_number, CASE WHEN file_name IN ('SPEC-1', 'SPEC-2', 'SPEC-4') THEN 'power' ELSE 'Uncategorized' END AS category FROM r)
    SELECT file_name, category, count(*) AS chunks, sum(page_number)::BIGINT AS pages FROM c GROUP BY ALL""")
def versioned_store(spark, sf_dir):
    """All specification chunks through a load, a deletion, an append, a renaming, a recategorisation and merges."""
    chunks = spec_chunks(spark, sf_dir).withColumn("category", F.lit("Uncategorized"))
    store = VersionedTable(spark, _folder(spark, "store"))
    store.ingest(chunks)
    store.delete(F.col("file_name") == "SPEC-3")
    store.append(chunks.filter("file_name = 'SPEC-3' AND page_number % 2 = 0"))
    store.update(F.col("file_name") == "SPEC-5", {"file_name": F.lit("SPEC-five")})
    store.recategorise(spark.range(1, 5).filter("id <> 3").select(F.concat(F.lit("SPEC-"), F.col("id").cast("string")).alias("file_name"), F.lit("power").alias("category")))
    store.merge(fanout=2)
    return store.rows().groupBy("file_name", "category").agg(F.count(F.lit(1)).alias("chunks"), F.sum("page_number").alias("pages"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def live_index_statistics(spark, sf_dir):
    """All documents appended in four segments, a seventh of them deleted, half of these appended again, segments merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LiveIndex(spark, _folder(spark, "index"))
    for part in range(4):
        index.append(docs.filter(F.col("doc_id") % 4 == part))
    index.delete(F.col("id") % 7 == 0)
    index.append(docs.filter("doc_id % 14 = 0"))
    index.merge()
    return index.statistics()
