"""Documents that arrive as a stream: cut, searched for standards and appended to a versioned table, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, structure
from ..sources.versions import VersionedTable

DOCUMENTS = "file_name string, text string"


def enriched(documents: DataFrame) -> dict[str, DataFrame]:
    """The rows that documents (file_name, text) give: `chunks`, a section each, and `standards`, those a chunk names.

    Documents without a name or text give nothing; a document stands in one row, and
    a name that comes twice has its sections numbered through.
    """
    parts = structure.sections(documents.filter("file_name IS NOT NULL AND text <> ''"), "file_name").filter("level > 0 OR trim(content) <> ''")
    chunks = parts.select(
        F.concat_ws("#", "doc", F.col("section").cast("string")).alias("chunk_id"),
        F.col("doc").alias("file_name"),
        F.col("number").alias("section_number"),
        F.col("title").alias("section_title"),
        F.col("section").alias("pos"),
        F.col("content").alias("text"),
    )
    return {"chunks": chunks, "standards": entities.standards(chunks)}


def ingest(documents: DataFrame, path: str, checkpoint: str, app: str = "ingest", trigger: dict | None = None) -> None:
    """Runs a stream of documents into the versioned table at `path`.

    All rows of a batch become visible with one commit, which also notes the
    batch's number for `app`.  A batch that comes again after a failure, its
    commit made but its end not noted, is found there and left out.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        base = table.manifest()
        if base.get("batches", {}).get(app, -1) < batch_id:
            table.commit("ingest", base, add=enriched(batch), batch=(app, batch_id))

    documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of documents as they arrive."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
