"""Reading text, Markdown, HTML and JSON files, and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


KINDS = "*.{txt,md,html}"


def list_files(spark: SparkSession, folder: str, kinds: str = KINDS) -> DataFrame:
    """(path, length, modificationTime) of the supported files, folders below included; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", kinds).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def read_texts(spark: SparkSession, folder: str, kinds: str = "*.{txt,md}") -> DataFrame:
    """One row per file: file_name, document_name, file_path, text."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=kinds, recursiveFileLookup=True)
    path = F.input_file_name()
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return rows.select(name.alias("file_name"), F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "").alias("document_name"), path.alias("file_path"), F.col("value").alias("text"))


def resolved_text(original: str = "original_text", text: str = "text", node: str = "node"):
    """original_text, else text, else the text of a JSON node; empty counts as missing."""
    empty = F.lit("")
    return F.coalesce(F.nullif(F.col(original), empty), F.nullif(F.col(text), empty), F.get_json_object(node, "$.text"))


TOC = "document_name string, elements array<struct<type: string, identifier: string, title: string, page_number: int>>"


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of stored tables of contents; keys may be absent."""
    return spark.read.schema(TOC).json(path, multiLine=True).select("document_name", F.posexplode("elements").alias("pos", "e")).select("document_name", "pos", "e.*")


CATEGORIES = "file_name string, category string, project string"


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORIES).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_report(results: DataFrame) -> DataFrame:
    """(query_id, report): question, answer context and numbered sources as Markdown; results hold query, context and sources (array of strings)."""
    numbered = F.array_join(F.transform("sources", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return results.select("query_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "query"), "context", F.lit("## Sources"), numbered).alias("report"))


def html_report(findings: DataFrame) -> DataFrame:
    """(source_doc, report): findings (number, severity, reference_doc, chunk_id) of a document as an HTML table."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[x for c in ("number", "severity", "reference_doc", "chunk_id") for x in (F.lit("<td>"), safe(c), F.lit("</td>"))])
    rows = findings.groupBy("source_doc").agg(F.array_join(F.sort_array(F.collect_list(F.struct("number", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("r"))))["r"], "\n").alias("rows"))
    return rows.select("source_doc", F.concat(F.lit("<h1>"), safe("source_doc"), F.lit("</h1>\n<table>\n"), "rows", F.lit("\n</table>")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\f\n")


