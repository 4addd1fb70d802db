"""Structure of documents: sections, paths, chunks, Markdown tables, metadata of names, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"^(#{1,6}) +(?:([0-9]+(?:\.[0-9]+)*) +)?(.*)$"
LEVELS = 6


def lines(docs: DataFrame, doc: str = "doc_name", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, doc: str = "doc_name", text_col: str = "text") -> DataFrame:
    """(doc, section, level, number, title, content): the part of each Markdown heading down to the next; text before the first heading is section 0 of level 0."""
    rows = lines(docs, doc, text_col)
    level = F.length(F.regexp_extract("line", HEADING, 1))
    rows = rows.withColumn("level", F.when(F.col("line").rlike(HEADING), level).otherwise(0))
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))
    head = F.when(F.col("level") > 0, F.struct("level", "line"))
    body = F.when(F.col("level") == 0, F.struct("line_no", "line"))
    out = rows.groupBy("doc", "section").agg(F.max(head).alias("head"), F.array_join(F.sort_array(F.collect_list(body))["line"], "\n").alias("content"))
    line = F.coalesce("head.line", F.lit(""))
    return out.select("doc", F.col("section").cast("int").alias("section"), F.coalesce("head.level", F.lit(0)).alias("level"), F.regexp_extract(line, HEADING, 2).alias("number"), F.trim(F.regexp_extract(line, HEADING, 3)).alias("title"), "content")


def section_paths(parts: DataFrame) -> DataFrame:
    """Adds path: titles of the nearest earlier sections of lower level, joined by " > ", down to the section's own.

    For each level the last title is carried forward; a title counts only if no
    section of its level or lower stands after it.
    """
    before = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.filter("level > 0")
    for k in range(1, LEVELS + 1):
        out = out.withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.struct("section", "title")), ignorenulls=True).over(before))
        out = out.withColumn(f"c{k}", F.max(F.when(F.col("level") < k, F.col("section"))).over(before))
    steps = [F.when((F.col("level") >= k) & (F.col(f"t{k}.section") >= F.coalesce(f"c{k}", F.lit(-1))), F.col(f"t{k}.title")) for k in range(1, LEVELS + 1)]
    return out.withColumn("path", F.array_join(F.array_compact(F.array(*steps)), " > ")).drop(*[f"{x}{k}" for x in "tc" for k in range(1, LEVELS + 1)])


def deepest(paths: DataFrame) -> DataFrame:
    """The first section of greatest depth of each document, and how many sections it has."""
    return paths.groupBy("doc").agg(F.max_by(F.struct("path", "level"), F.struct("level", -F.col("section"))).alias("d"), F.count(F.lit(1)).alias("n_sections")).select("doc", "d.path", "d.level", "n_sections")


def carried_forward(pages: DataFrame, column: str, doc: str, order: str) -> Column:
    """The last known value of a column in reading order."""
    return F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def chunks(docs: DataFrame, id_col: str, size: int = 128, overlap: int = 16, parents: tuple[int, ...] = (512,), text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, begin, n_tokens, text, parent): windows of `size` tokens, `overlap` shared; parent is the number of the larger window around its begin."""
    step = size - overlap
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int") - 1, F.lit(0)))
    rows = rows.select("doc_id", "w", F.explode(at).alias("chunk")).withColumn("begin", F.col("chunk") * step)
    piece = F.slice("w", F.col("begin") + 1, F.lit(size))
    return rows.select("doc_id", "chunk", "begin", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"), *[F.floor(F.col("begin") / p).cast("int").alias(f"parent_{p}") for p in parents])


def context_prefix(document: Column, path: Column, page: Column, at: Column, of: Column, most: int = 200) -> Column:
    """Document, section, page and position of a chunk; if that is too long, the first three only."""
    place = F.when(at == 1, "beginning").when(at == of, "end").otherwise(F.concat(F.lit("part "), at.cast("string"), F.lit(" of "), of.cast("string")))
    parts = F.array_compact(F.array(F.concat(F.lit("Document: "), document), F.concat(F.lit("Section: "), path), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Position: "), place)))
    whole = F.array_join(parts, " | ")
    return F.when(F.length(whole) > most, F.array_join(F.slice(parts, 1, 3), " | ")).otherwise(whole)


def semantic_breaks(docs: DataFrame, id_col: str, percentile: float = 0.95) -> DataFrame:
    """(doc_id, chunk, n_sentences, text): cut where a sentence shares less with the one before than all but the last few pairs of its document do."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), r"(?<=[.!?])\s+")).alias("i", "s"))
    own = Window.partitionBy("doc_id").orderBy("i")
    words = T.tokens(F.col("s"))
    rows = rows.withColumn("w", words).withColumn("distance", F.when(F.col("i") > 0, F.round(1 - T.overlap_ratio(F.lag("w").over(own), F.col("w")), 6)))
    # rounded, so that ties don't hang on how a percentile is interpolated
    limit = F.round(F.percentile("distance", percentile).over(Window.partitionBy("doc_id")), 9)
    rows = rows.withColumn("limit", limit).withColumn("chunk", F.sum(F.coalesce((F.col("distance") > F.col("limit")).cast("int"), F.lit(0))).over(own))
    return rows.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n_sentences"), F.array_join(F.sort_array(F.collect_list(F.struct("i", "s")))["s"], " ").alias("text"))


def markdown_tables(docs: DataFrame, doc: str = "doc_name") -> DataFrame:
    """(doc, table_no, caption, header, rows): runs of pipe lines of two and more; rows hold the cells, cut or filled to the header's width."""
    rows = lines(docs, doc).withColumn("pipe", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    own = Window.partitionBy("doc").orderBy("line_no")
    caption = F.last(F.when(~F.col("pipe") & F.col("line").rlike("^Table [0-9]+"), F.col("line")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("caption", caption).withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("doc", "pipe").orderBy("line_no")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    kept = rows.filter("pipe").withColumn("cells", cells).filter(~F.col("line").rlike(r"^[\s|:\-]+$"))
    runs = kept.groupBy("doc", "island").agg(F.first("caption").alias("caption"), F.min("line_no").alias("begin"), F.sort_array(F.collect_list(F.struct("line_no", "cells"))).alias("all")).filter(F.size("all") >= 2)
    header = F.col("all")[0]["cells"]
    fitted = F.transform(F.slice("all", 2, 1 << 30), lambda r: F.transform(header, lambda _, i: F.coalesce(F.get(r["cells"], i), F.lit(""))))
    return runs.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("begin")).alias("table_no"), "caption", header.alias("header"), fitted.alias("rows"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc, table_no, row_no, column_no, header, cell, data_type, value, unit): typed as number with unit, number, range or text."""
    rows = tables.select("doc", "table_no", "header", F.posexplode("rows").alias("row_no", "cells"))
    cells = rows.select("doc", "table_no", "row_no", F.posexplode(F.arrays_zip("header", "cells")).alias("column_no", "z"))
    cell = F.col("z.cells")
    kind = (
        F.when(cell.rlike(r"^[0-9]+(?:[.,][0-9]+)? ?[A-Za-z%]+[0-9]?$"), "quantity")
        .when(cell.rlike(r"^-?[0-9]+(?:[.,][0-9]+)?$"), "number")
        .when(cell.rlike(r"^[0-9.,]+ ?(?:-|to) ?[0-9.,]+$"), "range")
        .otherwise("text")
    )
    value = F.when(kind.isin("quantity", "number"), T.number(F.regexp_extract(cell, r"^-?[0-9.,]+", 0)))
    unit = F.when(kind == "quantity", F.regexp_extract(cell, r"[A-Za-z%]+[0-9]?$", 0))
    return cells.select("doc", "table_no", "row_no", "column_no", F.col("z.header").alias("header"), cell.alias("cell"), kind.alias("data_type"), value.alias("value"), unit.alias("unit"))


TABLE_TYPES = (("electrical", ("current", "voltage", "rating")), ("dimension", ("length", "width", "size")))


def table_summary(tables: DataFrame) -> DataFrame:
    """(doc, table_no, caption, table_type, n_rows, n_columns, ranges): the type by words of the header, ranges of its numeric columns."""
    low = F.lower(F.array_join("header", " "))
    kind = F.lit("data")
    for name, words in reversed(TABLE_TYPES):
        kind = F.when(low.rlike("|".join(words)), name).otherwise(kind)
    spans = table_cells(tables).filter("value IS NOT NULL").groupBy("doc", "table_no", "column_no", "header").agg(F.min("value").cast("long").alias("low"), F.max("value").cast("long").alias("high"))
    text = F.concat("header", F.lit(": "), F.col("low").cast("string"), F.lit("-"), F.col("high").cast("string"))
    ranges = spans.groupBy("doc", "table_no").agg(F.array_join(F.sort_array(F.collect_list(F.struct("column_no", text.alias("t"))))["t"], "; ").alias("ranges"))
    facts = tables.select("doc", "table_no", "caption", kind.alias("table_type"), F.size("rows").alias("n_rows"), F.size("header").alias("n_columns"))
    return facts.join(ranges, ["doc", "table_no"], "left")


def table_sentences(tables: DataFrame) -> DataFrame:
    """One sentence per row: "row header: column = cell, ..."; and the row as JSON."""
    rows = tables.select("doc", "table_no", "header", F.posexplode("rows").alias("row_no", "cells"))
    pairs = F.zip_with(F.slice("header", 2, 1 << 30), F.slice("cells", 2, 1 << 30), lambda h, c: F.concat(h, F.lit(" = "), c))
    return rows.select("doc", "table_no", "row_no", F.concat(F.col("cells")[0], F.lit(": "), F.array_join(pairs, ", ")).alias("sentence"), F.to_json(F.map_from_arrays("header", "cells")).alias("json"))


def name_metadata(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds standard_no, year and description read off a file name such as EN_50001-2019_cable_rules.pdf."""
    bare = F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", "")
    spaced = F.regexp_replace(bare, "[_ ]+", " ")
    pattern = r"^(EN|IS|IEC|BS|ISO|NFPA|NEK|HD) ?([0-9]+)(?:[-:]([12][0-9]{3}))?"
    family, number, year = (F.regexp_extract(spaced, pattern, g) for g in (1, 2, 3))
    rest = F.trim(F.regexp_replace(spaced, pattern, ""))
    return files.withColumns({"standard_no": F.when(family != "", F.concat_ws(" ", family, number)), "year": F.when(year != "", year), "description": F.when(rest != "", F.initcap(rest))})


def index_pages(pages: DataFrame, doc: str = "doc", order: str = "page_number", first: int = 20, most: int = 5) -> DataFrame:
    """Pages that look like an index: a keyword in their first 500 characters or more than ten numbered lines, among the first pages, at most five a document."""
    numbered = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*[0-9]+(\.[0-9]+)*\s")))
    hit = F.lower(F.substring("text", 1, 500)).rlike("table of contents|contents|index") | (numbered > 10)
    rows = pages.filter((F.col(order) <= first) & hit)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy(order))).filter(F.col("n") <= most).drop("n")


def toc_elements(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, identifier, title, page_number) of lines such as "1.2 Title ..... 7"."""
    row = r"^\s*([0-9]+(?:\.[0-9]+)*|[A-Z])\s+(.*?)[ .]{2,}([0-9]+)\s*$"
    rows = pages.select(F.col(doc).alias("doc"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(row))
    return rows.select("doc", F.regexp_extract("line", row, 1).alias("identifier"), F.regexp_extract("line", row, 2).alias("title"), F.regexp_extract("line", row, 3).cast("int").alias("page_number"))


def catalog(rows: DataFrame) -> DataFrame:
    """One row per file: chunks, pages, sections and the first title by position."""
    return rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("page_number").alias("pages"), F.countDistinct("section_number").alias("sections"), F.min_by("section_title", "pos").alias("first_title"))


def html_headings(pages: DataFrame) -> DataFrame:
    """(page_id, lang, title, n_paragraphs, n_links) of raw pages, by patterns alone."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.trim(F.regexp_replace(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1), "&amp;", "&")).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))).alias("n_paragraphs"), F.size(F.regexp_extract_all(html, F.lit("<a href"), F.lit(0))).alias("n_links"))


def with_facets(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Stored category and project of each file; a parameter wins, then the stored one, then the default."""
    return rows.join(categories, "file_name", "left").withColumns({"category": F.coalesce("category", F.lit("Uncategorized")), "project": F.coalesce("project", F.lit("N/A"))})


def title_fallback(docs: DataFrame, titles: DataFrame, doc: str = "doc_name", shortest: int = 4) -> DataFrame:
    """(doc, identifier, title, line_no): the first title of a table of contents that stands alone on a line, an identifier before it allowed."""
    own = lines(docs, doc).withColumn("key", F.lower(F.trim(F.regexp_replace("line", r"^[#\s]*(?:[0-9]+(?:\.[0-9]+)*)?\s*", ""))))
    known = titles.filter(F.length("title") >= shortest).select("identifier", "title", F.lower(F.trim("title")).alias("key"))
    hit = own.join(known, "key")
    return hit.groupBy("doc").agg(F.min_by(F.struct("identifier", "title", "line_no"), F.struct("line_no", "identifier")).alias("h")).select("doc", "h.*")


def document_summary(name: Column, description: Column, standard_no: Column, categories: Column) -> Column:
    """A line on a document: its description, else its standard number, else its name, the last two with the categories if there are any."""
    held = lambda c: F.coalesce(c, F.lit("")) != ""
    own = F.when(held(standard_no), F.concat(F.lit("Technical standard "), standard_no, F.lit(" ("), name, F.lit(")"), F.when(held(categories), F.concat(F.lit(" covering "), categories)).otherwise("")))
    own = own.otherwise(F.concat(F.lit("Document '"), name, F.lit("'"), F.when(held(categories), F.concat(F.lit(" categorized as "), categories)).otherwise("")))
    return F.when(held(description), F.concat(F.lit("Document '"), name, F.lit("': "), description)).otherwise(own)


def table_context(text: Column) -> Column:
    """What the first table of a text shows: its caption if that reads "Table n", else its first five headers; null without a table."""
    lines = F.split(text, "\n")
    # the first line that opens with a bar and holds another, with the line before it
    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), F.when(i > 0, F.trim(F.get(lines, i - 1))).otherwise(F.lit("")).alias("before")))
    row = F.get(F.filter(numbered, lambda r: r["line"].rlike(r"^\s*\|") & F.contains(F.substr(r["line"], F.lit(2)), F.lit("|"))), F.lit(0))
    caption = F.when(row["before"].rlike(r"(?i)^(?:Table|Tablo)\s+\d+"), F.concat(F.lit("Contains "), row["before"]))
    headers = F.filter(F.transform(F.split(row["line"], r"\|"), lambda h: F.trim(h)), lambda h: h != "")
    named = F.when(F.size(headers) > 0, F.concat(F.lit("Contains table with columns: "), F.array_join(F.slice(headers, 1, 5), ", ")))
    return F.when(text.rlike(r"\|[-:\s]+\|"), F.coalesce(caption, named, F.lit("Contains tabular data")))


def facet_documents(catalog: DataFrame) -> DataFrame:
    """(facet, value, display, document): what the second list shows for a category or project, one document for each display name.

    catalog: (name, display_name, standard_no, categories, project, pos).  In the
    category Standard a document goes by its standard number, otherwise by its
    display name, or by its name; of documents with one display the first counts.
    """
    shown = F.coalesce("display_name", "name")
    by_category = catalog.select(F.lit("category").alias("facet"), F.explode("categories").alias("value"), "name", "pos", "standard_no", shown.alias("shown"))
    by_category = by_category.withColumn("display", F.when((F.col("value") == "Standard") & (F.coalesce("standard_no", F.lit("")) != ""), F.col("standard_no")).otherwise(F.col("shown")))
    by_project = catalog.filter("project IS NOT NULL AND project <> 'N/A'").select(F.lit("project").alias("facet"), F.col("project").alias("value"), "name", "pos", shown.alias("display"))
    both = by_category.select("facet", "value", "display", "name", "pos").unionByName(by_project.select("facet", "value", "display", "name", "pos"))
    return both.groupBy("facet", "value", "display").agg(F.min_by("name", "pos").alias("document"))
