"""The graph of documents, sections and standards as tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def nodes(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """(id, type, name, page): documents, sections with their first title and page, standards; one row per id."""
    docs = chunks.select(F.concat(F.lit("doc:"), "file_name").alias("id"), F.lit("DOCUMENT").alias("type"), F.col("file_name").alias("name")).distinct().withColumn("page", F.lit(None).cast("long"))
    first = chunks.groupBy("file_name", "section_number").agg(F.min_by(F.struct("section_title", "page_number"), "pos").alias("f"))
    sections = first.select(F.concat(F.lit("sec:"), "file_name", F.lit("#"), "section_number").alias("id"), F.lit("SECTION").alias("type"), F.col("f.section_title").alias("name"), F.col("f.page_number").alias("page"))
    standards = references.select(F.concat(F.lit("std:"), "key").alias("id"), F.lit("STANDARD").alias("type"), F.col("key").alias("name")).distinct().withColumn("page", F.lit(None).cast("long"))
    return docs.unionByName(sections).unionByName(standards)


def edges(chunks: DataFrame, references: DataFrame, section_refs: DataFrame) -> DataFrame:
    """(src, dst, type, weight): CONTAINS, REFERS_TO from documents and sections, SECTION_REF and PARENT_OF within a document."""
    doc, sec = (lambda c="file_name": F.concat(F.lit("doc:"), c)), (lambda n="section_number": F.concat(F.lit("sec:"), "file_name", F.lit("#"), n))
    contains = chunks.select(doc().alias("src"), sec().alias("dst"), F.lit("CONTAINS").alias("type"))
    here = references.join(chunks.select("chunk_id", "section_number"), "chunk_id")
    std = F.concat(F.lit("std:"), "key")
    refers = here.select(doc().alias("src"), std.alias("dst"), F.lit("REFERS_TO").alias("type")).unionByName(here.select(sec().alias("src"), std.alias("dst"), F.lit("REFERS_TO").alias("type")))
    known = chunks.select("file_name", F.col("section_number").alias("number")).distinct()
    inner = section_refs.filter("number <> section_number").join(known, ["file_name", "number"], "left_semi").select(sec().alias("src"), sec("number").alias("dst"), F.lit("SECTION_REF").alias("type"))
    return contains.unionByName(refers).unionByName(inner).groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("weight"))


def parents(sections: DataFrame) -> DataFrame:
    """(file_name, number, parent): the longest dotted prefix of a section that is a section too."""
    own = sections.select("file_name", "number").distinct()
    parts = F.split("number", r"\.")
    prefixes = own.filter(F.size(parts) > 1).select("file_name", "number", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("prefix"))
    held = prefixes.join(own.select("file_name", F.col("number").alias("prefix")), ["file_name", "prefix"], "left_semi")
    return held.groupBy("file_name", "number").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))


def neighbours(edges_: DataFrame, start: DataFrame, hops: int = 2, limit: int = 50) -> DataFrame:
    """(start, node, hops): nodes within `hops` undirected steps of each start (id), nearest first, at most `limit`.

    Of a hub only so many neighbours are read as can still enter: a start has
    reached `limit` nodes at most, so the first 2 * limit + 1 neighbours of a
    node in order hold all that it can add.  A start that is full goes no further;
    one that isn't has lost nothing, so the next hop is whole.
    """
    both = edges_.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges_.select("dst", "src")).distinct()
    first = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    both = stored(both.withColumn("n", first).filter(F.col("n") <= 2 * limit + 1).drop("n"))
    reached = stored(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    front = reached
    for hop in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        step = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("node"))).filter(F.col("n") <= limit)
        had = reached.groupBy("start").agg((F.count(F.lit(1)) - 1).alias("had"))
        step = stored(step.join(had, "start").filter(F.col("n") + F.col("had") <= limit).select("start", "node", F.lit(hop).alias("hops")))
        reached = reached.unionByName(step)
        full = reached.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("start")
        front = step.join(full, "start", "left_anti")
    return reached.filter("hops > 0")


def walks(edges_: DataFrame, start: DataFrame, hops: int = 3, limit: int = 50) -> DataFrame:
    """(start, node, hops, path): the nodes that `neighbours` finds, each with its shortest way there, an array of (type, node) for each step.

    Edges (src, dst, type) may be walked either way; a shortest way takes none twice.  Of
    several the least by type and node, step for step, is kept.  Which nodes enter is decided
    on the first neighbours of each node alone; the way is then sought between the nodes of the
    last hop and those that enter, at most `limit` of each a start, so no hub is read whole.
    """
    both = edges_.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").union(edges_.select("dst", "src", "type")).filter("a <> b")
    links = stored(both.groupBy("a", "b").agg(F.min("type").alias("type")))
    first = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    near = stored(links.withColumn("n", first).filter(F.col("n") <= 2 * limit + 1).select("a", "b"))
    nothing = F.array().cast("array<struct<type:string,node:string>>")
    reached = stored(start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops"), nothing.alias("path")).distinct())
    front = reached
    for hop in range(1, hops + 1):
        step = front.join(near, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        step = step.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        had = reached.groupBy("start").agg((F.count(F.lit(1)) - 1).alias("had"))
        step = step.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("node"))).join(had, "start")
        enter = stored(step.filter(F.col("n") + F.col("had") <= limit).select("start", "node"))
        ways = front.select("start", F.col("node").alias("a"), "path").join(enter.withColumnRenamed("node", "b"), "start").join(links, ["a", "b"])
        way = F.concat("path", F.array(F.struct("type", F.col("b").alias("node"))))
        step = stored(ways.groupBy("start", F.col("b").alias("node")).agg(F.lit(hop).alias("hops"), F.min(way).alias("path")))
        reached = reached.unionByName(step)
        full = reached.groupBy("start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("start")
        front = step.join(full, "start", "left_anti")
    return reached.filter("hops > 0")


def document_references(edges_: DataFrame) -> DataFrame:
    """(document, standards, sections): sorted lists of what each document refers to and contains."""
    of = edges_.filter(F.col("src").startswith("doc:"))
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("dst"))))
    return of.groupBy(F.col("src").alias("document")).agg(names("REFERS_TO").alias("standards"), names("CONTAINS").alias("sections"))


def co_referenced(edges_: DataFrame, limit: int = 10) -> DataFrame:
    """(standard, other, documents): standards that the same documents refer to, most shared first."""
    refs = edges_.filter("type = 'REFERS_TO' AND src LIKE 'doc:%'").select("src", "dst")
    shared = refs.select("src", F.col("dst").alias("standard")).join(refs.select("src", F.col("dst").alias("other")), "src").filter("standard <> other").groupBy("standard", "other").agg(F.count(F.lit(1)).alias("documents"))
    order = Window.partitionBy("standard").orderBy(F.desc("documents"), "other")
    return shared.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def referring_documents(edges_: DataFrame, limit: int = 10) -> DataFrame:
    """(standard, document, n_sections, rank): documents that refer to a standard and how many sections of them do."""
    docs = edges_.filter("type = 'REFERS_TO' AND src LIKE 'doc:%'").select(F.col("dst").alias("standard"), F.substr("src", F.lit(5)).alias("document"))
    secs = edges_.filter("type = 'REFERS_TO' AND src LIKE 'sec:%'").select(F.col("dst").alias("standard"), F.regexp_extract("src", "^sec:([^#]*)#", 1).alias("document")).groupBy("standard", "document").agg(F.count(F.lit(1)).alias("n_sections"))
    rows = docs.join(secs, ["standard", "document"], "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
    order = Window.partitionBy("standard").orderBy(F.desc("n_sections"), "document")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def strengthen(learned: DataFrame, new: DataFrame, step: float = 0.1) -> DataFrame:
    """Learned edges (src, dst, type, weight) after new confidences: new edges start at theirs, old ones gain a tenth of it, to 1 at most."""
    n = new.select("src", "dst", "type", "confidence")
    out = learned.join(n, ["src", "dst", "type"], "full")
    weight = F.when(F.col("weight").isNull(), F.col("confidence")).when(F.col("confidence").isNull(), F.col("weight")).otherwise(F.least(F.lit(1.0), F.col("weight") + step * F.col("confidence")))
    return out.select("src", "dst", "type", F.round(weight, 6).alias("weight"))


def pruned(learned: DataFrame, least: float) -> DataFrame:
    return learned.filter(F.col("weight") >= least)


def display(nodes_: DataFrame, edges_: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first nodes by type and id, and the edges between them: what a picture can hold."""
    order = F.when(F.col("type") == "DOCUMENT", 0).when(F.col("type") == "STANDARD", 1).otherwise(2)
    shown = nodes_.orderBy(order, "id").limit(limit)
    ids = shown.select("id")
    return shown, edges_.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def incoming_and_outgoing(edges_: DataFrame, limit: int = 20) -> DataFrame:
    """(node, direction, type, other, rank): the heaviest references of each node, at most `limit` each way and type."""
    out = edges_.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"), "weight")
    back = edges_.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "type", F.col("src").alias("other"), "weight")
    order = Window.partitionBy("node", "direction", "type").orderBy(F.desc("weight"), "other")
    return out.unionByName(back).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def reference_summary(edges_: DataFrame, first: int = 15) -> DataFrame:
    """(document, n_standards, summary): a sentence that names the first standards a document refers to."""
    order = Window.partitionBy("src").orderBy("dst")
    rows = edges_.filter("type = 'REFERS_TO' AND src LIKE 'doc:%'").withColumn("n", F.row_number().over(order))
    named = F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") <= first, F.substr("dst", F.lit(5))))), ", ")
    out = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_standards"), named.alias("names"))
    return out.select(F.substr("src", F.lit(5)).alias("document"), "n_standards", F.concat(F.lit("Refers to "), F.col("n_standards").cast("string"), F.lit(" standards: "), "names").alias("summary"))


def query_star(results: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, src, dst, label): from each question to its first `limit` sources, labelled with document and section."""
    label = F.concat("file_name", F.lit("\n"), F.substr("section_title", F.lit(1), F.lit(30)))
    return results.filter(F.col("rank") <= limit).select("query_id", F.lit("query").alias("src"), F.concat(F.lit("source_"), (F.col("rank") - 1).cast("string")).alias("dst"), label.alias("label"))


def expanded_results(results: DataFrame, asked: DataFrame, found: DataFrame, edges_: DataFrame, entities: int = 10, first: int = 7, further: int = 5) -> DataFrame:
    """(query_id, source_type, pos, id): the context of each question from its results and from the graph.

    Entities of the question and of its results, (query_id, key) each, are
    united; the first `entities` in order are looked up; sections that refer to
    most of them come first.  `first` results and `further` sections make the context.
    """
    both = asked.select("query_id", "key").union(found.select("query_id", "key")).distinct()
    own = Window.partitionBy("query_id").orderBy("key")
    chosen = both.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= entities).select("query_id", F.concat(F.lit("std:"), "key").alias("dst"))
    refers = edges_.filter("type = 'REFERS_TO' AND src LIKE 'sec:%'").select("src", "dst")
    reached = chosen.join(refers, "dst").groupBy("query_id", "src").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "src")
    sections = reached.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= further).select("query_id", F.lit("graph").alias("source_type"), "pos", F.col("src").alias("id"))
    return results.filter(F.col("rank") <= first).select("query_id", F.lit("vector").alias("source_type"), F.col("rank").alias("pos"), "id").unionByName(sections)


def with_references(results: DataFrame, edges_: DataFrame, first: int = 5) -> DataFrame:
    """(query_id, id, rank, references): each result with the first standards that its section refers to; none gives an empty list."""
    order = Window.partitionBy("src").orderBy("dst")
    refers = edges_.filter("type = 'REFERS_TO' AND src LIKE 'sec:%'").select("src", "dst", F.row_number().over(order).alias("n")).filter(F.col("n") <= first)
    lists = refers.groupBy("src").agg(F.array_sort(F.collect_list(F.substr("dst", F.lit(5)))).alias("references"))
    rows = results.select("query_id", "id", "rank", F.concat(F.lit("sec:"), "file_name", F.lit("#"), "section_number").alias("src"))
    return rows.join(lists, "src", "left").select("query_id", "id", "rank", F.coalesce("references", F.array().cast("array<string>")).alias("references"))
