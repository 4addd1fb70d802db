"""Comparison of documents by their values and requirements.

Documents meet in pairs (source_doc, reference_doc).  Chunks hold chunk_id,
file_name, pos (order in the document) and text.  The rows of a pair's reference document
are moved to where its source document lies, and chunks meet there, as it takes less to compare
a few chunks with a few others than to send a row for each of their words.  Where a document is
large, chunks of its pairs meet on two technical words at once, or on a word of a topic,
in many tasks, so no chunk is paired with all of a large document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.store import stored

#: Rows of a document beyond which it is large.
LARGE = 1000


def _divided(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pairs of two small documents, and those with a large one; None if no document is large."""
    large = stored(rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("file_name"))
    if large.isEmpty():
        return pairs, None
    for name in ("source", "reference"):
        pairs = pairs.join(large.select(F.col("file_name").alias(f"{name}_doc"), F.lit(True).alias(f"{name}_large")), f"{name}_doc", "left")
    is_large = F.coalesce("source_large", "reference_large", F.lit(False))
    return tuple(pairs.filter(c).select("source_doc", "reference_doc") for c in (~is_large, is_large))


def _side(rows: DataFrame, name: str, **columns: str) -> DataFrame:
    return rows.select(F.col("file_name").alias(f"{name}_doc"), *[F.col(c).alias(new) for new, c in columns.items()])


def _beside(theirs: DataFrame, mine: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both documents of each pair; those of the reference are moved, those of the source stay if they are dealt by document."""
    moved = pairs.join(theirs, "reference_doc").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_doc")
    return moved.join(mine, "source_doc")


def chunk_values(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, i, type, value, original, start, subject) of every value; i counts a chunk's values from 0.  A text that occurs again is read once."""
    # arrays are taken apart by outer generators throughout: Spark would read the texts twice to drop empty arrays before
    texts = chunks.select("text").distinct().withColumn("v", V.typed("text"))
    rows = chunks.select("chunk_id", "file_name", "text").join(texts, "text").select("chunk_id", "file_name", F.posexplode_outer("v").alias("i", "v"))
    return rows.filter("i IS NOT NULL").select("chunk_id", "file_name", "i", "v.*")


def _similar(chunks: DataFrame, pairs: DataFrame, technical: int = 2, common: int = 5, k: int = 2) -> DataFrame:
    """The rows of similar_chunks with both texts."""
    rows = chunks.select("chunk_id", "file_name", "pos", "text", V.context_bits(F.col("text")).alias("context"))
    mine, theirs = (_side(rows, name, **{f"{name}_chunk": "chunk_id", f"{name}_pos": "pos", f"{name}_text": "text", f"{name}_context": "context"}) for name in ("source", "reference"))
    order = Window.partitionBy("source_doc", "reference_chunk").orderBy(F.desc("technical"), F.desc("common"), "source_pos", "source_chunk")

    def best(met: DataFrame) -> DataFrame:
        both = F.bit_count(F.col("reference_context").bitwiseAND(F.col("source_context")))
        # words are only counted where enough of the technical ones agree
        words = F.when(both >= technical, F.size(F.array_intersect(V.spaced_words(F.col("reference_text")), V.spaced_words(F.col("source_text"))))).otherwise(-1)
        met = met.withColumns({"technical": both, "common": words}).filter((F.col("technical") >= technical) & (F.col("common") >= common))
        out = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return out.select("source_doc", "reference_doc", "reference_chunk", "reference_pos", "source_chunk", "rank", "reference_text", "source_text")

    small, large = _divided(chunks, pairs)
    out = best(_beside(theirs, mine, small))
    if large is None:
        return out
    # two context words in common: so the chunks share a pair of them
    context = V.context_words(F.col("text"))
    couples = F.flatten(F.transform("words", lambda a: F.transform(F.filter("words", lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))
    keyed = chunks.select("chunk_id", "file_name", context.alias("words")).select("chunk_id", "file_name", F.explode(couples).alias("couple"))
    met = large.join(_side(keyed, "reference", reference_chunk="chunk_id", couple="couple"), "reference_doc").join(_side(keyed, "source", source_chunk="chunk_id", couple="couple"), ["source_doc", "couple"])
    met = met.select("source_doc", "reference_doc", "reference_chunk", "source_chunk").distinct()
    return out.unionByName(best(met.join(theirs.drop("reference_doc"), "reference_chunk").join(mine.drop("source_doc"), "source_chunk")))


def similar_chunks(chunks: DataFrame, pairs: DataFrame, technical: int = 2, common: int = 5, k: int = 2) -> DataFrame:
    """(source_doc, reference_doc, reference_chunk, reference_pos, source_chunk, rank): the k source chunks most alike each reference chunk.

    Alike are chunks with `technical` (two or more) context words and `common` words in common;
    more context words come first, then more words, then the earlier chunk.
    """
    return _similar(chunks, pairs, technical, common, k).drop("reference_text", "source_text")


def value_comparisons(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differing values of one type and related subjects in similar chunks: HIGHER or LOWER, difference, percentage of the reference's value, severity.

    One row for each (source_doc, type, both values, source's subject), the first.
    Only the texts of similar chunks are read for values.
    """
    rows = _similar(chunks, pairs).withColumns({"theirs": V.typed("reference_text"), "mine": V.typed("source_text")}).drop("reference_text", "source_text")
    rows = rows.select("*", F.posexplode_outer("theirs").alias("reference_i", "r")).drop("theirs").filter(F.exists("mine", lambda v: v["type"] == F.col("r.type")))
    rows = rows.select("*", F.posexplode_outer("mine").alias("source_i", "s")).drop("mine").filter("r.type = s.type AND s.value <> r.value")
    value = lambda name, v: [F.col(f"{v}.value").alias(f"{name}_value"), F.col(f"{v}.subject").alias(f"{name}_subject"), f"{name}_i"]
    rows = rows.select("source_doc", "reference_doc", "reference_chunk", "reference_pos", "source_chunk", "rank", F.col("r.type").alias("type"), *value("reference", "r"), *value("source", "s"))
    rows = rows.filter(V.subjects_related(F.col("source_subject"), F.col("reference_subject")))
    first = Window.partitionBy("source_doc", "type", "source_value", "reference_value", "source_subject").orderBy("reference_doc", "reference_pos", "reference_chunk", "rank", "reference_i", "source_i")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    difference = F.round(F.col("source_value") - F.col("reference_value"), 6)
    percent = F.when(F.col("reference_value") != 0, F.round((F.col("source_value") - F.col("reference_value")) / F.col("reference_value") * 100, 6)).otherwise(0.0)
    described = F.when(F.col("source_subject") != F.col("type"), F.col("source_subject")).otherwise(F.col("reference_subject"))
    return rows.select("source_doc", "reference_doc", "source_chunk", "reference_chunk", "type", described.alias("subject"), "source_value", "reference_value", F.when(difference > 0, "HIGHER").otherwise("LOWER").alias("status"), difference.alias("difference"), percent.alias("percentage"), T.severity(F.abs(percent)).alias("severity"))


def mandatory_requirements(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, pos, sentence_pos, sentence, topic): sentences with a word of obligation."""
    rows = chunks.select("chunk_id", "file_name", "pos", F.posexplode(F.split("text", r"[.;]\s+")).alias("sentence_pos", "sentence"))
    return rows.filter(F.col("sentence").rlike(V.MANDATORY)).withColumn("topic", V.topic(F.col("sentence")))


def _best(requirements: DataFrame, chunks: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """The rows of best_chunks with the requirement's sentence and the source chunk's text."""
    mine = _side(chunks, "source", source_chunk="chunk_id", source_pos="pos", source_text="text")
    theirs = requirements.select(F.col("file_name").alias("reference_doc"), "chunk_id", "sentence_pos", "sentence", "topic")
    keys = ["source_doc", "reference_doc", "chunk_id", "sentence_pos"]

    def best(met: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect(V.spaced_words(F.col("topic")), V.spaced_words(F.col("source_text"))))
        met = met.withColumn("n", shared).filter(F.col("n") >= least)
        return met.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "source_pos", "source_chunk"))).filter("rank = 1").select(*keys, "source_chunk", "sentence", "source_text")

    small, large = _divided(chunks, pairs)
    out = best(_beside(theirs, mine, small))
    if large is None:
        return out
    words = chunks.select(F.col("file_name").alias("source_doc"), F.col("chunk_id").alias("source_chunk"), F.explode(V.spaced_words(F.col("text"))).alias("word"))
    wanted = requirements.select(F.col("file_name").alias("reference_doc"), "chunk_id", "sentence_pos", F.explode(V.spaced_words(F.col("topic"))).alias("word"))
    met = wanted.join(large, "reference_doc").join(words, ["source_doc", "word"]).groupBy(*keys, "source_chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    return out.unionByName(best(met.join(theirs.drop("reference_doc"), ["chunk_id", "sentence_pos"]).join(mine.drop("source_doc"), "source_chunk")))


def best_chunks(requirements: DataFrame, chunks: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """(source_doc, reference_doc, chunk_id, sentence_pos, source_chunk): the source chunk that shares most words with each topic, `least` at least; the earliest of equals."""
    return _best(requirements, chunks, pairs, least).drop("sentence", "source_text")


def requirement_conflicts(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first value of each mandatory sentence that differs from the first value of its type in the best source chunk.

    A required value of zero has no percentage and counts as critical.
    """
    rows = _best(mandatory_requirements(chunks), chunks, pairs).withColumn("required", V.typed("sentence"))
    rows = rows.withColumn("found", F.when(F.size("required") > 0, V.typed("source_text"))).drop("sentence", "source_text")
    # values stand by type, then place: the first of a type is the first in the array
    both = F.transform("required", lambda r: F.struct(r.alias("r"), F.get(F.filter("found", lambda s: s["type"] == r["type"]), F.lit(0)).alias("s")))
    first = F.slice(F.filter(both, lambda v: v["s"]["value"] != v["r"]["value"]), 1, 1)
    rows = rows.select("*", F.explode_outer(first).alias("v")).drop("required", "found").filter("v IS NOT NULL")
    keys = ["source_doc", "reference_doc", "chunk_id", "sentence_pos", "source_chunk"]
    out = rows.select(*keys, F.col("v.r.type").alias("type"), F.col("v.s").alias("s"), F.col("v.r.value").alias("required_value"), F.col("v.r.subject").alias("required_subject"))
    percent = F.when(F.col("required_value") != 0, F.round(F.abs(F.col("s.value") - F.col("required_value")) / F.col("required_value") * 100, 6))
    subject = F.when(F.col("s.subject") != F.col("type"), F.col("s.subject")).otherwise(F.col("required_subject"))
    return out.select(*keys, "type", subject.alias("subject"), F.col("s.value").alias("source_value"), "required_value", F.when(percent.isNull(), "critical").otherwise(T.severity(percent)).alias("severity"), F.concat(F.lit("Review and align "), subject, F.lit(" value with "), "reference_doc", F.lit(" requirements")).alias("recommendation"))


def strength_conflicts(requirements: DataFrame, pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """Mandatory sentences of one document against prohibited ones of the other, either way, whose words overlap by more than `least` of the larger set.

    requirements: (id, file_name, sentence, strength).  In large documents sentences meet on
    words: two sets that overlap so share one of the first n - ceil(least * n) + 1 words of either
    in one order, rare words first, so only those words meet; the overlap is then
    counted on whole sets.
    """
    rows = requirements.filter("strength IN ('mandatory', 'prohibited')").select("id", "file_name", "sentence", "strength")
    mine, theirs = (_side(rows, name, **{f"{c}{i}": c for c in ("id", "sentence", "strength")}) for i, name in ((1, "source"), (2, "reference")))

    def conflicts(met: DataFrame) -> DataFrame:
        x, y = (V.spaced_words(F.col(f"sentence{i}")) for i in (1, 2))
        # words are only counted where the strengths differ
        overlap = F.when(F.col("strength1") != F.col("strength2"), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(-1.0)
        met = met.withColumn("overlap", overlap).filter(F.col("overlap") > least)
        return met.select("source_doc", "reference_doc", "id1", "strength1", "sentence1", "id2", "strength2", "sentence2", F.round("overlap", 6).alias("overlap"), F.lit("high").alias("severity"))

    small, large = _divided(requirements, pairs)
    out = conflicts(_beside(theirs, mine, small))
    if large is None:
        return out
    held = large.select(F.explode(F.array("source_doc", "reference_doc")).alias("file_name")).distinct()
    rows = stored(rows.join(held, "file_name", "left_semi"))
    each = rows.select("id", F.explode(V.spaced_words(F.col("sentence"))).alias("word")).distinct()
    ordered = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("k")), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("kw"))
    n = F.size("kw")
    first = ordered.select("id", F.explode(F.slice("kw", F.lit(1), n - F.ceil(n * least).cast("int") + 1)).alias("kw")).select("id", F.col("kw.word").alias("word"))
    keyed = rows.select("id", "file_name", "strength").distinct().join(first, "id")
    a, b = (_side(keyed, name, **{f"id{i}": "id", f"strength{i}": "strength"}, word="word") for i, name in ((1, "source"), (2, "reference")))
    met = a.join(large.join(b, "reference_doc"), ["source_doc", "word"]).filter("strength1 <> strength2").select("source_doc", "reference_doc", "id1", "id2").distinct()
    return out.unionByName(conflicts(met.join(mine, ["source_doc", "id1"]).join(theirs, ["reference_doc", "id2"])))


# Groups of words that make two chunks speak of one topic.
CONFLICT_WORDS = (("maximum", "max"), ("minimum", "min"), ("shall", "must"), ("impedance", "resistance"), ("voltage", "current"), ("temperature", "°C"), ("mm²", "mm2", "cross-sectional area"), ("rating", "capacity"), ("complies", "compliance"))


def conflict_analysis(chunks: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(source_doc, reference_doc, base_chunk, compared_chunk, topic, severity): each source chunk against the k chunks of the reference most like it.

    They conflict if both hold a word of one group and numbers, and their numbers
    differ; high where either obliges.
    """
    turned = pairs.select(F.col("source_doc").alias("reference_doc"), F.col("reference_doc").alias("source_doc"))
    met = _similar(chunks, turned, k=k).select(F.col("reference_doc").alias("source_doc"), F.col("source_doc").alias("reference_doc"), F.col("reference_chunk").alias("base_chunk"), F.col("source_chunk").alias("compared_chunk"), F.col("reference_text").alias("text1"), F.col("source_text").alias("text2"))

    def read(i: int) -> dict:
        text = F.col(f"text{i}")
        low = F.lower(text)
        topics = F.array_compact(F.array(*[F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in group]), F.lit(group[0])) for group in CONFLICT_WORDS]))
        numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+\.?\d*"), F.lit(0))))
        return {f"topics{i}": topics, f"numbers{i}": numbers, f"hard{i}": low.rlike("shall|must|required|mandatory")}

    out = met.withColumns(read(1) | read(2))
    shared = F.array_intersect("topics1", "topics2")
    out = out.filter((F.size(shared) > 0) & (F.size("numbers1") > 0) & (F.size("numbers2") > 0) & (F.col("numbers1") != F.col("numbers2")))
    return out.select("source_doc", "reference_doc", "base_chunk", "compared_chunk", F.initcap(F.array_join(shared, ", ")).alias("topic"), F.when(F.col("hard1") | F.col("hard2"), "high").otherwise("medium").alias("severity"))
