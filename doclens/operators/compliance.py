"""Audits of one document against others, and checks of answers against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as T


def compared_values(values: DataFrame, pairs: DataFrame, key: tuple[str, ...] = ("type", "subject", "section_number")) -> DataFrame:
    """For each (source_doc, reference_doc) and key the first value of either side where they differ: HIGHER or LOWER, difference, percentage, severity.

    A source value of zero has no percentage and counts as critical.
    """
    first = values.groupBy("file_name", *key).agg(F.min_by(F.struct("value", "chunk_id"), F.struct("pos", "chunk_id")).alias("v"))
    s = first.select(F.col("file_name").alias("source_doc"), *key, F.col("v.value").alias("source_value"), F.col("v.chunk_id").alias("source_chunk"))
    r = first.select(F.col("file_name").alias("reference_doc"), *key, F.col("v.value").alias("reference_value"), F.col("v.chunk_id").alias("reference_chunk"))
    rows = pairs.join(s, "source_doc").join(r, ["reference_doc", *key]).filter("source_value <> reference_value")
    difference = F.round(F.abs(F.col("source_value") - F.col("reference_value")), 6)
    percent = F.when(F.col("source_value") != 0, F.round(difference / F.abs("source_value") * 100, 6))
    return rows.select("source_doc", "reference_doc", *key, "source_chunk", "reference_chunk", "source_value", "reference_value", F.when(F.col("source_value") > F.col("reference_value"), "HIGHER").otherwise("LOWER").alias("relation"), difference.alias("difference"), percent.alias("percentage"), F.when(percent.isNull(), "critical").otherwise(T.severity(percent)).alias("severity"))


def issues(values: DataFrame, requirements: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first requirement of each reference and type whose value differs from the source's first value of that type."""
    first = values.groupBy("file_name", "type").agg(F.min_by("value", F.struct("pos", "chunk_id")).alias("source_value"))
    s = first.withColumnRenamed("file_name", "source_doc")
    wanted = values.join(requirements.filter("strength = 'mandatory'").select("chunk_id", "sentence"), "chunk_id").withColumnRenamed("file_name", "reference_doc")
    rows = pairs.join(s, "source_doc").join(wanted, ["reference_doc", "type"]).filter(F.col("source_value") != F.col("value"))
    out = rows.groupBy("source_doc", "reference_doc", "type").agg(F.min_by(F.struct("source_value", "value", "unit", "sentence", "chunk_id"), F.struct("pos", "chunk_id")).alias("i"))
    percent = F.round(F.abs(F.col("i.source_value") - F.col("i.value")) / F.abs("i.source_value") * 100, 6)
    level = F.when(F.col("i.source_value") == 0, "critical").otherwise(T.severity(percent))
    advice = F.concat(F.lit("Set "), "type", F.lit(" to "), F.col("i.value").cast("long").cast("string"), F.lit(" "), F.col("i.unit"))
    return out.select("source_doc", "reference_doc", "type", F.col("i.chunk_id").alias("chunk_id"), F.col("i.source_value").alias("source_value"), F.col("i.value").alias("required_value"), level.alias("severity"), F.col("i.sentence").alias("requirement"), advice.alias("recommendation"))


def gaps(chunks: DataFrame, terms: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """Mandatory chunks of a reference of whose terms the source knows fewer than `least`; the first of each topic.

    terms: (chunk_id, file_name, term).  A chunk without terms has none the source could know.
    """
    strength = patterns.strength(F.col("text"))
    wanted = chunks.withColumn("strength", strength).filter("strength = 'mandatory'").select("chunk_id", F.col("file_name").alias("reference_doc"), F.col("section_title").alias("topic"), "pos", "text")
    vocabulary = terms.select(F.col("file_name").alias("source_doc"), "term").distinct()
    mine = terms.withColumnRenamed("file_name", "reference_doc").join(pairs, "reference_doc").join(vocabulary, ["source_doc", "term"])
    known = mine.groupBy("source_doc", "chunk_id").agg(F.countDistinct("term").alias("known"))
    rows = wanted.join(pairs, "reference_doc").join(known, ["source_doc", "chunk_id"], "left").filter(F.coalesce("known", F.lit(0)) < least)
    first = rows.groupBy("source_doc", "reference_doc", "topic").agg(F.min_by(F.struct("chunk_id", "text"), F.struct("pos", "chunk_id")).alias("g"))
    return first.select("source_doc", "reference_doc", "topic", F.col("g.chunk_id").alias("chunk_id"), F.when(F.lower("g.text").rlike(r"\bshall\b"), "high").otherwise("medium").alias("severity"))


def coverage(references: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_doc, reference_doc, key): standards that a reference names and the source doesn't."""
    named = references.select("file_name", "key").distinct()
    return pairs.join(named.withColumnRenamed("file_name", "reference_doc"), "reference_doc").join(named.withColumnRenamed("file_name", "source_doc"), ["source_doc", "key"], "left_anti").select("source_doc", "reference_doc", "key")


def summary(findings: DataFrame) -> DataFrame:
    """(source_doc, critical, high, medium, low, score, verdict) of rows with source_doc and severity: 100 - 20 c - 10 h - 5 m - l, within 0 and 100."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    counts = findings.groupBy("source_doc").agg(*[n(s) for s in ("critical", "high", "medium", "low")])
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 20 * F.col("critical") - 10 * F.col("high") - 5 * F.col("medium") - F.col("low")))
    return counts.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 80, "compliant").when(F.col("score") >= 50, "partly").otherwise("not compliant"))


def number_conflicts(chunks: DataFrame, keywords: tuple[str, ...], pairs: DataFrame) -> DataFrame:
    """First chunk of each file and keyword against the other's: conflict if their numbers differ, high if either is mandatory."""
    rows = chunks.select("chunk_id", "file_name", "pos", "text", F.explode(F.array(*[F.when(F.contains(F.lower("text"), F.lit(k)), F.lit(k)) for k in keywords])).alias("keyword")).filter("keyword IS NOT NULL")
    first = rows.groupBy("file_name", "keyword").agg(F.min_by(F.struct("chunk_id", "text"), F.struct("pos", "chunk_id")).alias("c"))
    a = first.select(F.col("file_name").alias("source_doc"), "keyword", F.col("c").alias("c1"))
    b = first.select(F.col("file_name").alias("reference_doc"), "keyword", F.col("c").alias("c2"))
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))))
    rows = pairs.join(a, "source_doc").join(b, ["reference_doc", "keyword"]).filter(numbers(F.col("c1.text")) != numbers(F.col("c2.text")))
    hard = (patterns.strength(F.col("c1.text")) == "mandatory") | (patterns.strength(F.col("c2.text")) == "mandatory")
    return rows.select("source_doc", "reference_doc", "keyword", F.col("c1.chunk_id").alias("chunk1"), F.col("c2.chunk_id").alias("chunk2"), F.when(F.coalesce(hard, F.lit(False)), "high").otherwise("medium").alias("severity"))


def support(answers: DataFrame, n: int = 3) -> DataFrame:
    """Adds support: the share of an answer's distinct n-grams that its source holds, 1 for an answer without any; answers hold id, answer, source."""
    rows = answers.select("id", T.tokens(F.col("answer")).alias("a"), T.tokens(F.col("source")).alias("s"))
    rows = rows.select("id", F.array_distinct(T.ngrams(F.col("a"), n)).alias("a"), T.ngrams(F.col("s"), n).alias("s"))
    return rows.select("id", F.when(F.size("a") > 0, F.round(F.size(F.array_intersect("a", "s")) / F.size("a"), 6)).otherwise(1.0).alias("support"))


def citation_coverage(bullets: DataFrame) -> DataFrame:
    return bullets.groupBy("id").agg(F.count(F.lit(1)).alias("bullets"), F.count("source").alias("cited")).withColumn("coverage", F.round(F.col("cited") / F.col("bullets"), 6))


def confidence(scores: DataFrame, least: float, k: int = 5) -> DataFrame:
    """(id, confidence, confident): mean of the k best scores of each answer's sources."""
    own = Window.partitionBy("id").orderBy(F.desc("score"), "source")
    top = scores.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k)
    return top.groupBy("id").agg(F.round(F.avg("score"), 6).alias("confidence")).withColumn("confident", F.col("confidence") >= least)


def topic_extract(chunks: DataFrame, words: tuple[str, ...], most: int = 50) -> DataFrame:
    """(file_name, n_sections, n_pages, n_matches): what a document says on a topic, from its first `most` matching chunks."""
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w) | F.contains(F.lower("section_title"), w))
    order = Window.partitionBy("file_name").orderBy("pos", "chunk_id")
    rows = chunks.filter(hit).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return rows.groupBy("file_name").agg(F.countDistinct("section_number").alias("n_sections"), F.countDistinct("page_number").alias("n_pages"), F.count(F.lit(1)).alias("n_matches"))


def technical_queries(findings: DataFrame) -> DataFrame:
    """Findings numbered TQ-001, ... in each source document, worst first."""
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    own = Window.partitionBy("source_doc").orderBy(order, "reference_doc", "chunk_id")
    return findings.withColumn("number", F.format_string("TQ-%03d", F.row_number().over(own)))


def audit(chunks: DataFrame, values: DataFrame, requirements: DataFrame, references: DataFrame, pairs: DataFrame) -> DataFrame:
    """All findings (source_doc, reference_doc, category, what, severity) of each pair: value conflicts, requirement gaps, standards that aren't covered."""
    terms = references.select("chunk_id", "file_name", F.col("key").alias("term"))
    a = issues(values, requirements, pairs).select("source_doc", "reference_doc", F.lit("value").alias("category"), F.col("type").alias("what"), "severity")
    b = gaps(chunks, terms, pairs, 1).select("source_doc", "reference_doc", F.lit("gap").alias("category"), F.col("topic").alias("what"), "severity")
    c = coverage(references, pairs).select("source_doc", "reference_doc", F.lit("coverage").alias("category"), F.col("key").alias("what"), F.lit("medium").alias("severity"))
    return a.unionByName(b).unionByName(c)


def verdicts(supported: DataFrame, cited: DataFrame, sure: DataFrame) -> DataFrame:
    """(id, quality, warnings): .4 support, .3 citation coverage and .3 confidence of an answer, a missing check counting 1, with a warning for each part under one half."""
    rows = supported.select("id", "support").join(cited.select("id", "coverage"), "id", "full").join(sure.select("id", "confidence"), "id", "full")
    part = lambda c: F.coalesce(c, F.lit(1.0))
    quality = F.round(0.4 * part("support") + 0.3 * part("coverage") + 0.3 * part("confidence"), 6)
    warnings = F.array_compact(F.array(*[F.when(F.col(c) < 0.5, F.lit(f"low {c}")) for c in ("support", "coverage", "confidence")]))
    return rows.select("id", quality.alias("quality"), warnings.alias("warnings"))
