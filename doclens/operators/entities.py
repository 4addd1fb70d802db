"""Entities, values, references and rules found in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as T
from ..functions.values import places


def positioned(text: str, pattern: str) -> Column:
    """(start, match) of each match in a text column, from 0, by cutting the text at its matches."""
    return F.expr(places(text, pattern))


def standards(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, key, reference, start): the first occurrence of each standard in a chunk."""
    rows = chunks.select("chunk_id", "file_name", F.explode(positioned("text", patterns.STANDARD)).alias("m"))
    rows = rows.select("chunk_id", "file_name", patterns.canonical(F.col("m.match")).alias("key"), F.col("m.match").alias("reference"), F.col("m.start").alias("start"))
    return rows.groupBy("chunk_id", "file_name", "key").agg(F.min_by("reference", "start").alias("reference"), F.min("start").alias("start"))


def quantities(chunks: DataFrame, around: int = 30) -> DataFrame:
    """(chunk_id, file_name, value, unit, kind, start, context): each quantity with the characters around it."""
    found = positioned("text", patterns.QUANTITY.replace("(?:[^A-Za-z0-9]|$)", "(?=[^A-Za-z0-9]|$)"))
    rows = chunks.select("chunk_id", "file_name", "text", F.explode(found).alias("m"))
    kinds = F.create_map(*[F.lit(x) for pair in patterns.UNITS.items() for x in pair])
    unit = F.regexp_extract("m.match", "[A-Za-z][A-Za-z0-9]*$", 0)
    begin = F.greatest(F.col("m.start") - around, F.lit(0))
    context = F.substr("text", begin + 1, F.col("m.start") + F.length("m.match") + around - begin)
    return rows.select("chunk_id", "file_name", T.number(F.regexp_extract("m.match", "^[0-9.,]+", 0)).alias("value"), unit.alias("unit"), F.element_at(kinds, unit).alias("kind"), F.col("m.start").alias("start"), context.alias("context"))


def requirements(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, pos, sentence, strength): sentences that hold a requirement word."""
    rows = chunks.select("chunk_id", "file_name", F.posexplode(patterns.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("strength", patterns.strength(F.col("sentence"))).filter("strength IS NOT NULL")


def flat_metadata(chunks: DataFrame, most: int = 10) -> DataFrame:
    """One row per chunk: references, first quantities, strengths, flags and a count."""
    found = patterns.quantities(F.col("text"))
    refs = F.array_distinct(F.transform(patterns.standards(F.col("text")), patterns.canonical))
    strength = patterns.strength(F.col("text"))
    return chunks.select(
        "chunk_id",
        refs.alias("referenced_standards"),
        F.slice(F.transform(found, lambda q: F.concat_ws(" ", q["value"].cast("long").cast("string"), q["unit"])), 1, most).alias("spec_values"),
        strength.alias("requirement_type"),
        (F.size(refs) > 0).alias("has_references"),
        (F.size(found) > 0).alias("has_specifications"),
        F.coalesce(strength == "mandatory", F.lit(False)).alias("has_mandatory_requirements"),
        (F.size(refs) + F.size(found) + F.when(strength.isNotNull(), 1).otherwise(0)).alias("entities_count"),
    )


def section_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, kind, number) of references to sections, clauses, annexes, tables and figures."""
    kinds, numbers = (F.regexp_extract_all("text", F.lit(patterns.SECTION), F.lit(g)) for g in (1, 2))
    rows = chunks.select("chunk_id", "file_name", "section_number", F.explode(F.arrays_zip(kinds.alias("kind"), numbers.alias("number"))).alias("r"))
    return rows.select("chunk_id", "file_name", "section_number", F.lower("r.kind").alias("kind"), F.col("r.number").alias("number"))


def cross_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, phrase, target): phrases such as "in accordance with" and what they name."""
    phrases = F.regexp_extract_all("text", F.lit(patterns.PHRASE), F.lit(0))
    rows = chunks.select("chunk_id", "file_name", F.explode(phrases).alias("whole"))
    target = F.regexp_extract("whole", patterns.PHRASE, 1)
    return rows.select("chunk_id", "file_name", F.trim(F.substr("whole", F.lit(1), F.length("whole") - F.length(target))).alias("phrase"), target.alias("target"))


def first_occurrences(references: DataFrame) -> DataFrame:
    """One row per file and key: the chunk and place where it occurs first, and how often it occurs."""
    return references.groupBy("file_name", "key").agg(F.min_by(F.struct("chunk_id", "start"), F.struct("pos", "start")).alias("first"), F.count(F.lit(1)).alias("n")).select("file_name", "key", F.col("first.chunk_id").alias("chunk_id"), F.col("first.start").alias("start"), "n")


def typed_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): from a file to a standard that one of its chunks names, by the phrase before it."""
    found = cross_references(chunks)
    kind = F.when(F.col("phrase") == "supersedes", "SUPERSEDES").when(F.col("phrase").isin("in accordance with", "according to"), "REQUIRES").otherwise("REFERENCES")
    rows = found.select("file_name", patterns.canonical(F.col("target")).alias("dst"), kind.alias("type")).filter(F.col("dst").rlike("^(" + "|".join(patterns.FAMILIES) + ")[0-9]"))
    return rows.groupBy(F.col("file_name").alias("src"), "dst", "type").agg(F.count(F.lit(1)).alias("weight"))


#: Parameter type, unit, lowest and highest value that is taken for one.
VALUE_TYPES = (("current", "A", 0.0, 10000.0), ("area", "mm2", 0.1, 2000.0), ("illuminance", "lux", 1.0, 100000.0))


def typed_values(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_name, pos, type, value, unit, subject): quantities in the range of their type that aren't part of a standard's number."""
    kept = None
    found = quantities(chunks, 50)
    for kind, unit, low, high in VALUE_TYPES:
        here = (F.col("unit") == unit) & F.col("value").between(low, high)
        kept = here if kept is None else kept | here
    subject = F.coalesce(*[F.nullif(F.regexp_extract(F.lower("context"), f"\\b({w})\\b", 1), F.lit("")) for w in ("cable", "conductor", "luminaire")], F.col("kind"))
    where = chunks.select("chunk_id", "pos")
    return found.filter(kept).join(where, "chunk_id").select("chunk_id", "file_name", "pos", F.col("kind").alias("type"), "value", "unit", subject.alias("subject"))


TOPICS = {"cabling": ("cable", "conductor", "wire"), "lighting": ("luminaire", "lux", "lighting"), "standards": ("standard", "accordance", "supersedes")}


def topics(text: Column) -> Column:
    """Sorted topics whose words occur in the text."""
    words = T.tokens(text)
    hits = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), t) for t, ws in TOPICS.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def mine_rules(chunks: DataFrame, shortest: int = 20, longest: int = 800, plain: int = 300) -> DataFrame:
    """Mandatory sentences, and numeric ones under `plain` characters, with the last section title before them as context.

    The id is a hash of document and sentence, so runs agree.
    """
    rows = chunks.select("file_name", "pos", "section_title", F.posexplode(patterns.sentences(F.col("text"))).alias("i", "rule_text"))
    size = F.length("rule_text")
    strength = patterns.strength(F.col("rule_text"))
    kept = rows.filter(size.between(shortest, longest) & (F.coalesce(strength == "mandatory", F.lit(False)) | (F.col("rule_text").rlike("[0-9]") & (size < plain))))
    numbers = F.regexp_extract_all("rule_text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return kept.select(F.xxhash64("file_name", "rule_text").alias("id"), F.col("file_name").alias("source_doc"), "rule_text", F.col("section_title").alias("context"), numbers.alias("numeric_values"), topics(F.concat_ws(" ", "rule_text", "section_title")).alias("topics"), "pos")


def unstored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rules whose text isn't stored yet, one of each."""
    first = Window.partitionBy("rule_text").orderBy("source_doc", "pos")
    return new.join(stored.select("rule_text").distinct(), "rule_text", "left_anti").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def unmined(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents (file_name) that no stored rule comes from."""
    return documents.select("file_name").distinct().join(rules.select(F.col("source_doc").alias("file_name")).distinct(), "file_name", "left_anti")


def bullets(answers: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, pos, bullet, source): bullet lines of an answer and the "(Source, 1.2)" they cite, as Source#1.2."""
    line = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    rows = answers.select(F.col(id_col).alias("id"), line).filter(F.col("line").rlike(r"^\s*[-*•] "))
    bullet = F.trim(F.regexp_replace("line", r"^\s*[-*•] ", ""))
    cited = F.regexp_extract(bullet, r"\(([A-Za-z0-9 \-]+), ([0-9]+(?:\.[0-9]+)*)\)", 1)
    section = F.regexp_extract(bullet, r"\(([A-Za-z0-9 \-]+), ([0-9]+(?:\.[0-9]+)*)\)", 2)
    return rows.select("id", "pos", bullet.alias("bullet"), F.when(cited != "", F.concat_ws("#", F.replace(cited, F.lit(" "), F.lit("")), section)).alias("source"))


def claims(answers: DataFrame, id_col: str = "id", shortest: int = 20) -> DataFrame:
    """Sentences of an answer, bullets aside, that state a number, a unit or a requirement."""
    rows = answers.select(F.col(id_col).alias("id"), F.posexplode(patterns.sentences(F.col("text"))).alias("pos", "claim"))
    rows = rows.filter(~F.col("claim").rlike(r"^[-*•] "))
    return rows.filter((F.length("claim") >= shortest) & (F.col("claim").rlike("[0-9]") | patterns.strength(F.col("claim")).isNotNull()))
