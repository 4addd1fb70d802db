"""Queries over entities, references, values and rules of the specification corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import entities as E
from ..sources.corpus import SPEC_SQL, spec_chunks
from .registry import query
from .retrieval import CANON_SQL, STANDARD_SQL

STD_SQL = f"st AS (SELECT chunk_id, file_name, pos, {CANON_SQL.format('s')} AS key, s AS reference, instr(text, s)::INTEGER - 1 AS start FROM (SELECT chunk_id, file_name, pos, text, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM spec))"
QTY_SQL = r"qt AS (SELECT *, CASE unit WHEN 'A' THEN 'current' WHEN 'mm2' THEN 'area' ELSE 'illuminance' END AS kind FROM (SELECT chunk_id, file_name, pos, text, regexp_extract(text, '([0-9]+) (A|mm2|lux) ', 1)::DOUBLE AS value, regexp_extract(text, '([0-9]+) (A|mm2|lux) ', 2) AS unit FROM spec WHERE regexp_matches(text, '([0-9]+) (A|mm2|lux) ')))"
STRENGTH_SQL = "CASE WHEN text LIKE '%shall%' OR text LIKE '%must%' THEN 'mandatory' WHEN text LIKE '%should%' THEN 'recommended' END"


@query(f"WITH {SPEC_SQL}, {STD_SQL} SELECT chunk_id, file_name, key, reference, start FROM st")
def standard_references(spark, sf_dir):
    return E.standards(spec_chunks(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, p AS (SELECT *, (instr(text, value::BIGINT || ' ' || unit || ' ') - 1)::INTEGER AS start FROM qt) SELECT chunk_id, file_name, value, unit, kind, start, substr(text, greatest(start - 30, 0) + 1, start + len(value::BIGINT || ' ' || unit) + 30 - greatest(start - 30, 0)) AS context FROM p")
def quantities(spark, sf_dir):
    return E.quantities(spec_chunks(spark, sf_dir))


@query(f"WITH {SPEC_SQL} SELECT chunk_id, file_name, 0::INTEGER AS pos, text[:-2] AS sentence, {STRENGTH_SQL} AS strength FROM spec WHERE {STRENGTH_SQL} IS NOT NULL")
def requirement_sentences(spark, sf_dir):
    return E.requirements(spec_chunks(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {QTY_SQL} SELECT s.chunk_id, coalesce(k.key, '') AS refs, coalesce(q.value::BIGINT || ' ' || q.unit, '') AS spec_values, {STRENGTH_SQL.replace('text', 's.text')} AS requirement_type, k.key IS NOT NULL AS has_references, q.unit IS NOT NULL AS has_specifications, coalesce({STRENGTH_SQL.replace('text', 's.text')} = 'mandatory', false) AS has_mandatory_requirements, ((k.key IS NOT NULL)::INTEGER + (q.unit IS NOT NULL)::INTEGER + ({STRENGTH_SQL.replace('text', 's.text')} IS NOT NULL)::INTEGER)::INTEGER AS entities_count FROM spec s LEFT JOIN st k USING (chunk_id) LEFT JOIN qt q USING (chunk_id)")
def chunk_metadata(spark, sf_dir):
    m = E.flat_metadata(spec_chunks(spark, sf_dir))
    return m.select("chunk_id", F.array_join("referenced_standards", ",").alias("refs"), F.array_join("spec_values", ",").alias("spec_values"), "requirement_type", "has_references", "has_specifications", "has_mandatory_requirements", "entities_count")


@query(f"WITH {SPEC_SQL} SELECT chunk_id, file_name, section_number, 'section' AS kind, section_number AS number FROM spec WHERE text LIKE 'Conductor%'")
def section_references(spark, sf_dir):
    return E.section_references(spec_chunks(spark, sf_dir))


CROSS_SQL = r"cr AS (SELECT chunk_id, file_name, CASE WHEN text LIKE 'The cable%' THEN 'in accordance with' WHEN text LIKE 'Conductor%' THEN 'as specified in' WHEN text LIKE 'The lum%' THEN 'per' ELSE 'supersedes' END AS phrase, regexp_extract(text, '(EN [0-9]+|Section [0-9.]+[0-9]|IS [0-9]+|BS [0-9]+)\.$', 1) AS target FROM spec)"


@query(f"WITH {SPEC_SQL}, {CROSS_SQL} SELECT * FROM cr")
def cross_reference_phrases(spark, sf_dir):
    return E.cross_references(spec_chunks(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, key ORDER BY pos, start) AS rn, count(*) OVER (PARTITION BY file_name, key) AS n FROM st) SELECT file_name, key, chunk_id, start, n FROM r WHERE rn = 1")
def first_references(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    return E.first_occurrences(E.standards(chunks).join(chunks.select("chunk_id", "pos"), "chunk_id"))


@query(f"WITH {SPEC_SQL}, {CROSS_SQL} SELECT file_name AS src, replace(target, ' ', '') AS dst, CASE phrase WHEN 'supersedes' THEN 'SUPERSEDES' WHEN 'in accordance with' THEN 'REQUIRES' ELSE 'REFERENCES' END AS type, count(*) AS weight FROM cr WHERE target NOT LIKE 'Section%' GROUP BY ALL")
def typed_reference_edges(spark, sf_dir):
    return E.typed_edges(spec_chunks(spark, sf_dir))


VALUES_SQL = "tv AS (SELECT chunk_id, file_name, pos, kind AS type, value, unit, CASE unit WHEN 'A' THEN 'cable' WHEN 'mm2' THEN 'conductor' ELSE 'luminaire' END AS subject FROM qt)"


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL} SELECT * FROM tv")
def typed_values(spark, sf_dir):
    return E.typed_values(spec_chunks(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL} SELECT type, unit, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM tv GROUP BY type, unit")
def value_ranges(spark, sf_dir):
    return E.typed_values(spec_chunks(spark, sf_dir)).groupBy("type", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))


RULES_SQL = r"""
    rules AS (SELECT file_name AS source_doc, text[:-2] AS rule_text, section_title AS context, pos,
              list_transform(regexp_extract_all(text[:-2], '[0-9]+(?:\.[0-9]+)?'), lambda x: x) AS numbers,
              CASE WHEN text LIKE 'The cable%' THEN 'cabling,standards' WHEN text LIKE 'Conductor%' THEN 'cabling' WHEN text LIKE 'The lum%' THEN 'lighting' ELSE 'standards' END AS topics FROM spec)"""


@query(f"WITH {SPEC_SQL}, {RULES_SQL} SELECT source_doc, rule_text, context, pos, array_to_string(numbers, ',') AS numbers, topics FROM rules")
def mined_rules(spark, sf_dir):
    r = E.mine_rules(spec_chunks(spark, sf_dir))
    return r.select("source_doc", "rule_text", "context", "pos", F.array_join("numeric_values", ",").alias("numbers"), F.array_join("topics", ",").alias("topics"))


@query(f"WITH {SPEC_SQL}, {RULES_SQL}, old AS (SELECT DISTINCT rule_text FROM rules WHERE source_doc = 'SPEC-1'), n AS (SELECT source_doc, rule_text, pos, row_number() OVER (PARTITION BY rule_text ORDER BY source_doc, pos) AS rn FROM rules WHERE source_doc <> 'SPEC-1' AND rule_text NOT IN (SELECT rule_text FROM old)) SELECT source_doc, rule_text, pos FROM n WHERE rn = 1")
def unstored_rules(spark, sf_dir):
    rules = E.mine_rules(spec_chunks(spark, sf_dir))
    return E.unstored(rules.filter("source_doc <> 'SPEC-1'"), rules.filter("source_doc = 'SPEC-1'")).select("source_doc", "rule_text", "pos")


@query(f"WITH {SPEC_SQL}, {RULES_SQL}, t AS (SELECT source_doc, unnest(string_split(topics, ',')) AS topic, rule_text FROM rules), g AS (SELECT topic, source_doc, count(*) AS n FROM t GROUP BY ALL) SELECT a.topic, a.source_doc AS doc1, b.source_doc AS doc2, a.n AS n1, b.n AS n2 FROM g a JOIN g b USING (topic) WHERE a.source_doc < b.source_doc")
def rules_by_topic(spark, sf_dir):
    per = E.mine_rules(spec_chunks(spark, sf_dir)).select("source_doc", F.explode("topics").alias("topic")).groupBy("topic", "source_doc").agg(F.count(F.lit(1)).alias("n"))
    a, b = (per.select("topic", F.col("source_doc").alias(f"doc{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    return a.join(b, "topic").filter("doc1 < doc2").select("topic", "doc1", "doc2", "n1", "n2")


@query(f"WITH {SPEC_SQL}, {STD_SQL} SELECT file_name, count(DISTINCT key) AS n_standards, (SELECT count(*) FROM spec s WHERE s.file_name = st.file_name AND text LIKE 'Conductor%') AS n_section_references, count(*) AS n_references FROM st GROUP BY file_name")
def reference_counts(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    s = E.standards(chunks).groupBy("file_name").agg(F.countDistinct("key").alias("n_standards"), F.count(F.lit(1)).alias("n_references"))
    return s.join(E.section_references(chunks).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_section_references")), "file_name")


@query(f"WITH {SPEC_SQL}, {QTY_SQL} SELECT file_name, 'std_' || reference_key AS id, 'standard' AS type, n FROM (SELECT file_name, {CANON_SQL.format('s')} AS reference_key, count(*) AS n FROM (SELECT file_name, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM spec) GROUP BY ALL) UNION ALL SELECT file_name, 'spec_' || value::BIGINT || unit, 'specification', count(*) FROM qt GROUP BY ALL")
def graph_entities(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    a = E.standards(chunks).groupBy("file_name", F.concat(F.lit("std_"), "key").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.lit("standard"))
    b = E.quantities(chunks).groupBy("file_name", F.concat(F.lit("spec_"), F.col("value").cast("long").cast("string"), "unit").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.lit("specification"))
    return a.unionByName(b)


@query(f"WITH {SPEC_SQL}, {QTY_SQL} SELECT chunk_id, 'req_' || chunk_id || '_0' AS src, 'spec_' || value::BIGINT || unit AS dst, 'SPECIFIES' AS type FROM qt WHERE {STRENGTH_SQL} IS NOT NULL")
def specifies_edges(spark, sf_dir):
    r = E.requirements(spec_chunks(spark, sf_dir)).withColumn("q", F.explode(patterns.quantities(F.col("sentence"))))
    return r.select("chunk_id", F.concat(F.lit("req_"), "chunk_id", F.lit("_"), F.col("pos").cast("string")).alias("src"), F.concat(F.lit("spec_"), F.col("q.value").cast("long").cast("string"), F.col("q.unit")).alias("dst"), F.lit("SPECIFIES").alias("type"))
