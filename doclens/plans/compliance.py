"""Queries that audit each specification against the next one, and that check answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import compliance as C
from ..operators import entities as E
from ..sources.corpus import SPEC_SQL, spec_chunks, table
from ..sources.store import stored
from .entities import QTY_SQL, STD_SQL, STRENGTH_SQL, VALUES_SQL
from .registry import query
from .retrieval import TOKEN_SQL

PAIRS_SQL = "pairs AS (SELECT 'SPEC-' || n_nationkey AS source_doc, 'SPEC-' || ((n_nationkey + 1) % 25) AS reference_doc FROM nation)"
SEVERITY_SQL = "CASE WHEN {p} > 50 THEN 'critical' WHEN {p} > 20 THEN 'high' WHEN {p} > 10 THEN 'medium' ELSE 'low' END"


def _pairs(spark, sf_dir):
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("SPEC-"), key.cast("string")).alias("source_doc"), F.concat(F.lit("SPEC-"), ((key + 1) % 25).cast("string")).alias("reference_doc"))


COMPARED_SQL = f"""
    fv AS (SELECT tv.file_name, type, subject, section_number, arg_min(struct_pack(value := value, chunk_id := tv.chunk_id), (tv.pos, tv.chunk_id)) AS v FROM tv JOIN spec USING (chunk_id) GROUP BY ALL),
    cv0 AS (SELECT p.source_doc, p.reference_doc, s.type, s.subject, s.section_number, s.v.chunk_id AS source_chunk, r.v.chunk_id AS reference_chunk, s.v.value AS source_value, r.v.value AS reference_value
            FROM pairs p JOIN fv s ON s.file_name = p.source_doc JOIN fv r ON r.file_name = p.reference_doc AND r.type = s.type AND r.subject = s.subject AND r.section_number = s.section_number WHERE s.v.value <> r.v.value),
    cv1 AS (SELECT *, round(abs(source_value - reference_value), 6) AS difference, CASE WHEN source_value <> 0 THEN round(round(abs(source_value - reference_value), 6) / abs(source_value) * 100, 6) END AS percentage FROM cv0),
    cv AS (SELECT *, CASE WHEN source_value > reference_value THEN 'HIGHER' ELSE 'LOWER' END AS relation, CASE WHEN percentage IS NULL THEN 'critical' ELSE {SEVERITY_SQL.format(p='percentage')} END AS severity FROM cv1)"""


def _compared(spark, sf_dir):
    chunks = stored(spec_chunks(spark, sf_dir))
    values = E.typed_values(chunks).join(chunks.select("chunk_id", "section_number"), "chunk_id")
    return C.compared_values(values, _pairs(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL}, {PAIRS_SQL}, {COMPARED_SQL} SELECT * FROM cv")
def value_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL}, {PAIRS_SQL}, {COMPARED_SQL}, c AS (SELECT source_doc, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM cv GROUP BY source_doc), s AS (SELECT *, greatest(0, least(100, 100 - 20 * critical - 10 * high - 5 * medium - low)) AS score FROM c) SELECT *, CASE WHEN score >= 80 THEN 'compliant' WHEN score >= 50 THEN 'partly' ELSE 'not compliant' END AS verdict FROM s")
def compliance_summary(spark, sf_dir):
    return C.summary(_compared(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL}, {PAIRS_SQL}, {COMPARED_SQL} SELECT source_doc, reference_doc, reference_chunk AS chunk_id, severity, 'TQ-' || lpad((row_number() OVER (PARTITION BY source_doc ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, reference_doc, reference_chunk))::VARCHAR, 3, '0') AS number FROM cv")
def technical_queries(spark, sf_dir):
    return C.technical_queries(_compared(spark, sf_dir).select("source_doc", "reference_doc", F.col("reference_chunk").alias("chunk_id"), "severity"))


@query(f"""WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL}, {PAIRS_SQL},
    f AS (SELECT file_name, type, arg_min(value, (pos, chunk_id)) AS source_value FROM tv GROUP BY ALL),
    i AS (SELECT p.source_doc, p.reference_doc, tv.type, arg_min(struct_pack(source_value := f.source_value, value := tv.value, unit := tv.unit, sentence := spec.text[:-2], chunk_id := tv.chunk_id), (tv.pos, tv.chunk_id)) AS i
          FROM pairs p JOIN f ON f.file_name = p.source_doc JOIN tv ON tv.file_name = p.reference_doc AND tv.type = f.type JOIN spec ON spec.chunk_id = tv.chunk_id
          WHERE f.source_value <> tv.value AND (spec.text LIKE '%shall%' OR spec.text LIKE '%must%') GROUP BY ALL),
    q AS (SELECT *, round(abs(i.source_value - i.value) / abs(i.source_value) * 100, 6) AS p FROM i)
    SELECT source_doc, reference_doc, type, i.chunk_id AS chunk_id, i.source_value AS source_value, i.value AS required_value, CASE WHEN i.source_value = 0 THEN 'critical' ELSE {SEVERITY_SQL.format(p='p')} END AS severity, i.sentence AS requirement, 'Set ' || type || ' to ' || i.value::BIGINT || ' ' || i.unit AS recommendation FROM q""")
def compliance_issues(spark, sf_dir):
    chunks = stored(spec_chunks(spark, sf_dir))
    return C.issues(E.typed_values(chunks), E.requirements(chunks), _pairs(spark, sf_dir))


@query(f"""WITH {SPEC_SQL}, {STD_SQL}, {PAIRS_SQL}, v AS (SELECT DISTINCT file_name, key FROM st),
    g AS (SELECT p.source_doc, p.reference_doc, s.section_title AS topic, s.chunk_id, s.text, s.pos FROM pairs p JOIN spec s ON s.file_name = p.reference_doc
          WHERE (s.text LIKE '%shall%' OR s.text LIKE '%must%') AND NOT EXISTS (SELECT 1 FROM st JOIN v ON v.key = st.key WHERE st.chunk_id = s.chunk_id AND v.file_name = p.source_doc))
    SELECT source_doc, reference_doc, topic, arg_min(chunk_id, (pos, chunk_id)) AS chunk_id, CASE WHEN arg_min(text, (pos, chunk_id)) LIKE '%shall%' THEN 'high' ELSE 'medium' END AS severity FROM g GROUP BY ALL""")
def requirement_gaps(spark, sf_dir):
    chunks = stored(spec_chunks(spark, sf_dir))
    terms = E.standards(chunks).select("chunk_id", "file_name", F.col("key").alias("term"))
    return C.gaps(chunks, terms, _pairs(spark, sf_dir), 1)


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {PAIRS_SQL}, v AS (SELECT DISTINCT file_name, key FROM st) SELECT p.source_doc, p.reference_doc, v.key FROM pairs p JOIN v ON v.file_name = p.reference_doc WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.file_name = p.source_doc AND x.key = v.key)")
def standard_coverage(spark, sf_dir):
    return C.coverage(E.standards(spec_chunks(spark, sf_dir)), _pairs(spark, sf_dir))


NUM_SQL = "list_sort(list_distinct(regexp_extract_all({}, '[0-9]+')))"


@query(f"""WITH {SPEC_SQL}, {PAIRS_SQL}, k AS (SELECT unnest(['cable', 'conductor', 'luminaire', 'standard']) AS keyword),
    f AS (SELECT file_name, keyword, arg_min(struct_pack(chunk_id := chunk_id, text := text), (pos, chunk_id)) AS c FROM spec JOIN k ON contains(lower(text), keyword) GROUP BY ALL)
    SELECT p.source_doc, p.reference_doc, a.keyword, a.c.chunk_id AS chunk1, b.c.chunk_id AS chunk2, CASE WHEN regexp_matches(a.c.text || b.c.text, 'shall|must') THEN 'high' ELSE 'medium' END AS severity
    FROM pairs p JOIN f a ON a.file_name = p.source_doc JOIN f b ON b.file_name = p.reference_doc AND a.keyword = b.keyword WHERE {NUM_SQL.format('a.c.text')} <> {NUM_SQL.format('b.c.text')}""")
def number_conflicts(spark, sf_dir):
    return C.number_conflicts(spec_chunks(spark, sf_dir), ("cable", "conductor", "luminaire", "standard"), _pairs(spark, sf_dir))


GRAM_SQL = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || '_' || {0}[i + 1] || '_' || {0}[i + 2]))"


@query(f"""WITH c AS (SELECT conv_id, turn, role, {TOKEN_SQL} AS w, lag({TOKEN_SQL}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
    g AS (SELECT conv_id || '-' || turn AS id, {GRAM_SQL.format('w')} AS a, {GRAM_SQL.format('p')} AS s FROM c WHERE role = 'assistant' AND p IS NOT NULL)
    SELECT id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, s)) / len(a), 6) ELSE 1.0 END AS support FROM g""")
def answer_support(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("source", before).filter("role = 'assistant' AND source IS NOT NULL")
    return C.support(rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer"), "source"))


def _answers(spark, sf_dir):
    """One answer for each order: a bullet per line, those of odd lines with their source."""
    rows = spec_chunks(spark, sf_dir)
    cite = F.when(F.col("pos") % 2 == 1, F.concat(F.lit(" ("), "file_name", F.lit(", "), "section_number", F.lit(")"))).otherwise("")
    return rows.groupBy(F.floor(F.col("pos") / 10).alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "text", cite).alias("b"))))["b"], "\n").alias("text"))


@query(f"WITH {SPEC_SQL} SELECT pos // 10 AS id, count(*) AS bullets, count(*) FILTER (pos % 2 = 1) AS cited, round(count(*) FILTER (pos % 2 = 1) / count(*), 6) AS coverage FROM spec GROUP BY ALL")
def citation_coverage(spark, sf_dir):
    return C.citation_coverage(E.bullets(_answers(spark, sf_dir)))


@query(f"WITH {SPEC_SQL} SELECT pos // 10 AS id, (row_number() OVER (PARTITION BY pos // 10 ORDER BY pos) - 1)::INTEGER AS pos, text || CASE WHEN pos % 2 = 1 THEN ' (' || file_name || ', ' || section_number || ')' ELSE '' END AS bullet, CASE WHEN pos % 2 = 1 THEN file_name || '#' || section_number END AS source FROM spec")
def answer_bullets(spark, sf_dir):
    return E.bullets(_answers(spark, sf_dir))


@query("WITH r AS (SELECT user_id AS id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT id, round(avg(score), 6) AS confidence, round(avg(score), 6) >= 50 AS confident FROM r WHERE n <= 5 GROUP BY id")
def answer_confidence(spark, sf_dir):
    return C.confidence(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value").alias("score"), F.col("event_id").alias("source")), 50)


@query(f"WITH {SPEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY pos, chunk_id) AS n FROM spec WHERE regexp_matches(lower(text) || ' ' || lower(section_title), 'luminaire|widget')) SELECT file_name, count(DISTINCT section_number) AS n_sections, count(DISTINCT page_number) AS n_pages, count(*) AS n_matches FROM r WHERE n <= 50 GROUP BY file_name")
def topic_extracts(spark, sf_dir):
    return C.topic_extract(spec_chunks(spark, sf_dir), ("luminaire", "widget"))


@query(f"WITH {SPEC_SQL} SELECT file_name, section_title AS topic, {STRENGTH_SQL} AS strength, count(*) AS n FROM spec WHERE {STRENGTH_SQL} IS NOT NULL GROUP BY ALL")
def requirement_counts(spark, sf_dir):
    rows = spec_chunks(spark, sf_dir).withColumn("strength", patterns.strength(F.col("text"))).filter("strength IS NOT NULL")
    return rows.groupBy("file_name", F.col("section_title").alias("topic"), "strength").agg(F.count(F.lit(1)).alias("n"))
