"""Queries that put several operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compliance as C
from ..operators import entities as E
from ..operators import feedback as B
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import structure as S
from ..sources.corpus import FEEDBACK_SQL, SPEC_SQL, feedback, spec_chunks, spec_markdown, table
from .compliance import PAIRS_SQL, SEVERITY_SQL, _answers
from .entities import QTY_SQL, STD_SQL, VALUES_SQL
from .feedback import BASKET_SQL, KW_SQL, PAIR_SQL
from .graph import EDGES_SQL, _edges
from .registry import query


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, u AS (SELECT src AS node, 'out' AS direction, type, dst AS other, weight FROM ed UNION ALL SELECT dst, 'in', type, src, weight FROM ed) SELECT *, row_number() OVER (PARTITION BY node, direction, type ORDER BY weight DESC, other)::INTEGER AS rank FROM u QUALIFY rank <= 20")
def cross_reference_discovery(spark, sf_dir):
    return G.incoming_and_outgoing(_edges(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, r AS (SELECT src[5:] AS document, dst[5:] AS s, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM ed WHERE type = 'REFERS_TO' AND src LIKE 'doc:%'), g AS (SELECT document, count(*) AS n_standards, string_agg(s, ', ' ORDER BY s) FILTER (n <= 15) AS names FROM r GROUP BY document) SELECT document, n_standards, 'Refers to ' || n_standards || ' standards: ' || names AS summary FROM g")
def reference_summaries(spark, sf_dir):
    return G.reference_summary(_edges(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, t AS (SELECT min(p_partkey)::VARCHAR AS identifier, p_name AS title FROM part GROUP BY p_name), h AS (SELECT 'ORD-' || (pos // 10) AS doc, section_title, (2 * (row_number() OVER (PARTITION BY pos // 10 ORDER BY pos) - 1))::INTEGER AS line_no FROM spec) SELECT doc, identifier, title, line_no FROM h JOIN t ON title = section_title WHERE line_no = 0")
def toc_title_fallback(spark, sf_dir):
    titles = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").cast("string").alias("identifier"))
    return S.title_fallback(spec_markdown(spark, sf_dir), titles)


@query(f"WITH {SPEC_SQL} SELECT chunk_id AS id, CASE WHEN text LIKE '%cable%' THEN 'Which cable sizes apply?|How are cables supported?|' WHEN text LIKE '%luminaire%' THEN 'Which light levels apply?|Where are luminaires placed?|' WHEN text LIKE '%standard%' THEN 'Which edition applies?|What does it replace?|' ELSE '' END || 'What else does ' || file_name || ' say?' AS questions FROM spec")
def follow_up_questions(spark, sf_dir):
    rows = spec_chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), F.col("text").alias("answer"), "file_name")
    return R.follow_ups(rows).select("id", F.array_join("questions", "|").alias("questions"))


@query("SELECT DISTINCT p_name AS focus, replace(t, '{focus}', p_name) AS question FROM part, (SELECT unnest(['What does the standard say on {focus}?', 'Which values hold for {focus}?']) AS t)")
def question_templates(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("focus")).distinct()
    return R.from_templates(["What does the standard say on {focus}?", "Which values hold for {focus}?"], words)


FOCUS_SQL = "CASE WHEN regexp_matches(section_title, 'widget|gear') AND NOT contains(section_title, 'hot') THEN ['current', 'area'] WHEN regexp_matches(section_title, 'bolt|ring') THEN ['area'] WHEN contains(section_title, 'hot') THEN ['illuminance'] ELSE ['current', 'area', 'illuminance'] END"


@query(f"WITH {SPEC_SQL}, {QTY_SQL}, {VALUES_SQL} SELECT tv.chunk_id, type, value FROM tv JOIN spec USING (chunk_id) WHERE list_contains({FOCUS_SQL}, type)")
def values_in_focus(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    wanted = chunks.select("chunk_id", F.explode(R.focus_types(F.col("section_title"))).alias("type"))
    return E.typed_values(chunks).join(wanted, ["chunk_id", "type"], "left_semi").select("chunk_id", "type", "value")


@query(f"WITH {SPEC_SQL} SELECT 'chunks' AS what, count(*) AS n FROM spec UNION ALL SELECT 'documents', count(DISTINCT file_name) FROM spec UNION ALL SELECT 'sections', count(DISTINCT file_name || section_number) FROM spec")
def index_statistics(spark, sf_dir):
    c = spec_chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_name").alias("documents"), F.countDistinct("file_name", "section_number").alias("sections"))
    return c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("what"), F.col(x).alias("n")) for x in ("chunks", "documents", "sections")])).alias("s")).select("s.*")


AUDIT_SQL = f"""WITH {SPEC_SQL}, {QTY_SQL}, {STD_SQL}, {VALUES_SQL}, {PAIRS_SQL}, v AS (SELECT DISTINCT file_name, key FROM st),
    f AS (SELECT file_name, type, arg_min(value, (pos, chunk_id)) AS source_value FROM tv GROUP BY ALL),
    i AS (SELECT p.source_doc, p.reference_doc, tv.type, any_value(f.source_value) AS s, arg_min(tv.value, (tv.pos, tv.chunk_id)) AS r
          FROM pairs p JOIN f ON f.file_name = p.source_doc JOIN tv ON tv.file_name = p.reference_doc AND tv.type = f.type JOIN spec ON spec.chunk_id = tv.chunk_id
          WHERE f.source_value <> tv.value AND (spec.text LIKE '%shall%' OR spec.text LIKE '%must%') GROUP BY ALL),
    g AS (SELECT p.source_doc, p.reference_doc, s.section_title AS topic, s.chunk_id, s.text, s.pos FROM pairs p JOIN spec s ON s.file_name = p.reference_doc
          WHERE (s.text LIKE '%shall%' OR s.text LIKE '%must%') AND NOT EXISTS (SELECT 1 FROM st JOIN v ON v.key = st.key WHERE st.chunk_id = s.chunk_id AND v.file_name = p.source_doc)),
    a AS (SELECT source_doc, reference_doc, 'value' AS category, type AS what, CASE WHEN s = 0 THEN 'critical' ELSE {SEVERITY_SQL.format(p='round(abs(s - r) / abs(s) * 100, 6)')} END AS severity FROM i
          UNION ALL SELECT source_doc, reference_doc, 'gap', topic, CASE WHEN arg_min(text, (pos, chunk_id)) LIKE '%shall%' THEN 'high' ELSE 'medium' END FROM g GROUP BY source_doc, reference_doc, topic
          UNION ALL SELECT p.source_doc, p.reference_doc, 'coverage', v.key, 'medium' FROM pairs p JOIN v ON v.file_name = p.reference_doc WHERE NOT EXISTS (SELECT 1 FROM v x WHERE x.file_name = p.source_doc AND x.key = v.key))
    SELECT * FROM a"""


@query(AUDIT_SQL)
def compliance_audit(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    pairs = table(spark, sf_dir, "nation").select(F.concat(F.lit("SPEC-"), F.col("n_nationkey").cast("string")).alias("source_doc"), F.concat(F.lit("SPEC-"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("reference_doc"))
    return C.audit(chunks, E.typed_values(chunks), E.requirements(chunks), E.standards(chunks), pairs)


@query(f"WITH {FEEDBACK_SQL}, {BASKET_SQL}, {PAIR_SQL}, {KW_SQL}, k AS (SELECT * FROM kw WHERE n >= 3 AND confidence >= 0.04) SELECT doc1 AS src, doc2 AS dst, 'COMPLEMENTS' AS type, confidence FROM cc WHERE confidence >= 0.01 UNION ALL SELECT a.document_name, b.document_name, 'RELATED_TO', 0.5 FROM k a JOIN k b USING (keyword) WHERE a.document_name < b.document_name GROUP BY ALL")
def learned_edges(spark, sf_dir):
    return B.learn(feedback(spark, sf_dir), 3, 0.01, 0.04)


@query(f"WITH {SPEC_SQL}, e AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n, user_id AS id FROM events), c AS (SELECT id, round(avg(value), 6) AS confidence FROM e WHERE n <= 5 GROUP BY id), b AS (SELECT pos // 10 AS id, round(count(*) FILTER (pos % 2 = 1) / count(*), 6) AS coverage FROM spec GROUP BY ALL), s AS (SELECT id, 1.0::DOUBLE AS support FROM b), j AS (SELECT * FROM s FULL JOIN b USING (id) FULL JOIN c USING (id)) SELECT id, round(0.4 * coalesce(support, 1) + 0.3 * coalesce(coverage, 1) + 0.3 * coalesce(confidence, 1), 6) AS quality, concat_ws(',', CASE WHEN support < 0.5 THEN 'low support' END, CASE WHEN coverage < 0.5 THEN 'low coverage' END, CASE WHEN confidence < 0.5 THEN 'low confidence' END) AS warnings FROM j")
def answer_verdicts(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    supported = C.support(answers.select("id", F.col("text").alias("answer"), F.col("text").alias("source")))
    sure = C.confidence(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value").alias("score"), F.col("event_id").alias("source")), 50)
    out = C.verdicts(supported, C.citation_coverage(E.bullets(answers)), sure)
    return out.select("id", "quality", F.array_join("warnings", ",").alias("warnings"))
