"""Queries that compare the documents of a customer's successive orders, with SQL that reads every value from the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import values as V
from ..operators import comparison as C
from ..operators import entities as E
from ..sources.corpus import CLAUSE_SQL, clause_chunks, order_pairs
from .registry import query


def _values_sql(rows: str, text: str, name: str) -> str:
    """A query of all typed values of the column `text` of `rows`, with the columns of rows."""
    digits = lambda p: f"flatten(list_transform(regexp_extract_all({text}, '{p}'), lambda s: regexp_extract_all(s, '\\d+')))"
    taboo = f"list_transform(list_concat(list_concat({digits(V.NUMBERED_STANDARD)}, {digits(V.STANDARD_CONTEXT)}), regexp_extract_all({text}, '{V.YEAR}')), lambda n: n::DOUBLE)"
    prefixes = " OR ".join(f"contains(near, '{p}')" for p in V.PREFIXES)
    technical = ", ".join(f"'{w}'" for w in V.TECHNICAL_WORDS)
    each = []
    for i, (kind, pattern) in enumerate(V.VALUE_PATTERNS.items()):
        low, high = V.RANGES.get(kind, (None, None))
        inside = (f" AND value >= {low}" if low is not None else "") + (f" AND value <= {high}" if high is not None else "")
        named = "".join(f"nullif(trim(lower(regexp_extract(ctx, '(?i){p}', 0))), ''), " for p in V.SUBJECTS.get(kind, ()))
        each.append(f"""SELECT * EXCLUDE (m, s, k, near, ctx, taboo), {i} AS t, '{kind}' AS type, coalesce({named}list_filter(regexp_extract_all(ctx, '\\b([a-z]{{4,}})\\b', 1), lambda w: w IN ({technical}))[1] || ' {kind.replace('_', ' ')}', '{kind}') AS subject FROM (
            SELECT *, lower(substr({text}, greatest(start - 25, 0) + 1, start + len(original) + 10 - greatest(start - 25, 0))) AS near, lower(substr({text}, greatest(start - 60, 0) + 1, start + len(original) + 20 - greatest(start - 60, 0))) AS ctx FROM (
            SELECT *, m[k] AS original, regexp_extract(m[k], '^\\d+(?:\\.\\d+)?')::DOUBLE AS value, (list_sum(list_transform(s[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0))::BIGINT AS start FROM (
            SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT *, regexp_extract_all({text}, '(?i){pattern}') AS m, string_split_regex({text}, '(?i){pattern}') AS s, {taboo} AS taboo FROM {rows}))))
            WHERE NOT list_contains(taboo, value) AND NOT (value = floor(value) AND value BETWEEN 1000 AND 99999 AND ({prefixes})){inside}""")
    return f"{name} AS (SELECT * EXCLUDE (t), row_number() OVER (PARTITION BY {'chunk_id' if name == 'cv' else 'chunk_id, sentence_pos'} ORDER BY t, start) - 1 AS i FROM ({' UNION ALL '.join(each)}))"


VALUES_SQL = _values_sql("cl", "text", "cv")
WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda w: w <> ''))"
SEVERITY_SQL = "CASE WHEN {p} > 50 THEN 'critical' WHEN {p} > 20 THEN 'high' WHEN {p} > 10 THEN 'medium' ELSE 'low' END"
_SUBJECT_WORDS = "regexp_extract_all(lower({}), '\\b\\w{{3,}}\\b')"


def _related_sql(a: str, b: str) -> str:
    x, y = _SUBJECT_WORDS.format(a), _SUBJECT_WORDS.format(b)
    groups = " OR ".join(f"(list_has_any({x}, {list(g)!r}) AND list_has_any({y}, {list(g)!r}))" for g in V.RELATED)
    return f"(contains({a}, {b}) OR contains({b}, {a}) OR list_has_any({x}, {y}) OR {groups})"


SIMILAR_SQL = f"""
    w AS (SELECT chunk_id, file_name, pos, {WORDS_SQL.format('text')} AS words, list_filter(list_distinct(list_transform({WORDS_SQL.format('text')}, lambda x: regexp_replace(x, '[^a-z]', '', 'g'))), lambda x: list_contains({V.CONTEXT_WORDS!r}, x)) AS context FROM cl),
    sm AS (SELECT source_doc, reference_doc, r.chunk_id AS reference_chunk, r.pos AS reference_pos, s.chunk_id AS source_chunk, row_number() OVER (PARTITION BY source_doc, r.chunk_id ORDER BY len(list_intersect(r.context, s.context)) DESC, len(list_intersect(r.words, s.words)) DESC, s.pos, s.chunk_id)::INTEGER AS rank
           FROM op JOIN w r ON r.file_name = reference_doc JOIN w s ON s.file_name = source_doc WHERE len(list_intersect(r.context, s.context)) >= 2 AND len(list_intersect(r.words, s.words)) >= 5 QUALIFY rank <= 2)"""


@query(f"WITH {CLAUSE_SQL}, {VALUES_SQL} SELECT chunk_id, i::INTEGER AS i, type, value, original, start::INTEGER AS start, subject FROM cv")
def clause_values(spark, sf_dir):
    return C.chunk_values(clause_chunks(spark, sf_dir)).drop("file_name")


@query(f"WITH {CLAUSE_SQL}, {SIMILAR_SQL} SELECT * FROM sm")
def similar_clauses(spark, sf_dir):
    return C.similar_chunks(clause_chunks(spark, sf_dir), order_pairs(spark, sf_dir))


@query(f"""WITH {CLAUSE_SQL}, {VALUES_SQL}, {SIMILAR_SQL},
    j AS (SELECT sm.*, r.type, r.value AS reference_value, s.value AS source_value, r.subject AS rs, s.subject AS ss, r.i AS ri, s.i AS si FROM sm JOIN cv r ON r.chunk_id = reference_chunk JOIN cv s ON s.chunk_id = source_chunk AND s.type = r.type WHERE r.value <> s.value AND {_related_sql('s.subject', 'r.subject')}),
    f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY source_doc, type, source_value, reference_value, ss ORDER BY reference_doc, reference_pos, reference_chunk, rank, ri, si) = 1),
    p AS (SELECT *, CASE WHEN reference_value <> 0 THEN round((source_value - reference_value) / reference_value * 100, 6) ELSE 0 END AS percentage FROM f)
    SELECT source_doc, reference_doc, source_chunk, reference_chunk, type, CASE WHEN ss <> type THEN ss ELSE rs END AS subject, source_value, reference_value, CASE WHEN source_value > reference_value THEN 'HIGHER' ELSE 'LOWER' END AS status, round(source_value - reference_value, 6) AS difference, percentage, {SEVERITY_SQL.format(p='abs(percentage)')} AS severity FROM p""")
def clause_comparison(spark, sf_dir):
    return C.value_comparisons(clause_chunks(spark, sf_dir), order_pairs(spark, sf_dir))


SENTENCES_SQL = f"""
    sn AS (SELECT chunk_id, file_name, pos, (k - 1)::INTEGER AS sentence_pos, parts[k] AS sentence FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT *, string_split_regex(text, '[.;]\\s+') AS parts FROM cl)) WHERE regexp_matches(parts[k], '{V.MANDATORY}')),
    tp AS (SELECT *, CASE WHEN len(ph) > 0 THEN array_to_string(ph[1:3], ' ') ELSE substr(sentence, 1, 50) END AS topic FROM (SELECT *, regexp_extract_all(sentence, '\\b[A-Z][a-z]+(?:\\s+[a-z]+)*\\b') AS ph FROM sn))"""


@query(f"WITH {CLAUSE_SQL}, {SENTENCES_SQL} SELECT chunk_id, file_name, pos, sentence_pos, sentence, topic FROM tp")
def clause_requirements(spark, sf_dir):
    return C.mandatory_requirements(clause_chunks(spark, sf_dir))


BEST_SQL = f"""
    wt AS (SELECT *, {WORDS_SQL.format('topic')} AS tw FROM tp), wc AS (SELECT chunk_id AS source_chunk, file_name AS source_doc, pos AS source_pos, {WORDS_SQL.format('text')} AS cw FROM cl),
    bc AS (SELECT source_doc, reference_doc, chunk_id, sentence_pos, source_chunk FROM wt JOIN op ON reference_doc = file_name JOIN wc USING (source_doc) WHERE len(list_intersect(tw, cw)) >= 2 QUALIFY row_number() OVER (PARTITION BY source_doc, chunk_id, sentence_pos ORDER BY len(list_intersect(tw, cw)) DESC, source_pos, source_chunk) = 1)"""


@query(f"WITH {CLAUSE_SQL}, {SENTENCES_SQL}, {BEST_SQL} SELECT * FROM bc")
def best_clauses(spark, sf_dir):
    chunks = clause_chunks(spark, sf_dir)
    return C.best_chunks(C.mandatory_requirements(chunks), chunks, order_pairs(spark, sf_dir))


@query(f"""WITH {CLAUSE_SQL}, {VALUES_SQL}, {SENTENCES_SQL}, {BEST_SQL}, {_values_sql('sn', 'sentence', 'sv')},
    fs AS (SELECT chunk_id AS source_chunk, type, arg_min(value, i) AS value, arg_min(subject, i) AS subject FROM cv GROUP BY ALL),
    c AS (SELECT bc.*, sv.type, fs.subject AS ss, sv.subject AS rs, fs.value AS source_value, sv.value AS required_value, row_number() OVER (PARTITION BY source_doc, reference_doc, bc.chunk_id, bc.sentence_pos ORDER BY sv.i) AS n FROM bc JOIN sv ON sv.chunk_id = bc.chunk_id AND sv.sentence_pos = bc.sentence_pos JOIN fs ON fs.source_chunk = bc.source_chunk AND fs.type = sv.type WHERE fs.value <> sv.value),
    q AS (SELECT *, CASE WHEN ss <> type THEN ss ELSE rs END AS subject, CASE WHEN required_value <> 0 THEN round(abs(source_value - required_value) / required_value * 100, 6) END AS p FROM c WHERE n = 1)
    SELECT source_doc, reference_doc, chunk_id, sentence_pos, source_chunk, type, subject, source_value, required_value, CASE WHEN p IS NULL THEN 'critical' ELSE {SEVERITY_SQL.format(p='p')} END AS severity, 'Review and align ' || subject || ' value with ' || reference_doc || ' requirements' AS recommendation FROM q""")
def clause_compliance(spark, sf_dir):
    return C.requirement_conflicts(clause_chunks(spark, sf_dir), order_pairs(spark, sf_dir))


STRENGTH_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(sentence), '\\b{w}\\b') THEN '{k}'" for w, k in patterns.REQUIREMENTS) + " END"


@query(f"""WITH {CLAUSE_SQL}, s0 AS (SELECT chunk_id, file_name, trim(parts[k]) AS sentence, k FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT *, string_split_regex(text, '[.!?] |[.!?]$|\\n') AS parts FROM cl)) WHERE len(trim(parts[k])) >= 10),
    s AS (SELECT file_name, sentence, {STRENGTH_SQL} AS strength, {WORDS_SQL.format('sentence')} AS words, chunk_id || '/' || sentence AS id FROM s0),
    j AS (SELECT source_doc, reference_doc, a.strength AS strength1, a.sentence AS sentence1, b.strength AS strength2, b.sentence AS sentence2, a.id AS id1, b.id AS id2, len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) AS o FROM op JOIN s a ON a.file_name = source_doc JOIN s b ON b.file_name = reference_doc WHERE (a.strength = 'mandatory' AND b.strength = 'prohibited') OR (a.strength = 'prohibited' AND b.strength = 'mandatory'))
    SELECT source_doc, reference_doc, id1, strength1, sentence1, id2, strength2, sentence2, round(o, 6) AS overlap, 'high' AS severity FROM j WHERE o > 0.3""")
def strength_conflicts(spark, sf_dir):
    chunks = clause_chunks(spark, sf_dir)
    rows = chunks.select("chunk_id", "file_name", F.explode(patterns.sentences(F.col("text"))).alias("sentence"))
    rows = rows.select(F.concat_ws("/", "chunk_id", "sentence").alias("id"), "file_name", "sentence", patterns.strength(F.col("sentence")).alias("strength"))
    return C.strength_conflicts(rows, order_pairs(spark, sf_dir))


@query(f"WITH {CLAUSE_SQL} SELECT chunk_id, coalesce(nullif(section_title, ''), nullif(regexp_extract(substr(text, 1, 100), '[A-Z][a-z]+(?:\\s+[A-Za-z]+){{0,3}}', 0), ''), substr(text, 1, 50)) AS topic FROM cl")
def clause_topics(spark, sf_dir):
    return clause_chunks(spark, sf_dir).select("chunk_id", V.chunk_topic(F.col("section_title"), F.col("text")).alias("topic"))


_GROUPS_SQL = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in g) + f" THEN '{g[0]}' END" for g in C.CONFLICT_WORDS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {CLAUSE_SQL},
    w AS (SELECT chunk_id, file_name, pos, {WORDS_SQL.format('text')} AS words, list_filter(list_distinct(list_transform({WORDS_SQL.format('text')}, lambda x: regexp_replace(x, '[^a-z]', '', 'g'))), lambda x: list_contains({V.CONTEXT_WORDS!r}, x)) AS context,
          {_GROUPS_SQL} AS topics, list_sort(list_distinct(regexp_extract_all(text, '\\d+\\.?\\d*'))) AS numbers, regexp_matches(lower(text), 'shall|must|required|mandatory') AS hard FROM cl),
    m AS (SELECT source_doc, reference_doc, b.chunk_id AS base_chunk, c.chunk_id AS compared_chunk, b.topics AS t1, c.topics AS t2, b.numbers AS n1, c.numbers AS n2, b.hard OR c.hard AS hard,
          row_number() OVER (PARTITION BY reference_doc, b.chunk_id ORDER BY len(list_intersect(b.context, c.context)) DESC, len(list_intersect(b.words, c.words)) DESC, c.pos, c.chunk_id) AS rank
          FROM op JOIN w b ON b.file_name = source_doc JOIN w c ON c.file_name = reference_doc WHERE len(list_intersect(b.context, c.context)) >= 2 AND len(list_intersect(b.words, c.words)) >= 5 QUALIFY rank <= 5)
    SELECT source_doc, reference_doc, base_chunk, compared_chunk, array_to_string(list_transform(list_filter(t1, lambda x: list_contains(t2, x)), lambda x: upper(x[1]) || x[2:]), ', ') AS topic, CASE WHEN hard THEN 'high' ELSE 'medium' END AS severity
    FROM m WHERE list_has_any(t1, t2) AND len(n1) > 0 AND len(n2) > 0 AND n1 <> n2""")
def conflict_analysis(spark, sf_dir):
    return C.conflict_analysis(clause_chunks(spark, sf_dir), order_pairs(spark, sf_dir))


@query(f"WITH {CLAUSE_SQL}, m AS (SELECT DISTINCT file_name FROM cl WHERE regexp_matches(text, '(?i)\\bmandatory\\b')) SELECT DISTINCT file_name FROM cl WHERE file_name NOT IN (SELECT file_name FROM m)")
def unmined_documents(spark, sf_dir):
    chunks = clause_chunks(spark, sf_dir)
    rules = chunks.filter(F.col("text").rlike(r"(?i)\bmandatory\b")).select(F.col("file_name").alias("source_doc"))
    return E.unmined(chunks, rules)
