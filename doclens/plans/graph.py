"""Queries over the graph of the specification corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import graph as G
from ..sources.corpus import SPEC_SQL, spec_chunks, table
from ..sources.store import stored
from .entities import STD_SQL
from .registry import query

EDGES_SQL = """
    ed AS (SELECT src, dst, type, count(*) AS weight FROM (
        SELECT 'doc:' || file_name AS src, 'sec:' || file_name || '#' || section_number AS dst, 'CONTAINS' AS type FROM spec
        UNION ALL SELECT 'doc:' || st.file_name, 'std:' || key, 'REFERS_TO' FROM st
        UNION ALL SELECT 'sec:' || st.file_name || '#' || section_number, 'std:' || key, 'REFERS_TO' FROM st JOIN spec USING (chunk_id)) GROUP BY ALL)"""


def _edges(spark, sf_dir):
    chunks = stored(spec_chunks(spark, sf_dir))
    return G.edges(chunks, E.standards(chunks), E.section_references(chunks))


@query(f"WITH {SPEC_SQL}, {STD_SQL} SELECT 'doc:' || file_name AS id, 'DOCUMENT' AS type, file_name AS name, NULL::BIGINT AS page FROM spec GROUP BY file_name UNION ALL SELECT 'sec:' || file_name || '#' || section_number, 'SECTION', arg_min(section_title, pos), arg_min(page_number, pos) FROM spec GROUP BY file_name, section_number UNION ALL SELECT DISTINCT 'std:' || key, 'STANDARD', key, NULL FROM st")
def graph_nodes(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    return G.nodes(chunks, E.standards(chunks))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL} SELECT * FROM ed")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL} SELECT type, count(*) AS n, sum(weight)::BIGINT AS weight FROM ed GROUP BY type")
def graph_edge_counts(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH {SPEC_SQL}, s AS (SELECT DISTINCT file_name, section_number AS number FROM spec UNION SELECT DISTINCT file_name, split_part(section_number, '.', 1) FROM spec) SELECT file_name, number, split_part(number, '.', 1) AS parent FROM s WHERE number LIKE '%.%'")
def section_parents(spark, sf_dir):
    chunks = spec_chunks(spark, sf_dir)
    own = chunks.select("file_name", F.col("section_number").alias("number")).union(chunks.select("file_name", F.substring_index("section_number", ".", 1)))
    return G.parents(own)


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, b AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), h1 AS (SELECT a AS start, b AS node FROM b WHERE a LIKE 'std:%'), h2 AS (SELECT DISTINCT h1.start, b.b AS node FROM h1 JOIN b ON h1.node = b.a WHERE b.b <> h1.start AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.start = h1.start AND x.node = b.b)), u AS (SELECT start, node, 1::INTEGER AS hops FROM h1 UNION ALL SELECT start, node, 2 FROM h2) SELECT start, node, hops FROM u QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops, node) <= 50")
def graph_neighbours(spark, sf_dir):
    edges = stored(_edges(spark, sf_dir))
    return G.neighbours(edges, edges.filter("dst LIKE 'std:%'").select(F.col("dst").alias("id")).distinct())


WALK_SQL = """
    b AS (SELECT a, b, min(type) AS type FROM (SELECT src AS a, dst AS b, type FROM ed UNION ALL SELECT dst, src, type FROM ed) WHERE a <> b GROUP BY a, b),
    w AS (SELECT DISTINCT dst AS start, dst AS node, 0::INTEGER AS hops, []::STRUCT(type VARCHAR, node VARCHAR)[] AS path FROM ed WHERE dst LIKE 'std:%'
        UNION ALL SELECT start, node, hops, path FROM (
            SELECT w.start, b.b AS node, w.hops + 1 AS hops, list_append(w.path, {'type': b.type, 'node': b.b}) AS path,
                   row_number() OVER (PARTITION BY w.start, b.b ORDER BY list_append(w.path, {'type': b.type, 'node': b.b})) AS n
            FROM w JOIN b ON b.a = w.node WHERE w.hops < 3 AND b.b <> w.start AND NOT list_contains(list_transform(w.path, lambda p: p.node), b.b)) WHERE n = 1),
    sh AS (SELECT * FROM w WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY hops, path) = 1)"""


@query(f"WITH RECURSIVE {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, {WALK_SQL} SELECT start, node, hops, array_to_string(list_transform(path, lambda p: p.type), ',') AS types, array_to_string(list_transform(path, lambda p: p.node), ',') AS via FROM sh QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops, node) <= 50")
def graph_walks(spark, sf_dir):
    edges = stored(_edges(spark, sf_dir))
    found = G.walks(edges, edges.filter("dst LIKE 'std:%'").select(F.col("dst").alias("id")).distinct())
    return found.select("start", "node", "hops", F.array_join("path.type", ",").alias("types"), F.array_join("path.node", ",").alias("via"))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL} SELECT src AS document, string_agg(dst, ',' ORDER BY dst) FILTER (type = 'REFERS_TO') AS standards, string_agg(dst, ',' ORDER BY dst) FILTER (type = 'CONTAINS') AS sections FROM ed WHERE src LIKE 'doc:%' GROUP BY src")
def document_references(spark, sf_dir):
    return G.document_references(_edges(spark, sf_dir)).select("document", F.array_join("standards", ",").alias("standards"), F.array_join("sections", ",").alias("sections"))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, r AS (SELECT src, dst FROM ed WHERE type = 'REFERS_TO' AND src LIKE 'doc:%'), s AS (SELECT x.dst AS standard, y.dst AS other, count(*) AS documents FROM r x JOIN r y ON x.src = y.src AND x.dst <> y.dst GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY standard ORDER BY documents DESC, other)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def co_referenced_standards(spark, sf_dir):
    return G.co_referenced(_edges(spark, sf_dir))


@query(f"WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, d AS (SELECT dst AS standard, src[5:] AS document FROM ed WHERE type = 'REFERS_TO' AND src LIKE 'doc:%'), s AS (SELECT dst AS standard, split_part(src[5:], '#', 1) AS document, count(*) AS n_sections FROM ed WHERE type = 'REFERS_TO' AND src LIKE 'sec:%' GROUP BY ALL) SELECT standard, document, coalesce(n_sections, 0) AS n_sections, row_number() OVER (PARTITION BY standard ORDER BY coalesce(n_sections, 0) DESC, document)::INTEGER AS rank FROM d LEFT JOIN s USING (standard, document) QUALIFY rank <= 10")
def referring_documents(spark, sf_dir):
    return G.referring_documents(_edges(spark, sf_dir))


@query("""WITH o AS (SELECT 'n' || c_nationkey AS src, c_mktsegment AS dst, 'RELATED_TO' AS type, round(count(*) / 200.0, 6)::DOUBLE AS weight FROM customer GROUP BY ALL),
    n AS (SELECT 'n' || c_nationkey AS src, c_mktsegment AS dst, 'RELATED_TO' AS type, round(avg(c_acctbal) / 10000, 6) AS confidence FROM customer GROUP BY ALL HAVING avg(c_acctbal) > 4000)
    SELECT src, dst, type, round(CASE WHEN confidence IS NULL THEN weight ELSE least(1.0, weight + 0.1 * confidence) END, 6) AS weight FROM o LEFT JOIN n USING (src, dst, type) WHERE round(CASE WHEN confidence IS NULL THEN weight ELSE least(1.0, weight + 0.1 * confidence) END, 6) >= 0.05""")
def strengthened_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.col("c_mktsegment").alias("dst"), F.lit("RELATED_TO").alias("type"))
    old = c.agg(F.round(F.count(F.lit(1)) / 200, 6).alias("weight"))
    new = c.agg(F.avg("c_acctbal").alias("m")).filter("m > 4000").select("src", "dst", "type", F.round(F.col("m") / 10000, 6).alias("confidence"))
    return G.pruned(G.strengthen(old, new), 0.05)
