"""Queries that route, fuse and expand results, and lines on documents and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import entities as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import structure as S
from ..sources.corpus import SPEC_SQL, spec_chunks, spec_tables, table
from ..sources.store import stored
from .entities import STD_SQL
from .graph import EDGES_SQL, _edges
from .registry import query
from .retrieval import BM25_SQL, CANON_SQL, KEYS_SQL, QUESTIONS_SQL, RESULTS_SQL, STANDARD_SQL, _lists, _questions, _spec_results

CATALOG_SQL = """
    cat AS (SELECT 'DOC-' || o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'Plan ' || (o_custkey % 50) END AS display_name, CASE WHEN o_orderkey % 3 = 0 THEN 'EN ' || (50000 + o_custkey % 90) ELSE '' END AS standard_no,
            CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS description, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Standard' END, CASE WHEN o_orderkey % 7 < 3 THEN 'Status ' || o_orderstatus END], lambda c: c IS NOT NULL) AS categories,
            CASE WHEN o_orderkey % 6 = 1 THEN 'P' || (o_custkey % 20) WHEN o_orderkey % 6 = 2 THEN 'N/A' END AS project, o_orderkey AS pos FROM orders)"""


def _catalog(spark, sf_dir):
    """One row per order as a document: name, display_name, standard_no, description, categories, project, pos."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("DOC-"), key.cast("string")).alias("name"),
        F.when(key % 4 == 0, F.concat(F.lit("Plan "), (customer % 50).cast("string"))).alias("display_name"),
        F.when(key % 3 == 0, F.concat(F.lit("EN "), (50000 + customer % 90).cast("string"))).otherwise("").alias("standard_no"),
        F.when(key % 5 == 0, F.col("o_orderpriority")).otherwise("").alias("description"),
        F.array_compact(F.array(F.when(key % 2 == 0, "Standard"), F.when(key % 7 < 3, F.concat(F.lit("Status "), "o_orderstatus")))).alias("categories"),
        F.when(key % 6 == 1, F.concat(F.lit("P"), (customer % 20).cast("string"))).when(key % 6 == 2, "N/A").alias("project"),
        key.alias("pos"),
    )


@query(f"WITH {CATALOG_SQL} SELECT name, CASE WHEN description <> '' THEN 'Document ''' || name || ''': ' || description WHEN standard_no <> '' THEN 'Technical standard ' || standard_no || ' (' || name || ')' || CASE WHEN len(categories) > 0 THEN ' covering ' || array_to_string(categories, ', ') ELSE '' END ELSE 'Document ''' || name || '''' || CASE WHEN len(categories) > 0 THEN ' categorized as ' || array_to_string(categories, ', ') ELSE '' END END AS summary FROM cat")
def document_summaries(spark, sf_dir):
    return _catalog(spark, sf_dir).select("name", S.document_summary(F.col("name"), F.col("description"), F.col("standard_no"), F.array_join("categories", ", ")).alias("summary"))


@query(f"WITH {CATALOG_SQL}, c AS (SELECT 'category' AS facet, value, CASE WHEN value = 'Standard' AND standard_no <> '' THEN standard_no ELSE coalesce(display_name, name) END AS display, name, pos FROM (SELECT *, unnest(categories) AS value FROM cat) UNION ALL SELECT 'project', project, coalesce(display_name, name), name, pos FROM cat WHERE project IS NOT NULL AND project <> 'N/A') SELECT facet, value, display, arg_min(name, pos) AS document FROM c GROUP BY ALL")
def facet_documents(spark, sf_dir):
    return S.facet_documents(_catalog(spark, sf_dir))


@query("SELECT 'ORD-' || l_orderkey AS doc_name, CASE WHEN l_orderkey % 2 = 0 THEN 'Contains Table ' || (l_orderkey % 9 + 1) || ': Ratings' ELSE 'Contains table with columns: Item, Current, Code' END AS context FROM lineitem GROUP BY l_orderkey")
def table_contexts(spark, sf_dir):
    # every other table goes without a caption
    key = F.regexp_extract("doc_name", "[0-9]+$", 0).cast("long")
    text = F.when(key % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "Table [0-9]+: Ratings", "Ratings:"))
    return spec_tables(spark, sf_dir).select("doc_name", S.table_context(text).alias("context"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND len(trim(text)) >= 20 AND NOT regexp_matches(lower(text), 'does not contain|no information|not mentioned|cannot find|not found|no relevant|doesn''t provide|not available')")
def informative_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter((F.col("role") == "assistant") & R.informative(F.col("text"))).select("conv_id", "turn", "text")


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL} SELECT query_id, 'query' AS src, 'source_' || (rank - 1) AS dst, file_name || chr(10) || substr(s.section_title, 1, 30) AS label FROM res JOIN (SELECT chunk_id, section_title FROM spec) s ON s.chunk_id = id WHERE rank <= 10")
def query_star(spark, sf_dir):
    titles = spec_chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "section_title")
    return G.query_star(_spec_results(spark, sf_dir).join(titles, "id"))


@query(f"""WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL}, w AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 2 = 1 THEN 'SPEC-' || n_regionkey END AS wanted FROM nation),
    j AS (SELECT res.*, wanted FROM res JOIN w USING (query_id)),
    b AS (SELECT *, max(score) OVER (PARTITION BY query_id, file_name) AS best FROM j WHERE wanted IS NULL),
    a AS (SELECT query_id, 'documents' AS route, id, score, row_number() OVER (PARTITION BY query_id, file_name ORDER BY score DESC, id)::INTEGER AS own FROM b WHERE best >= 0.1 QUALIFY own <= 3)
    SELECT query_id, route, id, score, own AS rank FROM a UNION ALL SELECT * FROM (SELECT query_id, 'filtered' AS route, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS r FROM j WHERE file_name = wanted) WHERE r <= 10""")
def routed_search(spark, sf_dir):
    key = F.col("n_nationkey")
    wanted = table(spark, sf_dir, "nation").select(key.alias("query_id"), F.when(key % 2 == 1, F.concat(F.lit("SPEC-"), F.col("n_regionkey").cast("string"))).alias("file_name"))
    return R.routed(_spec_results(spark, sf_dir), wanted, 10, 3, 0.1)


@query(f"""WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL},
    en AS (SELECT query_id, {CANON_SQL.format('s')} AS key FROM (SELECT query_id, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM qs) UNION SELECT query_id, key FROM res JOIN st ON st.chunk_id = id WHERE rank <= 10),
    ch AS (SELECT query_id, 'std:' || key AS dst FROM en QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key) <= 10),
    g AS (SELECT query_id, src, count(*) AS n FROM ch JOIN ed USING (dst) WHERE type = 'REFERS_TO' AND src LIKE 'sec:%' GROUP BY ALL),
    se AS (SELECT query_id, 'graph' AS source_type, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, src)::INTEGER AS pos, src AS id FROM g QUALIFY pos <= 5)
    SELECT query_id, 'vector' AS source_type, rank AS pos, id FROM res WHERE rank <= 7 UNION ALL SELECT * FROM se""")
def graph_retrieval(spark, sf_dir):
    results = stored(_spec_results(spark, sf_dir).filter("rank <= 10"))
    asked = _questions(spark, sf_dir).select("query_id", F.explode(F.transform(patterns.standards(F.col("text")), patterns.canonical)).alias("key"))
    found = E.standards(results.select(F.col("id").alias("chunk_id"), "file_name", "text").distinct()).select(F.col("chunk_id").alias("id"), "key")
    found = results.select("query_id", "id").join(found, "id").select("query_id", "key")
    return G.expanded_results(results, asked, found, _edges(spark, sf_dir))


_ANALYSIS_SQL = f"an AS (SELECT item_id AS query_id, len(regexp_extract_all(text, {STANDARD_SQL})) > 0 AS refs FROM benchmark)"


@query(f"""WITH {BM25_SQL.format(k=20)}, {KEYS_SQL}, {_ANALYSIS_SQL},
    vq AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark) AND embedding IS NOT NULL),
    vs AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), v), 6) AS score FROM embeddings, vq WHERE embedding IS NOT NULL),
    vt AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs QUALIFY rank <= 20),
    al AS (SELECT 'vector' AS source, query_id, id, rank FROM vt UNION ALL SELECT 'bm25', query_id, id, rank FROM bm25 UNION ALL SELECT 'metadata', query_id, id, rank FROM kr),
    f AS (SELECT query_id, id, round(sum(CASE WHEN refs THEN CASE source WHEN 'vector' THEN 0.2 WHEN 'bm25' THEN 0.3 ELSE 0.6 END / 1.23 ELSE CASE source WHEN 'vector' THEN 0.5 WHEN 'bm25' THEN 0.3 ELSE 0.1 END END / (60 + rank)), 6) AS score, count(DISTINCT source) AS sources FROM al JOIN an USING (query_id) WHERE source <> 'metadata' OR refs GROUP BY query_id, id)
    SELECT query_id, id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def adaptive_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    questions = vectors.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    lists = _lists(spark, sf_dir).withColumn("source", F.when(F.col("source") == "keys", "metadata").otherwise(F.col("source")))
    lists = lists.select("source", "query_id", "id", "rank").unionByName(R.vector_top_k(vectors, questions, 20).select(F.lit("vector").alias("source"), "query_id", "id", "rank"))
    return R.hybrid(lists, R.adaptive_weights(R.analyse(asked)))


@query(f"""WITH {SPEC_SQL}, {STD_SQL}, {EDGES_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL},
    r5 AS (SELECT src, dst[5:] AS s FROM ed WHERE type = 'REFERS_TO' AND src LIKE 'sec:%' QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 5),
    ls AS (SELECT src, string_agg(s, ',' ORDER BY s) AS refs FROM r5 GROUP BY src)
    SELECT query_id, id, rank, coalesce(refs, '') AS refs FROM res LEFT JOIN ls ON ls.src = 'sec:' || file_name || '#' || section_number""")
def results_with_references(spark, sf_dir):
    found = G.with_references(_spec_results(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("query_id", "id", "rank", F.array_join("references", ",").alias("refs"))
