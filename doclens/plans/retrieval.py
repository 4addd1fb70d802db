"""Queries over postings, vectors, keys and fused lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as T
from ..operators import impact_index
from ..operators import retrieval as R
from ..operators import vector_index
from ..sources.corpus import SPEC_SQL, feedback, spec_chunks, table
from ..sources.store import stored
from .registry import query

TOKEN_SQL = "regexp_extract_all(lower(replace(coalesce(text, ''), 'İ', 'i')), '[a-z0-9_à-öø-ÿğışœ]+')"
BM25_SQL = f"""
    q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKEN_SQL}) AS term FROM benchmark) GROUP BY ALL),
    t AS (SELECT doc_id AS id, {TOKEN_SQL} AS w FROM documents),
    p AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    sc AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * times), 6) AS score
           FROM p JOIN q USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY query_id, id),
    bm25 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM sc WHERE score > 0 QUALIFY rank <= {{k}})"""


def _bm25(spark, sf_dir, k=10):
    return R.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query(f"WITH {BM25_SQL.format(k=10)} SELECT query_id, id, score, rank FROM bm25")
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(f"WITH {BM25_SQL.format(k=10)} SELECT query_id, id, score, rank FROM bm25")
def bm25_index_search(spark, sf_dir):
    """The same questions through the stored index, which reads the ranges that can still matter."""
    index, docs, n = impact_index.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return impact_index.search(index, docs, n, table(spark, sf_dir, "benchmark"), query_col="item_id")[0]


@query(f"WITH t AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def bm25_term_stats(spark, sf_dir):
    return R.term_stats(R.postings(table(spark, sf_dir, "documents"), "doc_id"))


@query(f"WITH t AS (SELECT {TOKEN_SQL} AS w FROM conversations) SELECT n, count(*) AS terms, count(DISTINCT g) AS distinct_terms FROM (SELECT 1 AS n, unnest(w) AS g FROM t UNION ALL SELECT 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM t UNION ALL SELECT 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) FROM t) GROUP BY n")
def ngram_terms(spark, sf_dir):
    words, rows = F.col("w"), table(spark, sf_dir, "conversations").select(T.tokens(F.col("text")).alias("w"))
    every = None
    for n, g in ((1, words), (2, T.ngrams(words, 2)), (3, T.ngrams(words, 3))):
        part = rows.select(F.lit(n).alias("n"), F.explode(g).alias("g"))
        every = part if every is None else every.union(part)
    return every.groupBy("n").agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("g").alias("distinct_terms"))


def _centroids(vectors):
    """One query vector for each label, the mean of its vectors."""
    at = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


VECTOR_SQL = """
    m AS (SELECT label AS query_id, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    c AS (SELECT query_id, list(x ORDER BY i) AS vector FROM m GROUP BY query_id),
    vs AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), vector), 6) AS score FROM embeddings CROSS JOIN c WHERE embedding IS NOT NULL),
    vt AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM vs QUALIFY rank <= 10)"""


@query(f"WITH {VECTOR_SQL} SELECT * FROM vt")
def vector_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return R.vector_top_k(rows, _centroids(rows))


@query()
def approximate_vector_search(spark, sf_dir):
    """Every twentieth vector against all of them, through the index; its recall is measured in a test."""
    rows = table(spark, sf_dir, "embeddings")
    own = stored(vector_index.usable(rows, "vec_id", "embedding"))
    model = vector_index.fit(own)
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index.search(vector_index.build(own, model), model, own, asked)


def _lists(spark, sf_dir):
    """Two ranked lists for each benchmark question: BM25 and shared rare trigram keys."""
    lexical = _bm25(spark, sf_dir, 20).select(F.lit("bm25").alias("source"), "query_id", "id", "score", "rank")
    # tokens first, as a column: inside the n-gram expression they would be cut anew for each n-gram
    key = lambda df, i: df.select(F.col(i).alias("id"), T.tokens(F.col("text")).alias("w")).select("id", F.explode(F.array_distinct(T.ngrams(F.col("w"), 3))).alias("key"))
    keys = key(table(spark, sf_dir, "documents"), "doc_id")
    # stored and counted: up to a million are sent to the documents' keys, which then aren't shuffled
    asked = stored(key(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("id", "query_id"))
    asked = F.broadcast(asked) if asked.count() <= 1_000_000 else asked
    return lexical.unionByName(R.key_search(keys, asked, 10).select(F.lit("keys").alias("source"), "query_id", "id", "score", "rank"))


KEYS_SQL = f"""
    dk AS (SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) AS key FROM (SELECT doc_id, {TOKEN_SQL} AS w FROM documents)),
    qk AS (SELECT DISTINCT item_id AS query_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) AS key FROM (SELECT item_id, {TOKEN_SQL} AS w FROM benchmark)),
    ks AS (SELECT query_id, id, count(*) AS shared FROM qk JOIN dk USING (key) GROUP BY query_id, id),
    kr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id)::INTEGER AS rank FROM ks QUALIFY rank <= 10),
    lists AS (SELECT 'bm25' AS source, query_id, id, score, rank FROM bm25 UNION ALL SELECT 'keys', query_id, id, round(1.0 / rank, 6), rank FROM kr)"""


@query(f"WITH {BM25_SQL.format(k=20)}, {KEYS_SQL}, f AS (SELECT query_id, id, round(sum(CASE source WHEN 'bm25' THEN 0.6 ELSE 0.4 END / (60 + rank)), 6) AS score, count(DISTINCT source) AS sources, max(rank) FILTER (source = 'bm25') AS bm25_rank, max(rank) FILTER (source = 'keys') AS keys_rank FROM lists GROUP BY query_id, id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM f")
def rank_fusion(spark, sf_dir):
    out = R.fuse(_lists(spark, sf_dir), {"bm25": 0.6, "keys": 0.4})
    return out.select("query_id", "id", "score", "sources", F.col("ranks")["bm25"].alias("bm25_rank"), F.col("ranks")["keys"].alias("keys_rank"), "rank")


@query(f"WITH {BM25_SQL.format(k=20)}, {KEYS_SQL}, s AS (SELECT query_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS lexical, id FROM bm25 WINDOW w AS (PARTITION BY query_id)) SELECT l.query_id, l.id, round(l.score * 0.7 + coalesce(lexical, 0) * 0.3, 6) AS score FROM lists l LEFT JOIN s USING (query_id, id) WHERE source = 'keys'")
def blended_scores(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return R.blend(lists.filter("source = 'keys'"), lists.filter("source = 'bm25'"))


def _questions(spark, sf_dir):
    """One question for each nation's standard: 'What does EN 500xx require for <p> A'."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("What rating does EN-"), (50000 + F.col("n_nationkey") * 3).cast("string"), F.lit(" give for "), (F.col("n_nationkey") * 2 + 1).cast("string"), F.lit(" A cable, table value in IS"), (3000 + F.col("n_nationkey")).cast("string"), F.lit("?")).alias("text"))


QUESTIONS_SQL = "qs AS (SELECT n_nationkey AS query_id, 'What rating does EN-' || (50000 + n_nationkey * 3) || ' give for ' || (n_nationkey * 2 + 1) || ' A cable, table value in IS' || (3000 + n_nationkey) || '?' AS text FROM nation)"
STANDARD_SQL = "'" + r"\b(?:EN|IS|IEC|BS|ISO|NFPA|NEK|HD|IEEE)[ -]?[0-9]{2,6}(?:-[0-9]+)*" + "'"
CANON_SQL = "upper(regexp_replace({}, '[ -]', '', 'g'))"


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, k AS (SELECT DISTINCT chunk_id AS id, {CANON_SQL.format('s')} AS key FROM (SELECT chunk_id, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM spec)), q AS (SELECT DISTINCT query_id, {CANON_SQL.format('s')} AS key FROM (SELECT query_id, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM qs)), c AS (SELECT query_id, id, count(*) AS shared FROM q JOIN k USING (key) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 20) SELECT *, round(1.0 / rank, 6) AS score FROM r")
def metadata_search(spark, sf_dir):
    keyed = lambda df, i, name: df.select(F.col(i).alias(name), F.explode(F.array_distinct(F.transform(patterns.standards(F.col("text")), patterns.canonical))).alias("key"))
    return R.key_search(keyed(spec_chunks(spark, sf_dir), "chunk_id", "id"), keyed(_questions(spark, sf_dir), "query_id", "query_id"))


QUANTITY_SQL = "'" + patterns.QUANTITY + "'"
QUANTITIES_SQL = f"SELECT DISTINCT {{id}} AS {{name}}, replace(v, ',', '.')::DOUBLE::BIGINT || ' ' || u AS key FROM (SELECT {{id}}, unnest(regexp_extract_all(text, {QUANTITY_SQL}, 1)) AS v, unnest(regexp_extract_all(text, {QUANTITY_SQL}, 2)) AS u FROM {{table}})"


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, k AS ({QUANTITIES_SQL.format(id='chunk_id', name='id', table='spec')}), q AS ({QUANTITIES_SQL.format(id='query_id', name='query_id', table='qs')}), c AS (SELECT query_id, id, count(*) AS shared FROM q JOIN k USING (key) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 20) SELECT query_id, id, shared, rank, round(1.0 / rank, 6) AS score FROM r")
def entity_search(spark, sf_dir):
    def keyed(df, i, name):
        found = F.transform(patterns.quantities(F.col("text")), lambda q: F.concat(q["value"].cast("long").cast("string"), F.lit(" "), q["unit"]))
        return df.select(F.col(i).alias(name), F.explode(F.array_distinct(found)).alias("key"))

    return R.key_search(keyed(spec_chunks(spark, sf_dir), "chunk_id", "id"), keyed(_questions(spark, sf_dir), "query_id", "query_id"))


#: What users' turns ask, besides their own words: a question of each intent, in English and Turkish.
ASKED = (
    "What is the definition of a cable tray?",
    "Calculate the current for 2,5 mm2 at 16 A and 230 V.",
    "See EN 50123-2 and IS3043 on earthing.",
    "Table value rating for 10 kW motors, 0.75 kV",
    "hangi kablo kesiti için kaç A ve kaç mm2?",
    "How are luminaires of 500 lux fixed?",
)
TURNS_SQL = "us AS (SELECT conv_id * 1000 + turn AS query_id, text || ' ' || CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(ASKED)) + " END AS text FROM conversations WHERE role = 'user')"


def _turns(spark, sf_dir):
    """The user turns of all conversations, each with one of ASKED behind it."""
    kind = (F.col("conv_id") + F.col("turn")) % len(ASKED)
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(q) for q in ASKED]), (kind + 1).cast("int"))).alias("text"))


_WORDS = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


@query(f"""WITH {TURNS_SQL}, t AS (SELECT query_id, text, lower(replace(text, 'İ', 'i')) AS low, {TOKEN_SQL} AS w, regexp_extract_all(text, '(?:^|[^A-Za-z0-9.,])([0-9]+(?:[.,][0-9]+)?)', 1) AS numbers,
        list_sort(list_distinct(regexp_extract_all(text, {QUANTITY_SQL}, 2))) AS units, list_sort(list_distinct(list_transform(regexp_extract_all(text, {STANDARD_SQL}), lambda s: {CANON_SQL.format('s')}))) AS refs FROM us),
    c AS (SELECT *, len(list_filter(w, lambda x: x IN ('table', 'row', 'column', 'value', 'rating'))) AS tables FROM t),
    i AS (SELECT *, CASE WHEN regexp_matches(low, '\\b(what is|define|definition|meaning)\\b') AND len(numbers) = 0 THEN 'definition' WHEN regexp_matches(low, '\\b(calculate|compute|how many|how much|sum)\\b') THEN 'calculation'
        WHEN len(refs) > 0 THEN 'reference' WHEN (len(numbers) > 0 AND len(units) > 0 AND tables > 0) OR tables >= 2 THEN 'table_lookup' ELSE 'general' END AS intent FROM c)
    SELECT query_id, CASE WHEN regexp_matches(low, '[ğışİ]') OR len(list_filter(w, lambda x: x IN {_WORDS(R.TURKISH)})) >= 2 THEN 'tr' ELSE 'en' END AS language, len(numbers)::BIGINT AS n_numbers,
           round(list_sum(list_transform(numbers, lambda n: replace(n, ',', '.')::DOUBLE)), 6) AS sum_numbers, array_to_string(units, ',') AS units, array_to_string(refs, ',') AS refs, intent,
           array_to_string(list_sort(list_distinct(list_filter(w, lambda x: length(x) > 3 AND x NOT IN {_WORDS(T.QUESTION_WORDS)}))), ',') AS keywords,
           CASE intent WHEN 'definition' THEN 0.6 WHEN 'calculation' THEN 0.3 WHEN 'reference' THEN 0.2 WHEN 'table_lookup' THEN 0.2 ELSE 0.5 END::DOUBLE AS vector_weight FROM i""")
def turn_analysis(spark, sf_dir):
    """Every user turn analysed: language, numbers, units, references, intent, keywords."""
    a = R.analyse(_turns(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    total = F.round(F.when(F.size("numbers") > 0, F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x)), 6)
    return a.select("query_id", "language", F.size("numbers").cast("long").alias("n_numbers"), total.alias("sum_numbers"), joined("units"), F.array_join(F.array_sort("references"), ",").alias("refs"), "intent", joined("keywords"), F.col("weights")["vector"].alias("vector_weight"))


SYNONYMS_SQL = "VALUES ('cable tray', ['ladder', 'raceway']), ('cable', ['conductor', 'wire', 'lead']), ('table value', ['tabulated', 'listed']), ('luminaire', ['lamp', 'fixture', 'light fitting']), ('kablo', ['cable', 'kesit', 'iletken'])"


@query(f"""WITH {TURNS_SQL}, y(key, words) AS ({SYNONYMS_SQL}), l AS (SELECT query_id, text, lower(replace(text, 'İ', 'i')) AS low FROM us),
    h AS (SELECT query_id, low, words FROM l JOIN y ON contains(low, key) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(key) DESC, key DESC) = 1),
    a AS (SELECT query_id, list_filter(words, lambda w: NOT contains(low, w))[1:3] AS added FROM h)
    SELECT query_id, CASE WHEN added IS NULL THEN text || ' ' ELSE text || ' ' || array_to_string(added, ' ') END AS expanded FROM us LEFT JOIN a USING (query_id)""")
def turn_expansion(spark, sf_dir):
    """Every user turn with the synonyms it lacks, of the longest term it holds."""
    rows = [("cable tray", ["ladder", "raceway"]), ("cable", ["conductor", "wire", "lead"]), ("table value", ["tabulated", "listed"]), ("luminaire", ["lamp", "fixture", "light fitting"]), ("kablo", ["cable", "kesit", "iletken"])]
    return R.expand(_turns(spark, sf_dir), spark.createDataFrame(rows, "key string, words array<string>")).select("query_id", "expanded")


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, 'en' AS language, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9.,])([0-9]+(?:[.,][0-9]+)?)', 1)) AS n_numbers, 'A' AS units, 'EN' || (50000 + query_id * 3) || ',IS' || (3000 + query_id) AS refs, 'reference' AS intent, 'rating,does,give,cable,table,value,is' || (3000 + query_id) AS keywords, 0.4::DOUBLE AS metadata_weight FROM qs")
def query_analysis(spark, sf_dir):
    a = R.analyse(_questions(spark, sf_dir))
    kept = F.filter("keywords", lambda w: ~w.rlike("^[0-9]+$"))
    return a.select("query_id", "language", F.size("numbers").cast("long").alias("n_numbers"), F.array_join("units", ",").alias("units"), F.array_join("references", ",").alias("refs"), "intent", F.array_join(kept, ",").alias("keywords"), F.col("weights")["metadata"].alias("metadata_weight"))


SYNONYMS = [("cable", ["conductor", "wire", "lead"]), ("table value", ["tabulated", "listed"]), ("rating", ["capacity"])]


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, text || ' tabulated listed' AS expanded FROM qs")
def query_expansion(spark, sf_dir):
    synonyms = spark.createDataFrame(SYNONYMS, "key string, words array<string>")
    return R.expand(_questions(spark, sf_dir), synonyms).select("query_id", "expanded")


def _spec_results(spark, sf_dir):
    keyed = lambda df, i, name: df.select(F.col(i).alias(name), F.explode(F.array_distinct(F.transform(patterns.standards(F.col("text")), patterns.canonical))).alias("key"))
    found = R.key_search(keyed(spec_chunks(spark, sf_dir), "chunk_id", "id"), keyed(_questions(spark, sf_dir), "query_id", "query_id"), 50)
    return found.join(spec_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id"), "id").select("query_id", "id", "score", "rank", "file_name", "page_number", "section_number", "text")


RESULTS_SQL = f"k AS (SELECT DISTINCT chunk_id AS id, {CANON_SQL.format('s')} AS key FROM (SELECT chunk_id, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM spec)), q AS (SELECT DISTINCT query_id, {CANON_SQL.format('s')} AS key FROM (SELECT query_id, unnest(regexp_extract_all(text, {STANDARD_SQL})) AS s FROM qs)), c AS (SELECT query_id, id, count(*) AS shared FROM q JOIN k USING (key) GROUP BY ALL), r0 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 50), res AS (SELECT query_id, id, round(1.0 / rank, 6) AS score, rank, file_name, page_number, section_number, text FROM r0 JOIN spec ON id = chunk_id)"


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id, file_name) AS best FROM res), k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name ORDER BY score DESC, id)::INTEGER AS own FROM b WHERE best >= 0.1 QUALIFY own <= 3) SELECT query_id, file_name, id, score, own AS rank, dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, file_name)::INTEGER AS document_rank FROM k2")
def per_document_top_k(spark, sf_dir):
    return R.per_document(_spec_results(spark, sf_dir), 3, 0.1).select("query_id", "file_name", "id", "score", "rank", "document_rank")


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL} SELECT query_id, string_agg('[' || rank || '] ' || file_name || ' p.' || page_number || ' ' || section_number || ': ' || text, chr(10) ORDER BY rank) AS context, count(*) AS n_sources FROM res WHERE rank <= 10 GROUP BY query_id")
def context_assembly(spark, sf_dir):
    return R.context(_spec_results(spark, sf_dir))


SCORES_SQL = "ss AS (SELECT document_name AS file_name, round(sum(CASE feedback_type WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -0.5 ELSE 0 END), 6)::DOUBLE - 60 AS relevance_score FROM fb GROUP BY ALL)"


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL}, fb AS (SELECT 'SPEC-' || (coalesce(json_extract_string(props, '$.k')::INTEGER, 0) % 25) AS document_name, CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS feedback_type FROM events), {SCORES_SQL} SELECT query_id, id, round(greatest(score * CASE WHEN coalesce(relevance_score, 0) > 0 THEN 1 + 0.15 * least(relevance_score, 5) WHEN coalesce(relevance_score, 0) < 0 THEN 1 - 0.10 * least(abs(relevance_score), 3) ELSE 1 END, 0), 6) AS score FROM res LEFT JOIN ss USING (file_name)")
def feedback_rerank(spark, sf_dir):
    delta = F.when(F.col("feedback_type") == "positive", 1.0).when(F.col("feedback_type") == "negative", -0.5).otherwise(0.0)
    scores = feedback(spark, sf_dir).groupBy(F.col("document_name").alias("file_name")).agg((F.round(F.sum(delta), 6) - 60).alias("relevance_score"))
    return R.feedback_rerank(_spec_results(spark, sf_dir), scores, ["file_name"]).select("query_id", "id", "score")


@query(f"WITH {SPEC_SQL}, {QUESTIONS_SQL}, {RESULTS_SQL}, bad AS (SELECT DISTINCT 'SPEC-' || (coalesce(json_extract_string(props, '$.k')::INTEGER, 0) % 25) AS file_name FROM events WHERE event_type = 'error'), m AS (SELECT res.*, bad.file_name IS NOT NULL AS b FROM res LEFT JOIN bad ON res.file_name = bad.file_name AND section_number LIKE '1.%'), n AS (SELECT query_id, id, b, CASE WHEN b THEN round(score / 2, 6) ELSE score END AS score FROM m) SELECT query_id, id, score FROM n WHERE NOT b OR score >= 0.2")
def irrelevance_penalty(spark, sf_dir):
    bad = feedback(spark, sf_dir).filter("feedback_type = 'negative'").select(F.lit("1").alias("pattern"), F.col("document_name").alias("source_ref"))
    rows = _spec_results(spark, sf_dir).withColumn("pattern", F.substring_index("section_number", ".", 1)).withColumn("source_ref", F.col("file_name"))
    return R.penalise(rows, bad).select("query_id", "id", "score")
