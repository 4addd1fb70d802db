"""Queries over feedback, caches, history and status, made of events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..operators import asof
from ..operators import feedback as B
from ..sources.corpus import FEEDBACK_SQL, feedback, table
from .registry import query

DELTA_SQL = "round(sum(CASE feedback_type WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -0.5 ELSE 0 END)::DOUBLE, 6)"


@query(f"WITH {FEEDBACK_SQL} SELECT document_name, page_number, {DELTA_SQL} AS relevance_score, count(*) FILTER (feedback_type = 'positive') AS positive, count(*) FILTER (feedback_type = 'negative') AS negative, max(ts) AS last_updated FROM fb GROUP BY ALL")
def source_scores(spark, sf_dir):
    return B.source_scores(feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK_SQL} SELECT lower(trim(query)) AS query_normalized, count(*) AS query_count, count(*) FILTER (feedback_type = 'positive') AS positive, count(*) FILTER (feedback_type = 'negative') AS negative FROM fb GROUP BY ALL")
def query_pattern_counts(spark, sf_dir):
    return B.query_patterns(feedback(spark, sf_dir))


REL_SQL = "rel AS (SELECT 'rating part ' || (user_id % 40) AS pattern, document_name || '#' || page_number AS source_ref, count(*) FILTER (rating = 'helpful') AS relevant, count(*) FILTER (rating <> 'helpful') AS irrelevant, round(avg((rating = 'helpful')::INTEGER), 6) AS relevance_score FROM fb GROUP BY ALL)"


@query(f"WITH {FEEDBACK_SQL}, {REL_SQL} SELECT * FROM rel")
def chunk_relevance(spark, sf_dir):
    return B.relevance(feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK_SQL}, {REL_SQL} SELECT * FROM rel WHERE relevance_score < 0.3")
def irrelevant_chunks(spark, sf_dir):
    return B.irrelevant(B.relevance(feedback(spark, sf_dir)))


@query(f"WITH {FEEDBACK_SQL}, q AS (SELECT document_name, count(*) FILTER (rating = 'helpful') AS helpful, count(*) FILTER (rating = 'not_helpful') AS not_helpful, count(*) FILTER (rating = 'irrelevant') AS irrelevant, count(*) AS total, round(avg(stars), 6) AS avg_stars FROM fb GROUP BY ALL) SELECT *, CASE WHEN total = 1 THEN 50.0 ELSE round(greatest(0, least(100, 50 + (10 * helpful - 5 * not_helpful - 10 * irrelevant) / total)), 6) END::DOUBLE AS quality FROM q")
def source_quality(spark, sf_dir):
    return B.source_quality(feedback(spark, sf_dir))


BASKET_SQL = "ba AS (SELECT DISTINCT user_id || '|' || ts::DATE AS basket, document_name FROM fb WHERE feedback_type = 'positive')"
PAIR_SQL = "co AS (SELECT a.document_name AS doc1, b.document_name AS doc2, count(*) AS pairs FROM ba a JOIN ba b USING (basket) WHERE a.document_name < b.document_name GROUP BY ALL HAVING count(*) >= 3), si AS (SELECT document_name, count(*) AS n FROM ba GROUP BY ALL), cc AS (SELECT doc1, doc2, pairs, round(pairs / greatest(x.n, y.n), 6) AS confidence FROM co JOIN si x ON x.document_name = doc1 JOIN si y ON y.document_name = doc2)"


@query(f"WITH {FEEDBACK_SQL}, {BASKET_SQL}, {PAIR_SQL} SELECT * FROM cc WHERE confidence >= 0.01")
def document_co_occurrence(spark, sf_dir):
    return B.co_occurrences(B.positive_baskets(feedback(spark, sf_dir)), 3, 0.01)


KW_SQL = "kw0 AS (SELECT unnest(['what', 'rating', 'part']) AS keyword, document_name, feedback_id FROM fb WHERE feedback_type = 'positive'), kw1 AS (SELECT keyword, document_name, count(*) AS n FROM kw0 GROUP BY ALL), kw AS (SELECT *, round(n / sum(n) OVER (PARTITION BY keyword), 6) AS confidence FROM kw1)"


@query(f"WITH {FEEDBACK_SQL}, {KW_SQL} SELECT * FROM kw WHERE n >= 3 AND confidence >= 0.04")
def keyword_documents(spark, sf_dir):
    return B.keyword_documents(feedback(spark, sf_dir), 3, 0.04)


@query(f"WITH {FEEDBACK_SQL}, {KW_SQL}, k AS (SELECT * FROM kw WHERE n >= 3 AND confidence >= 0.04) SELECT a.document_name AS src, b.document_name AS dst, count(*) AS keywords, 0.5::DOUBLE AS weight FROM k a JOIN k b USING (keyword) WHERE a.document_name < b.document_name GROUP BY ALL")
def related_documents(spark, sf_dir):
    return B.related(B.keyword_documents(feedback(spark, sf_dir), 3, 0.04))


@query(f"WITH {FEEDBACK_SQL} SELECT count(*) AS total, count(*) FILTER (feedback_type = 'positive') AS positive, count(*) FILTER (feedback_type = 'negative') AS negative, round(count(*) FILTER (feedback_type = 'positive') / count(*) * 100, 6) AS satisfaction, count(DISTINCT query) AS queries, round(avg(stars), 6) AS avg_stars FROM fb")
def feedback_statistics(spark, sf_dir):
    return B.statistics(feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK_SQL} SELECT document_name, page_number, {DELTA_SQL} AS relevance_score FROM fb GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 5")
def best_sources(spark, sf_dir):
    return B.best_sources(B.source_scores(feedback(spark, sf_dir))).select("document_name", "page_number", "relevance_score")


@query(f"WITH {FEEDBACK_SQL} SELECT user_id, feedback_id, query, ts FROM fb QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, feedback_id DESC) <= 3")
def recent_feedback(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("feedback_id"))
    return feedback(spark, sf_dir).withColumn("n", F.row_number().over(order)).filter("n <= 3").select("user_id", "feedback_id", "query", "ts")


#: The rule as it stands: one lookup of a key after the other, each with the time of the last store.
LOOKUP_SQL = """
    l0 AS (SELECT event_id AS id, ts, sha256(lower(trim(event_type || ' ' || (user_id % 40))) || '|') AS key, row_number() OVER (PARTITION BY event_type, user_id % 40 ORDER BY ts, event_id) AS n FROM events),
    lk AS (SELECT id, ts, key, n, ts AS stored, false AS hit FROM l0 WHERE n = 1
           UNION ALL SELECT l0.id, l0.ts, l0.key, l0.n, CASE WHEN l0.ts - lk.stored < INTERVAL 60 MINUTE THEN lk.stored ELSE l0.ts END, l0.ts - lk.stored < INTERVAL 60 MINUTE FROM lk JOIN l0 ON l0.key = lk.key AND l0.n = lk.n + 1)"""


def _lookups(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    asked = F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"))
    return B.cached(rows.select(F.col("event_id").alias("id"), "ts", cache_key(asked, F.lit("")).alias("key")))


@query(f"WITH RECURSIVE {LOOKUP_SQL} SELECT id, ts, key, hit FROM lk")
def response_cache_lookups(spark, sf_dir):
    return _lookups(spark, sf_dir)


@query(f"WITH RECURSIVE {LOOKUP_SQL} SELECT count(*) AS lookups, count(*) FILTER (hit) AS hits, count(DISTINCT key) AS entries, round(count(*) FILTER (hit) / count(*) * 100, 6) AS hit_rate FROM lk")
def response_cache_statistics(spark, sf_dir):
    return B.cache_statistics(_lookups(spark, sf_dir))


@query(f"WITH RECURSIVE {LOOKUP_SQL}, e AS (SELECT key, max(ts) AS last_access FROM lk GROUP BY key), n AS (SELECT *, row_number() OVER (ORDER BY last_access DESC, key) AS n, count(*) OVER () AS total FROM e) SELECT key, last_access FROM n WHERE n <= CASE WHEN total > 150 THEN 135 ELSE total END")
def cache_size_cap(spark, sf_dir):
    return B.kept_entries(_lookups(spark, sf_dir).groupBy("key").agg(F.max("ts").alias("last_access")), 150)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id AS key, v FROM v ORDER BY vec_id DESC LIMIT 100),
    s AS (SELECT q.vec_id AS query_id, key, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM v q, n WHERE q.vec_id <> key)
    SELECT query_id, key, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) = 1 AND similarity >= 0.3""")
def semantic_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    entries = rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ts"))
    return B.nearest_cached(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), entries, 0.3)


#: Embeddings as what was asked: a moment for each, out of order of their ids.
ASKED_SQL = "v AS (SELECT vec_id, TIMESTAMP '2024-01-01' + to_minutes((vec_id * 7919) % 100003) AS ts, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"""WITH {ASKED_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY ts, vec_id) AS n FROM v), l AS (SELECT e.*, (rank() OVER (ORDER BY ts)) - 1 AS seen FROM e),
    s AS (SELECT l.vec_id AS query_id, e.vec_id AS key, round(list_cosine_similarity(l.v, e.v), 6) AS similarity FROM l JOIN e ON e.n <= l.seen AND e.n > l.seen - 100 AND e.ts > l.ts - INTERVAL 7 DAY AND e.vec_id <> l.vec_id)
    SELECT query_id, key, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) = 1 AND similarity >= 0.3""")
def semantic_cache_as_of(spark, sf_dir):
    moment = F.timestamp_add("minute", F.col("vec_id") * 7919 % 100003, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), moment.alias("ts"))
    return asof.nearest_before(rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "key"), 0.3)


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(len(text)), 6) AS avg_chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def history_statistics(spark, sf_dir):
    return B.history_statistics(table(spark, sf_dir, "conversations"))


@query("WITH r AS (SELECT 'component-' || (user_id % 10) AS component, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS n FROM events), c AS (SELECT component, count(*) AS checks, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND n <= 3) AS recent, count(*) FILTER (NOT ok AND n = 1) AS newest FROM r GROUP BY component) SELECT component, checks, failed, CASE WHEN recent = 3 THEN 'unhealthy' WHEN newest = 1 THEN 'degraded' ELSE 'healthy' END AS status FROM c")
def component_health(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("component-"), (F.col("user_id") % 10).cast("string")).alias("component"), (F.col("event_type") != "error").alias("ok"))
    return B.health(rows)


@query(f"""WITH RECURSIVE {LOOKUP_SQL}, s AS (SELECT 'response_cache' AS store, count(*) FILTER (NOT hit) AS expired, count(DISTINCT key) AS entries, round(count(*) FILTER (hit) / count(*) * 100, 6) AS hit_rate, 0 AS total, 100.0 AS positive_rate FROM lk
    UNION ALL SELECT 'feedback', 0, 0, 100.0, count(*), round(count(*) FILTER (event_type IN ('purchase', 'signup')) / count(*) * 100, 6) FROM events)
    SELECT store, unnest(list_filter([CASE WHEN expired > 100 THEN 'clear expired entries' END, CASE WHEN hit_rate < 50 AND entries > 10 THEN 'raise the lifetime of entries' END, CASE WHEN positive_rate < 70 AND total > 20 THEN 'review negative feedback' END], lambda x: x IS NOT NULL)) AS advice FROM s""")
def maintenance_recommendations(spark, sf_dir):
    c = _lookups(spark, sf_dir).agg(F.count_if(~F.col("hit")).alias("expired"), F.countDistinct("key").alias("entries"), F.round(F.count_if("hit") / F.count(F.lit(1)) * 100, 6).alias("hit_rate"))
    cache = c.select(F.lit("response_cache").alias("store"), "expired", "entries", "hit_rate", F.lit(0).cast("long").alias("total"), F.lit(100.0).alias("positive_rate"))
    f = B.statistics(feedback(spark, sf_dir)).select(F.lit("feedback").alias("store"), F.lit(0).cast("long").alias("expired"), F.lit(0).cast("long").alias("entries"), F.lit(100.0).alias("hit_rate"), "total", F.col("satisfaction").alias("positive_rate"))
    return B.recommendations(cache.unionByName(f))


@query("SELECT event_type AS category, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n, max(ts) AS last FROM events WHERE event_type IN ('error', 'view') GROUP BY ALL")
def error_statistics(spark, sf_dir):
    level = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "error").otherwise("warning")
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    return rows.groupBy(F.col("event_type").alias("category"), level.alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
