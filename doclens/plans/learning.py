"""Queries over what is learned as feedback comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ..sources.corpus import FEEDBACK_SQL, feedback
from .registry import query

#: A user's positive feedback of one day is one response, with the time of its last row.
LEARNED_SQL = """
    rs AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS basket, ts, document_name FROM fb WHERE feedback_type = 'positive'),
    bt AS (SELECT basket, max(ts) AS ts FROM rs GROUP BY basket),
    sd AS (SELECT DISTINCT r.basket, b.ts, r.document_name AS doc FROM rs r JOIN bt b USING (basket)),
    pr AS (SELECT a.basket, a.ts, a.doc AS doc1, b.doc AS doc2 FROM sd a JOIN sd b USING (basket) WHERE a.doc < b.doc),
    pc AS (SELECT a.basket, a.ts, a.doc1, a.doc2, count(*) AS pairs FROM pr a JOIN pr b ON a.doc1 = b.doc1 AND a.doc2 = b.doc2 AND b.ts >= a.ts - INTERVAL 7 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.basket <= a.basket)) GROUP BY ALL),
    dc AS (SELECT a.basket, a.doc, count(*) AS n FROM sd a JOIN sd b ON a.doc = b.doc AND b.ts >= a.ts - INTERVAL 7 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.basket <= a.basket)) GROUP BY ALL),
    cf AS (SELECT p.*, x.n AS n1, y.n AS n2, p.pairs / greatest(x.n, y.n) AS c FROM pc p JOIN dc x ON x.basket = p.basket AND x.doc = doc1 JOIN dc y ON y.basket = p.basket AND y.doc = doc2),
    gd AS (SELECT basket, doc1, doc2, row_number() OVER (PARTITION BY doc1, doc2 ORDER BY ts, basket) AS k FROM cf WHERE pairs >= 2 AND c >= 0.05),
    le AS (SELECT cf.basket, ts, cf.doc1, cf.doc2, pairs, n1, n2, round(c, 6) AS confidence, CASE WHEN k = 1 THEN 'created' WHEN k > 1 THEN 'strengthened' END AS learned FROM cf LEFT JOIN gd USING (basket, doc1, doc2))"""


def _learned(spark, sf_dir):
    good = feedback(spark, sf_dir).filter("feedback_type = 'positive'")
    responses = good.select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("basket"), "ts", "document_name")
    return L.learned_pairs(responses, 7, 2, 0.05)


@query(f"WITH {FEEDBACK_SQL}, {LEARNED_SQL} SELECT * FROM le")
def learned_after_each_response(spark, sf_dir):
    return _learned(spark, sf_dir)


@query(f"WITH {FEEDBACK_SQL}, {LEARNED_SQL} SELECT ts::DATE AS day, count(DISTINCT basket) AS runs, count(*) FILTER (learned = 'created') AS created, count(*) FILTER (learned = 'strengthened') AS strengthened FROM le GROUP BY ALL")
def learning_runs(spark, sf_dir):
    return L.learning_runs(_learned(spark, sf_dir))
