"""Queries that look for vocabularies made of the benchmark's items in all documents and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases as P
from ..sources.corpus import table
from .registry import query

#: Every two neighbouring words of an item, of two letters and more, with the item as their topic.
VOCABULARY_SQL = """
    bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: len(w) > 1) AS w FROM benchmark),
    vo AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS phrase, 'item-' || item_id AS topic FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM bw)),
    ph AS (SELECT DISTINCT phrase FROM vo)"""
#: A text with a mark at both edges of each word, and what a phrase of two words reads like there.
MARKED_SQL = r"d AS (SELECT doc_id, text, regexp_replace(lower(text), '([\pL\pN_]+)', chr(1) || '\1' || chr(1), 'g') AS low FROM documents)"
_HIT = "contains(low, chr(1) || replace({0}, ' ', chr(1) || ' ' || chr(1)) || chr(1))"


def _vocabulary(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 1)
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.element_at("w", i + 2)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    return rows.select(F.explode(pairs).alias("phrase"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("topic"))


@query(f"WITH {VOCABULARY_SQL}, {MARKED_SQL}, h AS (SELECT doc_id, phrase FROM d JOIN ph ON {_HIT.format('phrase')}), t AS (SELECT doc_id AS id, topic, count(*) AS n FROM h JOIN vo USING (phrase) GROUP BY ALL) SELECT id, string_agg(topic, ',' ORDER BY topic) AS topics, sum(n)::BIGINT AS n_phrases FROM t GROUP BY id")
def phrase_topics(spark, sf_dir):
    """Topics of all documents by whole-word phrases."""
    words = _vocabulary(spark, sf_dir)
    out = P.tags(P.found(table(spark, sf_dir, "documents"), words, "doc_id"), words)
    return out.select("id", F.array_join("topics", ",").alias("topics"), "n_phrases")


#: A rule for each item: its first phrase or its second, not its third.
RULES_SQL = "ru AS (SELECT item_id AS priority, w[1] || ' ' || w[2] AS a1, w[2] || ' ' || w[3] AS a2, w[3] || ' ' || w[4] AS n1 FROM bw WHERE len(w) >= 4)"


@query(f"WITH {VOCABULARY_SQL}, {RULES_SQL}, {MARKED_SQL}, f AS (SELECT doc_id, min(priority) AS priority FROM d JOIN ru ON ({_HIT.format('a1')} OR {_HIT.format('a2')}) AND NOT {_HIT.format('n1')} GROUP BY doc_id) SELECT doc_id AS id, coalesce(priority, -1) AS priority, CASE WHEN trim(coalesce(text, '')) = '' THEN '' WHEN priority IS NULL THEN 'area,current' ELSE 'item-' || priority END AS types FROM d LEFT JOIN f USING (doc_id)")
def phrase_rules(spark, sf_dir):
    """The first rule of a table that fits each document."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 1)
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).filter(F.size("w") >= 4)
    pair = lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))
    rules = rows.select(F.col("item_id").alias("priority"), F.array(pair(1), pair(2)).alias("any"), F.array().cast("array<string>").alias("all"), F.array(pair(3)).alias("none"), F.array(F.concat(F.lit("item-"), F.col("item_id").cast("string"))).alias("types"))
    docs = table(spark, sf_dir, "documents")
    out = P.cascade(docs, P.found(docs, P.rule_terms(rules), "doc_id"), rules, ("area", "current"), "doc_id")
    return out.select("id", F.coalesce("priority", F.lit(-1)).alias("priority"), F.array_join("types", ",").alias("types"))
