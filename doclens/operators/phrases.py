"""Vocabularies of many phrases: whole-word matches by automata, tags by topic, and cascades of rules on the phrases found."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in one automaton, which takes some hundred times that in each task.
AUTOMATON_BYTES = 1 << 20


def _word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(p, p)
    out.make_automaton()
    return out


def whole_words(text: str, automaton: ahocorasick.Automaton) -> dict[str, tuple[int, int]]:
    """For each phrase how often it stands in the text with a word's edge at both ends, and where first."""
    out: dict[str, tuple[int, int]] = {}
    for end, p in automaton.iter(text):
        begin = end - len(p) + 1
        before = begin > 0 and _word(text[begin - 1])
        after = end + 1 < len(text) and _word(text[end + 1])
        if before != _word(p[0]) and after != _word(p[-1]):
            n, first = out.get(p, (0, begin))
            out[p] = (n + 1, first)
    return out


def found(texts: DataFrame, vocabulary: DataFrame, id_col: str = "id", text_col: str = "text", most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, phrase, n, start): each phrase of the vocabulary (phrase, ...) in each text, matches may overlap; start counts characters of the lower-cased text.

    Case doesn't count.  A match begins and ends at the edge of a word.  Phrases
    are sent to the tasks as automata; a vocabulary of more than `most_bytes` goes in several,
    each a scan of the texts, so no task holds more than that.  Null and empty
    texts hold nothing, null and empty phrases are none, repeated phrases are one.
    Rows that repeat an id and a text count each for themselves.
    """
    phrases = vocabulary.select(F.lower("phrase").alias("phrase")).filter("phrase <> ''").distinct()
    bytes_ = phrases.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    # shares by hash stay near their mean; half of the bound leaves room
    parts = 1 if bytes_ <= most_bytes else -(-2 * bytes_ // most_bytes)
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    read = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''")
    schema = f"id {read.schema['id'].dataType.simpleString()}, phrase string, n long, start long"
    out = None
    for part in range(parts):
        own = [r[0] for r in dealt.filter(F.col("part") == part).select("phrase").collect()]
        if own:
            rows = read.mapInPandas(_scan(own), schema)
            out = rows if out is None else out.unionByName(rows)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def _scan(own: list[str]):
    def run(batches):
        automaton = _automaton(own)
        for pdf in batches:
            rows = [(i, p, n, start) for i, text in zip(pdf["id"], pdf["text"]) for p, (n, start) in whole_words(text.lower(), automaton).items()]
            yield pd.DataFrame(rows, columns=["id", "phrase", "n", "start"])

    return run


def tags(hits: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, topics, n_phrases): the topics of the phrases found, in order; vocabulary (phrase, topic), a phrase may have several topics.  Texts without a phrase have no row."""
    words = vocabulary.select(F.lower("phrase").alias("phrase"), "topic").filter("phrase <> '' AND topic IS NOT NULL").distinct()
    # one row for each text and topic before texts are put together
    each = hits.select("id", "phrase").distinct().join(words, "phrase").groupBy("id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("id").agg(F.array_sort(F.collect_list("topic")).alias("topics"), F.sum("n").alias("n_phrases"))


def rule_terms(rules: DataFrame) -> DataFrame:
    """(priority, phrase, kind): the phrases that rules (priority, any, all, none, types) name; this is the vocabulary to look for."""
    each = [rules.select("priority", F.explode(kind).alias("phrase"), F.lit(kind).alias("kind")) for kind in ("any", "all", "none")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("priority", F.lower("phrase").alias("phrase"), "kind").distinct()


def cascade(texts: DataFrame, hits: DataFrame, rules: DataFrame, default: tuple[str, ...], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, priority, types): the rule of least priority that fits each text, from hits of rule_terms; `default` with priority null where none does.

    A rule fits where a phrase of `any` is found (if it names some), all of `all`,
    and none of `none`; priorities are unique.  A rule with neither `any` nor
    `all` fits nothing; what holds for every text is the default.  Null and blank texts ask for no types.
    """
    met = hits.select("id", "phrase").distinct().join(rule_terms(rules), "phrase").groupBy("id", "priority")
    met = met.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("any", "all", "none")])
    size = lambda k: F.size(F.array_distinct(F.transform(F.coalesce(k, F.array().cast("array<string>")), F.lower)))
    limits = rules.select("priority", "types", size("any").alias("any_size"), size("all").alias("all_size"))
    fits = met.join(limits, "priority").filter("n_none = 0 AND n_all = all_size AND (any_size = 0 OR n_any > 0) AND any_size + all_size > 0")
    best = fits.groupBy("id").agg(F.min_by(F.struct("priority", "types"), "priority").alias("b"))
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(best, "id", "left")
    none = F.array().cast("array<string>")
    types = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", none).otherwise(F.coalesce("b.types", F.array(*[F.lit(t) for t in default]) if default else none))
    return rows.select("id", F.when(F.size(types) > 0, F.col("b.priority")).alias("priority"), types.alias("types"))
