"""Retrieval over tables of chunks and questions: postings, BM25, vectors, keys, fusion, feedback."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import patterns, text as T
from ..sources.store import stored

DIGITS = 6


def postings(chunks: DataFrame, id_col: str, text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, term, tf, length) with n-grams up to `longest`; length counts all terms of the chunk."""
    rows = chunks.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("words"))
    terms = F.concat("words", *[T.ngrams(F.col("words"), n) for n in range(2, longest + 1)])
    rows = rows.select("id", terms.alias("terms")).withColumn("length", F.size("terms"))
    return rows.select("id", "length", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def term_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def ranked(df: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best rows of each query with rank from 1; scores count rounded, so ties don't hang on the order of sums."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Questions that are scored in one pass over the texts; scores that a task holds at a time; what rounding can make of two scores.
SCORED, HELD, MARGIN = 2000, 1_000_000, 2 * 10.0**-DIGITS


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", query_col: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank): idf = ln((N - df + .5) / (df + .5) + 1); repeated query terms count again; only scores above 0.

    The texts are scanned twice and nothing of them is shuffled or stored: once for the counts
    of the questions' terms, once for the scores, which each task sums up where the texts lie; it
    returns what can be among a question's k best.  Questions go in blocks of bounded
    size.  Ids are unique.
    """
    asked = stored(questions.select(F.col(query_col).alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    words = chunks.select(F.col(id_col).alias("id"), T.tokens(F.col("text")).alias("words"))
    blocks = max(1, -(-asked.select("query_id").distinct().count() // SCORED))
    out = None
    for block in range(blocks):
        part = _scored(words, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), k, k1, b)
        out = part if out is None else out.unionByName(part)
    return ranked(out.withColumn("score", F.round("score", DIGITS)).filter("score > 0"), k)


def _scored(words: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, id, score), not rounded, of all rows of words (id, words) that can be among the k best of a question of asked (query_id, term, times)."""
    spark, types = words.sparkSession, {c: t for df in (words, asked) for c, t in df.dtypes}
    # one entry of no term carries the length
    wanted = asked.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    entries = words.select(F.size("words").alias("length"), F.explode(F.array_append(F.array_distinct("words"), "")).alias("term")).join(F.broadcast(wanted), "term", "left_semi")
    counts = {r["term"]: r for r in entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("length").alias("mean")).collect()}
    n, mean = (counts[""]["df"], counts[""]["mean"] or 1.0) if "" in counts else (0, 1.0)
    rows = [r for r in asked.collect() if r["term"] in counts]
    terms, queries = ({x: i for i, x in enumerate(dict.fromkeys(r[c] for r in rows))} for c in ("term", "query_id"))
    rows.sort(key=lambda r: (terms[r["term"]], queries[r["query_id"]]))
    of_term, of_query = (np.array([names[r[c]] for r in rows], np.int64) for names, c in ((terms, "term"), (queries, "query_id")))
    df = np.array([counts[r["term"]]["df"] for r in rows], np.float64)
    weights = np.log((n - df + 0.5) / (df + 0.5) + 1) * np.array([r["times"] for r in rows], np.float64)
    begins = np.searchsorted(of_term, np.arange(len(terms) + 1))
    vocabulary, names = pa.array(list(terms), pa.string()), list(queries)

    def best(pool: pa.Table) -> pa.Table:
        """What can be among the k best; of equal scores the k first."""
        pool = pool.take(pc.sort_indices(pool, [("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
        q, score = pool["q"].to_numpy(), pool["score"].to_numpy()
        at = np.arange(len(q))
        own = np.flatnonzero(np.diff(q, prepend=-1))
        first = np.repeat(own, np.diff(np.append(own, len(q))))
        equal = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(score, prepend=-1) != 0))
        place = at - np.repeat(equal, np.diff(np.append(equal, len(q))))
        last = np.minimum(first + k - 1, np.repeat(np.append(own[1:], len(q)) - 1, np.diff(np.append(own, len(q)))))
        # with fewer than k rows all stay
        least = np.where(last - first == k - 1, score[last] - MARGIN, 0.0)
        return pool.filter(pa.array((place < k) & (score >= least)))

    def score(batches):
        pool, fresh = None, 0
        least = np.zeros(len(names))
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            step = max(1, min(1000, HELD // max(len(names), 1)))
            for begin in range(0, len(batch) if names else 0, step):
                part = lists.slice(begin, step)
                length = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                code = pc.index_in(part.flatten(), value_set=vocabulary)
                doc = np.repeat(np.arange(len(part)), length)
                held = code.is_valid().to_numpy(zero_copy_only=False)
                keys, tf = np.unique(doc[held] * len(terms) + code.drop_null().to_numpy(), return_counts=True)
                if not len(keys):
                    continue
                doc, term = keys // len(terms), keys % len(terms)
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
                # entries in steps, each for all questions of its term
                size = np.cumsum(begins[term + 1] - begins[term])
                scores = np.zeros(len(part) * len(names))
                cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1], HELD)), len(size)))
                for a, z in zip(np.append(0, cuts[cuts > 0][:-1]), cuts[cuts > 0]):
                    some = term[a:z]
                    times = begins[some + 1] - begins[some]
                    entry = np.repeat(np.arange(a, z), times)
                    use = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + begins[term[entry]]
                    np.add.at(scores, doc[entry] * len(names) + of_query[use], weights[use] * impact[entry])
                found = np.flatnonzero((scores > 0) & (scores.reshape(len(part), -1) >= least).ravel())
                new = pa.table({"q": found % len(names), "id": ids.slice(begin, step).take(pa.array(found // len(names))), "score": scores[found]})
                pool, fresh = new if pool is None else pa.concat_tables([pool, new]), fresh + len(new)
                if fresh > HELD // 4:
                    pool, fresh = best(pool).combine_chunks(), 0
                    q = pool["q"].to_numpy()
                    many = np.bincount(q, minlength=len(names)) >= k
                    ends = np.searchsorted(q, np.arange(len(names))) + k - 1
                    least[many] = pool["score"].to_numpy()[ends[many]] - MARGIN
        if pool is not None and len(pool):
            pool = best(pool).combine_chunks()
            q = pa.array([names[i] for i in pool["q"].to_pylist()], query_type)
            yield from pa.table({"query_id": q, "id": pool["id"], "score": pool["score"]}).to_batches()

    query_type = to_arrow_type(asked.schema["query_id"].dataType)
    return words.mapInArrow(score, f"query_id {types['query_id']}, id {types['id']}, score double")


#: Questions whose vectors are sent to every task at a time.
QUESTION_BLOCK = 5000


def vector_top_k(vectors: DataFrame, questions: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by cosine; questions (query_id, vector) go to the vectors in blocks of bounded size."""
    asked = stored(questions.select("query_id", "vector"))
    blocks = max(1, -(-asked.count() // QUESTION_BLOCK))
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        pairs = rows.crossJoin(F.broadcast(part))
        part = ranked(pairs.select("query_id", "id", F.round(T.cosine(F.col("v"), F.col("vector")), DIGITS).alias("score")), k)
        out = part if out is None else out.unionByName(part)
    return out


def fuse(lists: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (source, query_id, id, score, rank): score, rank, component scores and ranks, number of sources."""
    weight = F.lit(1.0) if weights is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("source")), F.lit(1.0))
    out = lists.groupBy("query_id", "id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), DIGITS).alias("score"),
        F.countDistinct("source").alias("sources"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "score")))).alias("scores"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "rank")))).alias("ranks"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def blend(semantic: DataFrame, lexical: DataFrame, semantic_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """semantic score * weight + min-max BM25 * weight; rows only BM25 has are dropped, a range of zero gives 0."""
    w = Window.partitionBy("query_id")
    span = F.max("score").over(w) - F.min("score").over(w)
    scaled = lexical.select("query_id", "id", F.when(span > 0, (F.col("score") - F.min("score").over(w)) / span).otherwise(0.0).alias("lexical"))
    joined = semantic.select("query_id", "id", F.col("score").alias("semantic")).join(scaled, ["query_id", "id"], "left")
    return joined.select("query_id", "id", F.round(F.col("semantic") * semantic_weight + F.coalesce("lexical", F.lit(0.0)) * lexical_weight, DIGITS).alias("score"))


def key_search(keys: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Chunks that share a key with a question: (id, key) and (query_id, key); most shared keys first, score 1 / rank."""
    shared = questions.join(keys, "key").groupBy("query_id", "id").agg(F.countDistinct("key").alias("shared"))
    return ranked(shared, k, "shared").withColumn("score", F.round(1.0 / F.col("rank"), DIGITS))


def per_document(results: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """Best k rows of each (query, document), documents below `least` dropped; document_rank by best score."""
    own = Window.partitionBy("query_id", "file_name")
    rows = results.withColumn("best", F.max("score").over(own)).filter(F.col("best") >= least)
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return rows.withColumn("document_rank", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "file_name")))


def feedback_rerank(results: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """15 % up for each point to 5 that users gave a source, 10 % down for each lost to 3; never below 0."""
    rel = F.coalesce("relevance_score", F.lit(0.0))
    factor = F.when(rel > 0, 1 + 0.15 * F.least(rel, F.lit(5.0))).when(rel < 0, 1 - 0.10 * F.least(F.abs(rel), F.lit(3.0))).otherwise(F.lit(1.0))
    return results.join(scores.select(*keys, "relevance_score"), keys, "left").withColumn("score", F.round(F.greatest(F.col("score") * factor, F.lit(0.0)), DIGITS)).drop("relevance_score")


def penalise(results: DataFrame, irrelevant: DataFrame, least: float = 0.2) -> DataFrame:
    """Halves rows whose (pattern, source_ref) users marked irrelevant and drops what falls below `least`."""
    marked = results.join(irrelevant.select("pattern", "source_ref").distinct().withColumn("bad", F.lit(True)), ["pattern", "source_ref"], "left")
    out = marked.withColumn("score", F.when(F.coalesce("bad", F.lit(False)), F.round(F.col("score") / 2, DIGITS)).otherwise(F.col("score")))
    return out.filter(~F.coalesce("bad", F.lit(False)) | (F.col("score") >= least)).drop("bad")


def context(results: DataFrame, n: int = 10) -> DataFrame:
    """Numbered sources of each query as one text, best first, at most n; bounded by n rows a query."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "file_name", F.lit(" p."), F.col("page_number").cast("string"), F.lit(" "), "section_number", F.lit(": "), "text")
    top = results.filter(F.col("rank") <= n)
    return top.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))["line"], "\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))


INTENTS = ("definition", "calculation", "reference", "table_lookup", "general")
#: Weights of the lists by intent.
WEIGHTS = {"definition": (0.6, 0.2, 0.1, 0.1), "calculation": (0.3, 0.3, 0.1, 0.3), "reference": (0.2, 0.3, 0.4, 0.1), "table_lookup": (0.2, 0.4, 0.1, 0.3), "general": (0.5, 0.3, 0.1, 0.1)}
TURKISH = ("ve", "ile", "nedir", "için", "hangi", "kaç")


def analyse(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds language, numbers, units, references, intent, keywords and weights of each question."""
    q = F.coalesce(F.col(text_col), F.lit(""))
    low, words = T.folded(q), T.tokens(q)
    found = patterns.quantities(q)
    numbers = F.transform(F.regexp_extract_all(q, F.lit(r"(?:^|[^A-Za-z0-9.,])([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)), T.number)
    out = questions.withColumns(
        {
            "language": F.when(low.rlike("[ğışİ]") | (F.size(F.filter(words, lambda w: w.isin(*TURKISH))) >= 2), "tr").otherwise("en"),
            "numbers": numbers,
            "units": F.array_distinct(F.transform(found, lambda x: x["unit"])),
            "references": F.array_distinct(F.transform(patterns.standards(q), patterns.canonical)),
            "keywords": F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*T.QUESTION_WORDS))),
        }
    )
    table_words = F.size(F.filter(words, lambda w: w.isin("table", "row", "column", "value", "rating")))
    intent = (
        F.when(low.rlike(r"\b(what is|define|definition|meaning)\b") & (F.size("numbers") == 0), "definition")
        .when(low.rlike(r"\b(calculate|compute|how many|how much|sum)\b"), "calculation")
        .when(F.size("references") > 0, "reference")
        .when(((F.size("numbers") > 0) & (F.size("units") > 0) & (table_words > 0)) | (table_words >= 2), "table_lookup")
        .otherwise("general")
    )
    names = ("vector", "bm25", "metadata", "entity")
    weights = F.create_map(*[x for i in INTENTS for x in (F.lit(i), F.create_map(*[y for n, w in zip(names, WEIGHTS[i]) for y in (F.lit(n), F.lit(w))]))])
    return out.withColumn("intent", intent).withColumn("weights", F.element_at(weights, F.col("intent")))


def expand(questions: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """Adds expanded: the question and up to `most` synonyms it lacks, of the longest key it holds.  synonyms: (key, words)."""
    low = T.folded(F.col("text"))
    held = questions.select("query_id", low.alias("low")).join(F.broadcast(synonyms), F.contains("low", F.col("key")))
    best = held.groupBy("query_id").agg(F.max_by(F.struct("low", "words"), F.struct(F.length("key"), F.col("key"))).alias("hit"))
    new = F.slice(F.filter("hit.words", lambda w: ~F.contains(F.col("hit.low"), w)), 1, most)
    return questions.join(best.select("query_id", new.alias("added")), "query_id", "left").withColumn("expanded", F.concat_ws(" ", "text", F.array_join(F.coalesce("added", F.array().cast("array<string>")), " ")))


def validate(questions: DataFrame, least: int = 1, most: int = 5000) -> Column:
    return F.length(F.trim("text")).between(least, most)


FOLLOW_UPS = (("cable", "Which cable sizes apply?", "How are cables supported?"), ("luminaire", "Which light levels apply?", "Where are luminaires placed?"), ("standard", "Which edition applies?", "What does it replace?"))


def follow_ups(answers: DataFrame, most: int = 3) -> DataFrame:
    """(id, questions): two questions for the first keyword an answer holds, and one on its best document, at most `most`."""
    low = F.lower("answer")
    own = F.array().cast("array<string>")
    for word, *asked in reversed(FOLLOW_UPS):
        own = F.when(F.contains(low, F.lit(word)), F.array(*[F.lit(q) for q in asked])).otherwise(own)
    return answers.select("id", F.slice(F.concat(own, F.array(F.concat(F.lit("What else does "), "file_name", F.lit(" say?")))), 1, most).alias("questions"))


def from_templates(templates: list[str], words: DataFrame) -> DataFrame:
    """(focus, question): each template with each focus word in the place of {focus}."""
    out = None
    for t in templates:
        part = words.select("focus", F.replace(F.lit(t), F.lit("{focus}"), F.col("focus")).alias("question"))
        out = part if out is None else out.unionByName(part)
    return out


#: Words, words that rule it out, parameter types; the first row that fits decides.
FOCUS_TYPES = ((("widget", "gear"), ("hot",), ("current", "area")), (("bolt", "ring"), (), ("area",)), (("hot",), (), ("illuminance",)))
ALL_TYPES = ("current", "area", "illuminance")


def focus_types(text: Column) -> Column:
    """Parameter types that a focus text asks for: none without text, a broad set where no rule fits."""
    low = F.lower(text)
    any_of = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)) if ws else F.lit(False)
    out = F.array(*[F.lit(t) for t in ALL_TYPES])
    for words, without, types in reversed(FOCUS_TYPES):
        out = F.when(any_of(words) & ~any_of(without), F.array(*[F.lit(t) for t in types])).otherwise(out)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(out)


def adaptive_weights(analysed: DataFrame) -> DataFrame:
    """(query_id, weights, sources) of analysed questions: weights by source that sum to 1, and the sources that the question calls for.

    Vector and BM25 lists always count; metadata where the question names a
    standard, entities where it holds a quantity.  A question on a reference gives
    metadata half as much again and entities a third as much again.
    """
    raised = F.transform_values("weights", lambda s, w: F.when(F.col("intent") == "reference", w * F.when(s == "metadata", 1.5).when(s == "entity", 1.3).otherwise(1.0)).otherwise(w))
    total = F.aggregate(F.map_values("raised"), F.lit(0.0), lambda a, w: a + w)
    called = F.array_compact(F.array(F.lit("vector"), F.lit("bm25"), F.when(F.size("references") > 0, "metadata"), F.when(F.size("units") > 0, "entity")))
    rows = analysed.select("query_id", raised.alias("raised"), called.alias("sources")).withColumn("total", total)
    return rows.select("query_id", F.transform_values("raised", lambda s, w: w / F.col("total")).alias("weights"), "sources")


def hybrid(lists: DataFrame, weights: DataFrame, k: int = 10, smooth: int = 60) -> DataFrame:
    """(query_id, id, score, sources, rank): the k best rows of each question over its own lists, with its own weights.

    lists: (source, query_id, id, rank); weights as from adaptive_weights.  Lists
    that a question doesn't call for don't count; a question without weights has no rows.
    """
    rows = lists.join(weights.withColumnRenamed("sources", "called"), "query_id").filter(F.array_contains("called", F.col("source")))
    part = F.element_at("weights", F.col("source")) / (smooth + F.col("rank"))
    return ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.countDistinct("source").alias("sources")), k)


def routed(results: DataFrame, questions: DataFrame, k: int = 10, own: int = 3, least: float = 0.3) -> DataFrame:
    """(query_id, route, id, score, rank): questions without a filter take the best rows of each document, those with one the k best rows of that document.

    questions: (query_id, file_name); a null file_name is no filter.
    """
    rows = results.drop("rank").join(questions.select("query_id", F.col("file_name").alias("wanted")), "query_id")
    apart = per_document(rows.filter("wanted IS NULL"), own, least).select("query_id", F.lit("documents").alias("route"), "id", "score", "rank")
    kept = ranked(rows.filter("file_name = wanted"), k).select("query_id", F.lit("filtered").alias("route"), "id", "score", "rank")
    return apart.unionByName(kept)


# What an answer says that found nothing.
NOTHING_FOUND = ("does not contain", "no information", "not mentioned", "cannot find", "not found", "no relevant", "doesn't provide", "not available")


def informative(answer: Column, shortest: int = 20) -> Column:
    """Whether an answer is long enough and doesn't say that nothing was found; null isn't."""
    text = F.coalesce(F.trim(answer), F.lit(""))
    return (F.length(text) >= shortest) & ~F.exists(F.array(*[F.lit(p) for p in NOTHING_FOUND]), lambda p: F.contains(F.lower(text), p))
