"""What users' feedback says of sources, queries and relations; caches, history and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def delta(kind: Column) -> Column:
    """What one row of feedback adds to its source."""
    return F.when(kind == "positive", 1.0).when(kind == "negative", -0.5).otherwise(0.0)


def source_scores(rows: DataFrame, keys: tuple[str, ...] = ("document_name", "page_number")) -> DataFrame:
    """(keys, relevance_score, positive, negative, last_updated)."""
    kind = F.col("feedback_type")
    return rows.groupBy(*keys).agg(F.round(F.sum(delta(kind)), 6).alias("relevance_score"), F.count_if(kind == "positive").alias("positive"), F.count_if(kind == "negative").alias("negative"), F.max("ts").alias("last_updated"))


def query_patterns(rows: DataFrame) -> DataFrame:
    kind = F.col("feedback_type")
    return rows.groupBy(F.lower(F.trim("query")).alias("query_normalized")).agg(F.count(F.lit(1)).alias("query_count"), F.count_if(kind == "positive").alias("positive"), F.count_if(kind == "negative").alias("negative"))


def relevance(rows: DataFrame) -> DataFrame:
    """(pattern, source_ref, relevant, irrelevant, relevance_score) of rows with query, document_name, page_number and rating."""
    good = F.col("rating") == "helpful"
    ref = T.source_ref(F.col("document_name"), F.col("page_number").cast("string"))
    return rows.groupBy(T.query_pattern(F.col("query")).alias("pattern"), ref.alias("source_ref")).agg(F.count_if(good).alias("relevant"), F.count_if(~good).alias("irrelevant"), F.round(F.avg(good.cast("int")), 6).alias("relevance_score"))


def irrelevant(scores: DataFrame, most: float = 0.3) -> DataFrame:
    return scores.filter(F.col("relevance_score") < most)


def source_quality(rows: DataFrame) -> DataFrame:
    """(document_name, helpful, not_helpful, irrelevant, total, avg_stars, quality): 50 for one rating, else 50 and ten for each helpful, less five or ten for the others, over all, within 0 and 100; missing stars are 3."""
    n = lambda r: F.count_if(F.col("rating") == r).alias(r)
    out = rows.groupBy("document_name").agg(n("helpful"), n("not_helpful"), n("irrelevant"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.coalesce("stars", F.lit(3))), 6).alias("avg_stars"))
    points = (10 * F.col("helpful") - 5 * F.col("not_helpful") - 10 * F.col("irrelevant")) / F.col("total")
    return out.withColumn("quality", F.when(F.col("total") == 1, 50.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + points)), 6)))


def positive_baskets(rows: DataFrame) -> DataFrame:
    """(basket, document_name): the documents that one user found good on one day; one row each."""
    return rows.filter("feedback_type = 'positive'").select(F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("basket"), "document_name").distinct()


def co_occurrences(baskets: DataFrame, support: int = 3, least: float = 0.6) -> DataFrame:
    """(doc1, doc2, pairs, confidence): pairs / the larger single count, for pairs in `support` baskets and more."""
    single = baskets.groupBy("document_name").agg(F.count(F.lit(1)).alias("n"))
    a, b = (baskets.select("basket", F.col("document_name").alias(d)) for d in ("doc1", "doc2"))
    pairs = a.join(b, "basket").filter("doc1 < doc2").groupBy("doc1", "doc2").agg(F.count(F.lit(1)).alias("pairs")).filter(F.col("pairs") >= support)
    n1, n2 = (single.select(F.col("document_name").alias(d), F.col("n").alias(n)) for d, n in (("doc1", "n1"), ("doc2", "n2")))
    out = pairs.join(n1, "doc1").join(n2, "doc2").withColumn("confidence", F.round(F.col("pairs") / F.greatest("n1", "n2"), 6))
    return out.filter(F.col("confidence") >= least).select("doc1", "doc2", "pairs", "confidence")


def keyword_documents(rows: DataFrame, support: int = 3, least: float = 0.6) -> DataFrame:
    """(keyword, document_name, n, confidence): documents that are found good for a keyword of over three letters; each row of feedback counts once."""
    words = rows.filter("feedback_type = 'positive'").select("feedback_id", "document_name", F.explode(F.array_distinct(F.filter(T.tokens(F.col("query")), lambda w: F.length(w) > 3))).alias("keyword"))
    each = words.groupBy("keyword", "document_name").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("keyword"))
    return each.withColumn("confidence", F.round(F.col("n") / total, 6)).filter((F.col("n") >= support) & (F.col("confidence") >= least))


def related(keywords: DataFrame, weight: float = 0.5) -> DataFrame:
    """RELATED_TO edges between documents that share a keyword."""
    a, b = (keywords.select("keyword", F.col("document_name").alias(d)) for d in ("src", "dst"))
    return a.join(b, "keyword").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("keywords")).withColumn("weight", F.lit(weight))


def statistics(rows: DataFrame) -> DataFrame:
    kind = F.col("feedback_type")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(kind == "positive").alias("positive"), F.count_if(kind == "negative").alias("negative"), F.round(F.count_if(kind == "positive") / F.count(F.lit(1)) * 100, 6).alias("satisfaction"), F.countDistinct("query").alias("queries"), F.round(F.avg("stars"), 6).alias("avg_stars"))


def best_sources(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("relevance_score"), *[c for c in ("document_name", "page_number") if c in scores.columns]).limit(k)


def cached(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """rows (id, key, ts) with hit: whether a lookup at ts finds its key stored less than `minutes` before; a miss stores it anew, a hit doesn't renew.

    Where a key rests for that long, what follows is a store in any case, so its
    lookups are cut there: sums by lifetime find the pauses, and no window sees a key's
    lookups.  Each run's distinct times, as numbers, are then folded in order.  Of
    lookups at one time the one with the least id is first, and ids are unique there.
    A lookup without a time misses and stores nothing; a null key is a key.
    """
    lifetime = minutes * 60_000_000
    # never null, so that null keys stand together
    key = F.concat(F.when(F.col("key").isNull(), "0").otherwise("1"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    ready = rows.withColumns({"__key": key, "__at": F.unix_micros(F.col("ts").cast("timestamp"))})
    times = ready.filter("__at IS NOT NULL").groupBy("__key", "__at").agg(F.min("id").alias("__id")).withColumn("__slot", F.floor(F.col("__at") / lifetime))
    slots = times.groupBy("__key", "__slot").agg(F.min("__at").alias("low"), F.max("__at").alias("high"))
    in_key = Window.partitionBy("__key").orderBy("__slot")
    pause = F.col("low") - F.lag("high").over(in_key) >= lifetime
    slots = slots.withColumn("__pause", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("__run", F.sum("__pause").over(in_key)).select("__key", "__slot", "__run")
    runs = times.join(slots, ["__key", "__slot"]).groupBy("__key", "__run").agg(F.sort_array(F.collect_list(F.struct("__at", "__id"))).alias("all"))
    step = lambda held, x: F.when((F.size(held) == 0) | (x["__at"] - F.element_at(held, -1)["__at"] >= lifetime), F.concat(held, F.array(x))).otherwise(held)
    kept = runs.select("__key", F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("x")).select("__key", "x.__at", "x.__id", F.lit(True).alias("__stores"))
    met = ready.join(kept, (ready["__key"] == kept["__key"]) & (ready["__at"] == kept["__at"]) & (ready["id"] == kept["__id"]), "left")
    hit = F.col("__stores").isNull() & F.col("ts").isNotNull()
    return met.select(*[ready[c] for c in rows.columns], hit.alias("hit"))


def cache_statistics(lookups: DataFrame) -> DataFrame:
    return lookups.agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"), F.countDistinct("key").alias("entries"), F.round(F.count_if("hit") / F.count(F.lit(1)) * 100, 6).alias("hit_rate"))


def kept_entries(entries: DataFrame, most: int = 1000, drop: float = 0.1) -> DataFrame:
    """Entries (key, last_access) after the size cap: above `most` the oldest tenth of the cap and the surplus go.

    The entries are counted first; a store within the cap is left as it is, of
    another one the newest are taken, which needs no order of all.
    """
    if entries.count() <= most:
        return entries
    return entries.orderBy(F.desc("last_access"), "key").limit(int(most * (1 - drop)))


def nearest_cached(questions: DataFrame, entries: DataFrame, least: float = 0.92, recent: int = 100, since=None) -> DataFrame:
    """(query_id, key, similarity): the best of the `recent` newest entries (key, vector, ts) for each question (query_id, vector), if it reaches `least`.

    Entries before `since` have outlived their lifetime and don't count.
    """
    entries = entries if since is None else entries.filter(F.col("ts") >= F.lit(since))
    newest = entries.orderBy(F.desc("ts"), "key").limit(recent)
    rows = questions.select("query_id", F.col("vector").alias("q")).crossJoin(F.broadcast(newest.select("key", "vector"))).withColumn("similarity", F.round(T.cosine(F.col("q"), F.col("vector")), 6))
    best = rows.filter(F.col("query_id") != F.col("key")).groupBy("query_id").agg(F.max_by(F.struct("key", "similarity"), F.struct("similarity", -F.col("key"))).alias("b"))
    return best.filter(F.col("b.similarity") >= least).select("query_id", F.col("b.key").alias("key"), F.col("b.similarity").alias("similarity"))


def history_statistics(rows: DataFrame) -> DataFrame:
    """Turns and characters of each role of a conversation log."""
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"), F.max("turn").alias("last_turn"))


def health(rows: DataFrame, failures: int = 3) -> DataFrame:
    """(component, checks, failed, status): unhealthy once the last `failures` checks failed, degraded if the last one did."""
    own = Window.partitionBy("component").orderBy(F.desc("ts"), F.desc("id"))
    last = rows.withColumn("n", F.row_number().over(own))
    bad = F.col("ok") == F.lit(False)
    out = last.groupBy("component").agg(F.count(F.lit(1)).alias("checks"), F.count_if(bad).alias("failed"), F.count_if(bad & (F.col("n") <= failures)).alias("recent"), F.count_if(bad & (F.col("n") == 1)).alias("newest"))
    status = F.when(F.col("recent") == failures, "unhealthy").when(F.col("newest") == 1, "degraded").otherwise("healthy")
    return out.select("component", "checks", "failed", status.alias("status"))


def recommendations(stats: DataFrame) -> DataFrame:
    """(store, advice) of stores with expired, entries, hit_rate, total and positive_rate."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("expired") > 100, "clear expired entries"),
            F.when((F.col("hit_rate") < 50) & (F.col("entries") > 10), "raise the lifetime of entries"),
            F.when((F.col("positive_rate") < 70) & (F.col("total") > 20), "review negative feedback"),
        )
    )
    return stats.select("store", F.explode(rules).alias("advice"))


def learn(rows: DataFrame, support: int = 3, least: float = 0.6, keyword_least: float = 0.6) -> DataFrame:
    """(src, dst, type, confidence): the edges that feedback suggests, COMPLEMENTS from pairs and RELATED_TO from shared keywords."""
    pairs = co_occurrences(positive_baskets(rows), support, least).select(F.col("doc1").alias("src"), F.col("doc2").alias("dst"), F.lit("COMPLEMENTS").alias("type"), "confidence")
    shared = related(keyword_documents(rows, support, keyword_least)).select("src", "dst", F.lit("RELATED_TO").alias("type"), F.col("weight").alias("confidence"))
    return pairs.unionByName(shared)
