"""Search with a stored index against search without one: equal rows for BM25, measured recall for vectors."""

import math
import random
import re
from collections import Counter

import numpy as np

from doclens.operators import impact_index, retrieval, vector_index
from doclens.plans.retrieval import _lists
from doclens.sources.store import stored

DOCS = "doc_id long, text string"


def drawn(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_pruned_search_equals_bm25_and_reads_less(spark, monkeypatch):
    monkeypatch.setattr(impact_index, "QUESTIONS", 7)
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [(i, drawn(rng, rng.randint(1, 60), words)) for i in range(1500)] + [(2000, ""), (2001, None), (2002, "w1"), (2003, "w1")]
    asked = [(q, drawn(rng, 6, words)) for q in range(25)] + [(100, "nowhere"), (101, ""), (102, "w1 w1 w1"), (103, " ".join(f"rare{i}" for i in range(3)))]
    texts += [(3000 + i, f"rare{i % 3} " + drawn(rng, 5, words)) for i in range(9)]
    docs, questions = spark.createDataFrame(texts, DOCS), spark.createDataFrame(asked, "query_id long, text string")
    want = sorted(tuple(r) for r in retrieval.bm25(docs, questions, 5).collect())
    index, places, n = impact_index.build(docs, shard=400)
    best, work = impact_index.search(index, places, n, questions, 5)
    assert sorted(tuple(r) for r in best.select("query_id", "id", "score", "rank").collect()) == want and n == len(texts)
    counted = work.collect()
    read, held = sum(r["read"] for r in counted), sum(r["held"] for r in counted)
    assert 0 < read < 0.6 * held and all(r["read"] <= r["held"] for r in counted)
    empty = impact_index.build(docs.limit(0))
    assert impact_index.search(*empty, questions)[0].count() == 0


def test_the_index_is_made_by_moving_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(impact_index, "stored", lambda df, *how: seen.append(df) or stored(df, *how))
    monkeypatch.setattr(impact_index, "WORDS", 40)
    rng = random.Random(2)
    texts = [(f"d{i:03d}", drawn(rng, i % 7, ["a", "b", "c", "d"])) for i in range(60)] + [("x", None)]
    docs, questions = spark.createDataFrame(texts, "doc_id string, text string"), spark.createDataFrame([(1, "a b"), (2, "c c e")], "query_id long, text string")
    index, places, n = impact_index.build(docs)
    # one table is stored, texts and not their words are shuffled, and more words make more shards
    (made,) = seen
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "Generate" not in plan and plan.index("regexp_extract_all") < plan.index("Repartition")
    assert n == 61 and index.select("shard").distinct().count() > 2 and places.count() == sum(bool(t) for _, t in texts)
    got = sorted(tuple(r) for r in impact_index.search(index, places, n, questions, 5)[0].select("query_id", "id", "score", "rank").collect())
    assert got == brute_bm25(texts, [(1, "a b"), (2, "c c e")], 5)


def test_recall_of_the_vector_index(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    monkeypatch.setattr(vector_index, "CHUNK", 10)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 24))
    data = middles[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    own = vector_index.usable(df, "vec_id", "embedding")
    assert own.count() == 4001
    model = vector_index.fit(own)
    index = vector_index.build(own, model)
    assert index.selectExpr("sum(size(ids))").first()[0] == 4001 and index.count() > len(model.centres) // 2
    asked = df.filter("vec_id % 20 = 0").select("vec_id", "embedding").toDF("query_id", "vector")
    found = {(r["query_id"], r["id"]) for r in vector_index.search(index, model, own, asked).collect()}
    exact = {(r["query_id"], r["id"]): r["score"] for r in retrieval.vector_top_k(df.filter("vec_id <> 5002"), asked.filter("query_id < 5000")).collect()}
    assert len(found & set(exact)) >= 0.9 * len(exact) > 0
    # all cells probed and many codes looked at: nothing is missed
    every = vector_index.search(index, model, own, asked.filter("query_id < 200"), probes=len(model.centres), looked_at=30).collect()
    assert {(r["query_id"], r["id"]): r["score"] for r in every} == {k: s for k, s in exact.items() if k[0] < 200}
    none = own.limit(0)
    assert vector_index.search(vector_index.build(none, vector_index.fit(none)), vector_index.fit(none), none, asked.limit(0)).count() == 0


def brute_bm25(texts, asked, k):
    words = {i: re.findall("[a-z0-9_]+", (t or "").lower()) for i, t in texts}
    mean, out = sum(map(len, words.values())) / len(words), []
    df = Counter(w for ws in words.values() for w in set(ws))
    for q, t in asked:
        terms, scores = Counter(re.findall("[a-z0-9_]+", (t or "").lower())), {}
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * c * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w, c in terms.items() if tf[w])
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        out += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_bm25_scores_texts_where_they_lie(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(500)]
    texts = [(f"d{i:04d}", drawn(rng, rng.randint(0, 30), words)) for i in range(300)]
    # copies tie: the smaller ids come first, and no task holds all of them
    texts += [(f"c{i:04d}", "w1 w2 copy") for i in rng.sample(range(900), 400)] + [("e1", None), ("e2", "")]
    rng.shuffle(texts)
    asked = [(q, drawn(rng, 5, words)) for q in range(12)] + [(50, "copy w1 copy"), (51, "nowhere"), (52, ""), (53, None)]
    docs, questions = spark.createDataFrame(texts, "doc_id string, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    want = brute_bm25(texts, asked, 4)
    got = lambda: sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in retrieval.bm25(docs, questions, 4).collect())
    assert got() == want
    monkeypatch.setattr(retrieval, "SCORED", 5)
    monkeypatch.setattr(retrieval, "HELD", 40)
    assert got() == want
    assert retrieval.bm25(docs.limit(0), questions).count() == 0 == retrieval.bm25(docs, questions.limit(0)).count()
    # neither texts nor entries are shuffled: only the window over the found rows is
    plan = retrieval.bm25(docs, questions)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_keys_of_questions_are_sent_to_the_documents(spark, tmp_path):
    spark.createDataFrame([(i, f"one two three w{i} four five six") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "one two three w3 four"), (1, "w5 four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = _lists(spark, str(tmp_path))
        assert "SortMergeJoin" not in lists._jdf.queryExecution().executedPlan().toString()
        assert {(r["query_id"], r["id"]) for r in lists.filter("source = 'keys' AND rank = 1").collect()} == {(0, 3), (1, 5)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
