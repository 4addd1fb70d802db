"""Small fixtures with expected rows, one group of tests per family."""

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.functions import patterns
from doclens.functions import text as T
from doclens.operators import compliance, entities, feedback, graph, retrieval, structure


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


# --- text and patterns


def test_tokens_and_ngrams(spark):
    assert one(spark, "The Cable-tray İs 5 mm", T.tokens(F.col("text"), ("cable-tray",))) == ["the", "cable", "tray", "is", "5", "mm"]
    assert one(spark, "a circuit breaker", T.tokens(F.col("text"), ("circuit breaker",))) == ["a", "circuit_breaker"]
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(T.ngrams(F.col("w"), 2)).collect()] == [["a_b", "b_c"], [], []]
    assert one(spark, None, T.tokens(F.col("text"))) == []


def test_standards_need_a_word_boundary(spark):
    assert one(spark, "this 5 and IS 3218, EN-50010 and IEC60364-1.", patterns.standards(F.col("text"))) == ["IS 3218", "EN-50010", "IEC60364-1"]
    assert one(spark, "en-50010", patterns.canonical(F.col("text"))) == "EN50010"


def test_quantities_end_their_units(spark):
    got = one(spark, "2,5 mm2 and 16 A, 230 V; 5 mA 3 Apples", patterns.quantities(F.col("text")))
    assert [(q["value"], q["unit"]) for q in got] == [(2.5, "mm2"), (16.0, "A"), (230.0, "V"), (5.0, "mA")]


@pytest.mark.parametrize("text,want", [("It shall not be used", "prohibited"), ("It shall be used", "mandatory"), ("It should", "recommended"), ("It may", "optional"), ("dismay", None)])
def test_strength(spark, text, want):
    assert one(spark, text, patterns.strength(F.col("text"))) == want


def test_query_pattern_and_source_ref(spark):
    assert one(spark, "What is the rating of a big cable tray?", T.query_pattern(F.col("text"))) == "rating big cable tray"
    df = spark.createDataFrame([("My Spec.pdf", "1.2")], "f string, s string")
    assert df.select(T.source_ref(F.col("f"), F.col("s"))).first()[0] == "MySpec#1.2"


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


# --- structure

MD = "intro\n# 1 Scope\nfirst\n## 1.1 Cables\nsecond\nthird\n# 2 Tests\n### 2.0.1 Deep\nlast"


def test_sections_and_paths(spark):
    docs = spark.createDataFrame([("d", MD), ("e", None)], "doc_name string, text string")
    parts = structure.sections(docs)
    got = {(r["doc"], r["section"]): (r["level"], r["number"], r["title"], r["content"]) for r in parts.collect()}
    assert got[("d", 0)] == (0, "", "", "intro") and got[("d", 2)] == (2, "1.1", "Cables", "second\nthird") and got[("e", 0)] == (0, "", "", "")
    paths = {r["section"]: r["path"] for r in structure.section_paths(parts).collect()}
    assert paths == {1: "Scope", 2: "Scope > Cables", 3: "Tests", 4: "Tests > Deep"}
    assert structure.deepest(structure.section_paths(parts)).first()["path"] == "Tests > Deep"


def test_chunks_overlap_and_cover(spark):
    docs = spark.createDataFrame([(1, " ".join(str(i) for i in range(300))), (2, "one"), (3, ""), (4, None)], "doc_id long, text string")
    rows = structure.chunks(docs, "doc_id", 100, 20, (200,)).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["begin"], r["n_tokens"], r["parent_200"]) for r in rows] == [(1, 0, 100, 0), (1, 80, 100, 0), (1, 160, 100, 0), (1, 240, 60, 1), (2, 0, 1, 0)]


def test_markdown_tables(spark):
    text = "x\nTable 3: Sizes\n| Item | Length | Note |\n|---|:--|---|\n| a | 5 mm | 1-2 |\n| b | 7 mm |\nend\n| lonely |\n"
    tables = structure.markdown_tables(spark.createDataFrame([("d", text)], "doc_name string, text string"))
    r = tables.collect()
    assert len(r) == 1 and r[0]["caption"] == "Table 3: Sizes" and r[0]["rows"] == [["a", "5 mm", "1-2"], ["b", "7 mm", ""]]
    cells = {(c["row_no"], c["column_no"]): (c["data_type"], c["value"], c["unit"]) for c in structure.table_cells(tables).collect()}
    assert cells[(0, 1)] == ("quantity", 5.0, "mm") and cells[(0, 2)] == ("range", None, None) and cells[(1, 2)][0] == "text"
    s = structure.table_summary(tables).first()
    assert (s["table_type"], s["n_rows"], s["ranges"]) == ("dimension", 2, "Length: 5-7")
    assert structure.table_sentences(tables).orderBy("row_no").first()["sentence"] == "a: Length = 5 mm, Note = 1-2"


def test_name_metadata(spark):
    files = spark.createDataFrame([("EN_50001-2019_cable_rules.pdf",), ("notes.txt",)], "file_name string")
    assert [tuple(r)[1:] for r in structure.name_metadata(files).collect()] == [("EN 50001", "2019", "Cable Rules"), (None, None, "Notes")]


def test_index_pages_and_toc(spark):
    pages = spark.createDataFrame([("d", 1, "Table of Contents\n1 Scope ..... 3\n1.2 Cables and trays .... 17\nno line"), ("d", 30, "contents"), ("d", 2, "\n".join(f"{i} line" for i in range(12))), ("d", 3, "text")], "doc string, page_number int, text string")
    hits = structure.index_pages(pages)
    assert sorted(r["page_number"] for r in hits.collect()) == [1, 2]
    assert [tuple(r) for r in structure.toc_elements(hits).collect()] == [("d", "1", "Scope", 3), ("d", "1.2", "Cables and trays", 17)]


def test_carried_forward(spark):
    pages = spark.createDataFrame([("d", 1, None), ("d", 2, "1"), ("d", 3, ""), ("d", 4, "2"), ("e", 1, None)], "doc string, p int, s string")
    got = pages.select("doc", "p", structure.carried_forward(pages, "s", "doc", "p").alias("x")).orderBy("doc", "p")
    assert [r["x"] for r in got.collect()] == [None, "1", "1", "2", None]


# --- entities

BLOCK = "The cable shall be rated 16 A in accordance with EN 50010. See Section 4.2 and Annex B. This standard supersedes BS 5000."


def chunks_of(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "f", f"{i}.1", "title", i, i, t) for i, t in enumerate(texts)], "chunk_id string, file_name string, section_number string, section_title string, page_number long, pos long, text string")


def test_entities_of_a_block(spark):
    c = chunks_of(spark, BLOCK)
    assert {(r["key"], r["start"]) for r in entities.standards(c).collect()} == {("EN50010", BLOCK.index("EN 5")), ("BS5000", BLOCK.index("BS 5"))}
    q = entities.quantities(c, 5).first()
    assert (q["value"], q["unit"], q["start"], q["context"]) == (16.0, "A", BLOCK.index("16 A"), "ated 16 A in a")
    assert {(r["kind"], r["number"]) for r in entities.section_references(c).collect()} == {("section", "4.2"), ("annex", "B")}
    assert {(r["dst"], r["type"]) for r in entities.typed_edges(c).collect()} == {("EN50010", "REQUIRES"), ("BS5000", "SUPERSEDES")}
    assert [r["strength"] for r in entities.requirements(c).collect()] == ["mandatory"]
    m = entities.flat_metadata(c).first()
    assert m["has_mandatory_requirements"] and m["spec_values"] == ["16 A"] and m["entities_count"] == 4


def test_rules_bullets_and_claims(spark):
    c = chunks_of(spark, "The conductor shall have 4 mm2 at least. Nothing here at all.", "short 5")
    assert [r["rule_text"] for r in entities.mine_rules(c).collect()] == ["The conductor shall have 4 mm2 at least"]
    a = spark.createDataFrame([(1, "Intro\n- one (My Spec, 1.2)\n* two\nend with 30 A of current here")], "id long, text string")
    assert [(r["pos"], r["source"]) for r in entities.bullets(a).collect()] == [(1, "MySpec#1.2"), (2, None)]
    assert [r["claim"] for r in entities.claims(a).collect()] == ["end with 30 A of current here"]


def test_unstored_rules(spark):
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 3, "y")], "source_doc string, pos int, rule_text string")
    assert [tuple(r) for r in entities.unstored(new, new.filter("rule_text = 'y'")).select("source_doc", "rule_text").collect()] == [("a", "x")]


# --- retrieval


def test_bm25_equals_recomputation(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    asked = [(0, "w1 w2 w2"), (1, "w9 nothing")]
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 100).collect()}
    tf = {i: Counter(t.split()) for i, t in docs}
    mean = sum(map(lambda d: len(d[1].split()), docs)) / len(docs)
    want = {}
    for q, text in asked:
        for i, counts in tf.items():
            score, length = 0.0, sum(counts.values())
            for w in text.split():
                df = sum(w in c for c in tf.values())
                if counts[w]:
                    score += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * length / mean))
            if score > 0:
                want[(q, i)] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


LISTS = [("a", "doc1", 1), ("a", "doc2", 2), ("a", "doc3", 3), ("b", "doc1", 1), ("b", "doc2", 2), ("b", "doc4", 2 + 1), ("c", "doc5", 1), ("c", "doc1", 2)]


@settings(max_examples=5, deadline=None)
@given(st.permutations(LISTS))
def test_fusion_order_does_not_depend_on_the_order_of_lists(spark, rows):
    df = spark.createDataFrame([(s, 0, i, 1.0, r) for s, i, r in rows], "source string, query_id long, id string, score double, rank int")
    got = [r["id"] for r in retrieval.fuse(df).orderBy("rank").collect()]
    assert got == ["doc1", "doc2", "doc5", "doc3", "doc4"]


def test_blend_and_rerank(spark):
    sem = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4)], "query_id long, id string, score double")
    lex = spark.createDataFrame([(0, "a", 3.0), (0, "c", 9.0)], "query_id long, id string, score double")
    assert {r["id"]: r["score"] for r in retrieval.blend(sem, lex).collect()} == {"a": 0.35, "b": 0.28}
    scores = spark.createDataFrame([("a", 10.0), ("b", -10.0)], "id string, relevance_score double")
    assert {r["id"]: r["score"] for r in retrieval.feedback_rerank(sem, scores, ["id"]).collect()} == {"a": 0.875, "b": 0.28}


def test_query_analysis(spark):
    asked = spark.createDataFrame([(0, "What is bonding?"), (1, "Calculate 2,5 mm2 load"), (2, "see EN-50010 please"), (3, "table row for 16 A"), (4, "EN nedir ve hangi"), (5, None)], "query_id long, text string")
    got = {r["query_id"]: (r["intent"], r["language"], r["numbers"]) for r in retrieval.analyse(asked).collect()}
    assert got[0][0] == "definition" and got[1][0] == "calculation" and got[1][2] == [2.5] and got[2][0] == "reference" and got[3][0] == "table_lookup" and got[4][1] == "tr" and got[5][0] == "general"


def test_expansion_takes_the_longest_key(spark):
    syn = spark.createDataFrame([("cable", ["wire", "lead"]), ("cable tray", ["ladder", "cable run", "duct", "rack"])], "key string, words array<string>")
    asked = spark.createDataFrame([(0, "size of Cable tray duct"), (1, "nothing")], "query_id long, text string")
    assert [r["expanded"] for r in retrieval.expand(asked, syn).orderBy("query_id").collect()] == ["size of Cable tray duct ladder cable run rack", "nothing "]


# --- compliance


def test_compared_values_and_summary(spark):
    values = spark.createDataFrame([("c1", "s", 1, "current", 10.0, "A", "cable", "1"), ("c2", "r", 2, "current", 16.0, "A", "cable", "1"), ("c3", "s", 3, "area", 4.0, "mm2", "x", "1"), ("c4", "r", 4, "area", 4.0, "mm2", "x", "1")], "chunk_id string, file_name string, pos long, type string, value double, unit string, subject string, section_number string")
    pairs = spark.createDataFrame([("s", "r")], "source_doc string, reference_doc string")
    rows = compliance.compared_values(values, pairs).collect()
    assert [(r["relation"], r["difference"], r["percentage"], r["severity"]) for r in rows] == [("LOWER", 6.0, 60.0, "critical")]
    found = spark.createDataFrame([("s", "critical"), ("s", "high"), ("s", "low"), ("t", "low")] + [("u", "critical")] * 6, "source_doc string, severity string")
    assert {r["source_doc"]: (r["score"], r["verdict"]) for r in compliance.summary(found).collect()} == {"s": (69, "partly"), "t": (99, "compliant"), "u": (0, "not compliant")}


def test_gaps_and_coverage(spark):
    c = chunks_of(spark, "The cable shall be of EN 50010.").withColumn("file_name", F.lit("r"))
    terms = spark.createDataFrame([("c0", "r", "EN50010"), ("x", "s", "EN1")], "chunk_id string, file_name string, term string")
    pairs = spark.createDataFrame([("s", "r")], "source_doc string, reference_doc string")
    assert [(r["chunk_id"], r["severity"]) for r in compliance.gaps(c, terms, pairs, 1).collect()] == [("c0", "high")]
    assert [r["key"] for r in compliance.coverage(terms.withColumnRenamed("term", "key"), pairs).collect()] == ["EN50010"]


def test_answer_checks(spark):
    a = spark.createDataFrame([(1, "the cable is rated", "know the cable is rated well"), (2, "other words stand here", "none"), (3, "ok", "x")], "id long, answer string, source string")
    assert {r["id"]: r["support"] for r in compliance.support(a).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    b = spark.createDataFrame([(1, "s"), (1, None), (2, None)], "id long, source string")
    assert {r["id"]: r["coverage"] for r in compliance.citation_coverage(b).collect()} == {1: 0.5, 2: 0.0}


# --- graph


def test_neighbours_keep_the_shortest_way(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "d", "X"), ("a", "c", "X")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["node"], r["hops"]) for r in graph.neighbours(e, start, 2).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_parents_and_strengthen(spark):
    s = spark.createDataFrame([("f", "1"), ("f", "1.2.3"), ("f", "1.2"), ("f", "4.1")], "file_name string, number string")
    assert {(r["number"], r["parent"]) for r in graph.parents(s).collect()} == {("1.2", "1"), ("1.2.3", "1.2")}
    old = spark.createDataFrame([("a", "b", "T", 0.95), ("c", "d", "T", 0.2)], "src string, dst string, type string, weight double")
    new = spark.createDataFrame([("a", "b", "T", 0.75), ("e", "f", "T", 0.7)], "src string, dst string, type string, confidence double")
    assert {(r["src"], r["weight"]) for r in graph.strengthen(old, new).collect()} == {("a", 1.0), ("c", 0.2), ("e", 0.7)}


# --- feedback


def test_co_occurrence_confidence(spark):
    pairs = [("b1", "IS3218"), ("b1", "NEK606"), ("b2", "IS3218"), ("b2", "NEK606"), ("b3", "IS3218"), ("b3", "NEK606"), ("b4", "IS3218"), ("b5", "NEK606")]
    got = feedback.co_occurrences(spark.createDataFrame(pairs, "basket string, document_name string")).collect()
    assert [tuple(r) for r in got] == [("IS3218", "NEK606", 3, 0.75)]


def test_quality_bounds(spark):
    rows = spark.createDataFrame([("a", "helpful", 5), ("b", "helpful", None), ("b", "irrelevant", 1)], "document_name string, rating string, stars int")
    assert {r["document_name"]: (r["quality"], r["avg_stars"]) for r in feedback.source_quality(rows).collect()} == {"a": (50.0, 5.0), "b": (50.0, 2.0)}


def test_health_and_cap(spark):
    rows = spark.createDataFrame([(i, i, c, ok) for i, (c, ok) in enumerate([("x", True), ("x", False), ("x", False), ("x", False), ("y", True), ("y", False), ("z", False), ("z", True)])], "id long, ts long, component string, ok boolean")
    assert {r["component"]: r["status"] for r in feedback.health(rows).collect()} == {"x": "unhealthy", "y": "degraded", "z": "healthy"}
    entries = spark.range(20).selectExpr("id AS key", "id AS last_access")
    assert sorted(r["key"] for r in feedback.kept_entries(entries, 10).collect()) == list(range(11, 20))


def test_cache_hits_do_not_renew(spark):
    from datetime import datetime, timedelta

    begin, rng = datetime(2024, 1, 1), random.Random(5)
    asked = [("a", m) for m in (0, 50, 100, 160, 219)] + [(rng.choice("bc"), rng.randint(0, 2000)) for _ in range(300)] + [(None, 0), (None, 60), (None, 119), ("d", None)]
    rows = [(i, k, None if m is None else begin + timedelta(minutes=m)) for i, (k, m) in enumerate(asked)]
    want, stored = {}, {}
    for i, k, ts in sorted(rows, key=lambda r: (r[2] or datetime.min, r[0])):
        want[i] = ts is not None and k in stored and ts - stored[k] < timedelta(minutes=60)
        if ts is not None and not want[i]:
            stored[k] = ts
    assert [want[i] for i in range(5)] == [False, True, False, False, True]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(5)
    got = {r["id"]: r["hit"] for r in feedback.cached(df).collect()}
    assert got == want
    assert feedback.cached(df.limit(0)).count() == 0


def test_history_search_finds_long_turns(spark, tmp_path):
    from doclens import plans

    rows = [(1, 0, "user", "the question"), (1, 1, "assistant", "x " * 4000 + "THE end"), (2, 0, "user", "nothing"), (2, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["n_chars"] for r in plans.queries()["history_search"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 12, (1, 1): 8007}
