"""Each stage of the pipeline on small documents, and all of them in a row."""

import random

import corpus_pipeline as cp
from tests.llm.test_ngram_join import shingles
from tests.llm.test_small_operators import check_packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, mix_size string, score string"


def documents(spark):
    rng = random.Random(4)
    words = {"en": [f"the{i}and" for i in range(200)], "de": [f"über{i}haus" for i in range(200)]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 60)))
        rows.append((i, text, lang, f"s{i % 3}"))
    base = rows[7][1].split()
    rows += [(100 + k, " ".join([*base[:-1], f"tail{k}"]), "en", "s0") for k in range(5)] + [(110, rows[7][1], "en", None)]
    rows += [(120, "1234 !!", "en", "s1"), (121, None, None, "s1"), (122, "", "de", "s2"), (123, rows[9][1] + " write to a@b.de now", None, "s1")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows], COLUMNS)


def test_stages(spark):
    docs = documents(spark)
    kept = cp.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in docs.collect()} - {120, 121, 122}
    assert kept.filter("lang IS NULL").count() == 0

    apart = cp.near_duplicates(spark, kept, "")
    assert apart.columns == docs.columns
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in kept.collect()}
    left = {r["doc_id"] for r in apart.collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in left for b in left if a < b)
    assert all(any(near(i, j) for j in sets if j < i) for i in ids - left)

    clean = {r["doc_id"]: r for r in cp.private_data(spark, apart, "").collect()}
    assert clean.keys() == left and all(len(r["text"]) == r["n_chars"] for r in clean.values())
    if 123 in clean:
        assert clean[123]["text"].endswith("write to <EMAIL> now")

    mixed = cp.mixture(spark, apart, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= left
    rows = cp.packed(spark, mixed, "").collect()
    check_packing(rows, 2048)
    assert sum(r["piece"] == 0 for r in rows) == mixed.count()


def test_run_writes_and_rereads_each_stage(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "private_data", "mixture", "packed"]


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_stages_on_repeats_nulls_and_clashing_names(spark):
    docs = documents(spark)
    base = docs.filter("doc_id = 7").first()
    rows = [(7, base["text"], None, "s0", 1, "m", "n"), (7, base["text"], "en", "s0", 1, "m", "n"), (None, base["text"], "en", None, None, "m", "n"), (5000, None, None, None, None, None, None), (5001, "", None, "s1", 0, None, "n"), (5002, base["text"] + " call +49 30 1234567 now", "en", "s1", 9, "m", "n")]
    docs = docs.union(spark.createDataFrame(rows, COLUMNS)).withColumns({"pii_spans": cp.F.lit(1), "component_id": cp.F.lit("c"), "h": cp.F.lit(2), "size": cp.F.lit(3)})
    kept = cp.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # rows with the smallest id all stay, so do null ids and rows without text; the near copy goes
    assert ids.count(7) == 3 and None in ids and 5000 in ids and 5001 in ids and 5002 not in ids
    clean = cp.private_data(spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = {r["doc_id"]: r for r in clean.collect()}
    assert found[5000]["text"] is None and found[5000]["n_chars"] is None and found[5001]["text"] == ""
    assert found[5002]["text"].endswith("call <PHONE> now") and found[5002]["size"] == 3
    assert cp.language_id(spark, docs, "").columns == docs.columns and cp.mixture(spark, docs, "").columns == docs.columns
