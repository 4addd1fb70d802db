"""Versions of a table: changes, old versions, two writers, merges; statistics of a live index against a rebuild."""

import pytest
from pyspark.sql import functions as F

from doclens.operators import retrieval
from doclens.operators.live_index import LiveIndex
from doclens.sources.versions import Conflict, VersionedTable

SCHEMA = "id long, file_name string, category string, `text` string"


def table(spark, tmp_path, n=12):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.ingest(spark.createDataFrame([(i, f"f{i % 3}", "Uncategorized", f"t{i}") for i in range(n)], SCHEMA))
    return t


def held(t, version=None):
    return sorted(tuple(r) for r in t.rows(version=version).collect())


def test_changes_and_old_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    first = held(t)
    assert t.ingest(spark.createDataFrame([], SCHEMA)) == 1 and held(t) == first  # not empty, so left alone
    t.delete(F.col("file_name") == "f1")
    t.update(F.col("file_name") == "f2", {"file_name": F.lit("g2"), "text": F.lit(5)})
    t.recategorise(spark.createDataFrame([("f0", "power"), ("g2", None), ("zz", "none")], "file_name string, category string"))
    t.append(spark.createDataFrame([(99, "new", "x", None)], SCHEMA))
    want = sorted([(i, "f0", "power", f"t{i}") for i in range(0, 12, 3)] + [(i, "g2", "Uncategorized", "5") for i in range(2, 12, 3)] + [(99, "new", "x", None)])
    assert held(t) == want and t.version() == 5
    assert held(t, 1) == first and len(held(t, 2)) == 8
    t.copy_to(str(tmp_path / "copy"))
    assert held(VersionedTable(spark, str(tmp_path / "copy"))) == want
    t.merge(fanout=2)
    assert held(t) == want and len(t.manifest()["segments"]) == 1 and not t.manifest()["marks"]
    assert held(t, 1) == first
    t.vacuum()
    assert held(t) == want
    t.ingest(spark.createDataFrame([(1, "a", "b", "c")], SCHEMA), force=True)
    assert held(t) == [(1, "a", "b", "c")]


def test_two_writers(spark, tmp_path):
    t, other = table(spark, tmp_path), VersionedTable(spark, str(tmp_path / "t"))
    base = other.manifest()
    t.update(F.col("id") < 6, {"text": F.lit("mine")})
    with pytest.raises(Conflict):
        other.update(F.col("id") < 3, {"text": F.lit("theirs")}, base)
    assert len(held(t)) == 12 and {r[3] for r in held(t) if r[0] < 6} == {"mine"}
    # appends don't conflict: the later one goes on behind the earlier, and a change that read before them does too
    base = t.manifest()
    other.append(spark.createDataFrame([(50, "n", "c", "x")], SCHEMA))
    t.delete(F.col("id") == 0, base)
    late = t.commit("append", base, add={"rows": spark.createDataFrame([(51, "n", "c", "y")], SCHEMA)})
    assert late == t.version() == 5
    assert {r[0] for r in held(t)} == {*range(1, 12), 50, 51}
    assert VersionedTable(spark, str(tmp_path / "none")).rows() is None


def test_live_index_has_the_statistics_of_a_rebuild(spark, tmp_path):
    texts = [(i, f"common word{i % 5} word{i % 7} " + "again " * (i % 3)) for i in range(60)] + [(60, ""), (61, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = LiveIndex(spark, str(tmp_path / "i"))
    assert index.postings() is None and index.size() == (0, 0.0)

    def same(live):
        entries = retrieval.postings(live, "doc_id")
        rows = lambda df: sorted(tuple(r) for r in df.select("term", "df", "cf").collect())
        assert rows(index.statistics()) == rows(retrieval.term_stats(entries))
        one = entries.select("id", "length").distinct().agg(F.count(F.lit(1)), F.avg("length")).first()
        assert index.size() == (one[0], one[1] or 0.0)
        assert sorted(tuple(r) for r in index.postings().collect()) == sorted(tuple(r) for r in entries.collect())

    for part in range(4):
        index.append(docs.filter(F.col("doc_id") % 4 == part))
    same(docs)
    index.delete(F.col("id") % 7 == 0)
    same(docs.filter("doc_id % 7 <> 0"))
    index.append(docs.filter("doc_id % 14 = 0"))
    index.merge(3)
    same(docs.filter("doc_id % 7 <> 0 OR doc_id % 14 = 0"))
    assert len({s["path"] for s in index.table.manifest()["segments"] if s["family"] == "postings"}) <= 2
