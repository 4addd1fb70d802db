"""Documents as a stream into a versioned table: every batch once, whatever fails in between."""

from doclens.sources.versions import VersionedTable
from doclens.streaming import ingest

TEXT = "# 1 Scope\nCables per EN 50001.\n## 1.1 More\nSee EN 50002 and EN 50001."


def put(spark, folder, rows):
    spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, checkpoint):
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / checkpoint))
    return VersionedTable(spark, str(tmp_path / "table"))


def test_a_batch_that_comes_again_is_left_out(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [("a", TEXT), ("b", "no heading"), (None, TEXT), ("c", None), ("d", "")])
    table = run(spark, tmp_path, "one")
    assert sorted((r["chunk_id"], r["section_title"]) for r in table.rows("chunks").collect()) == [("a#1", "Scope"), ("a#2", "More"), ("b#0", "")]
    assert sorted((r["chunk_id"], r["key"]) for r in table.rows("standards").collect()) == [("a#1", "EN50001"), ("a#2", "EN50001"), ("a#2", "EN50002")]
    # a new checkpoint gives the same file under the same number, as after a failure behind the commit
    assert run(spark, tmp_path, "two").version() == table.version() == 1
    put(spark, str(tmp_path / "in"), [("e", "# 2 New\ntext")])
    table = run(spark, tmp_path, "two")
    assert table.version() == 2 and table.rows("chunks").count() == 4 and table.manifest()["batches"] == {"ingest": 1}
    # other commits keep the note, and a writer that lost the race finds it
    old = table.manifest(1)
    table.merge("chunks", fanout=2)
    assert table.manifest()["batches"] == {"ingest": 1}
    again = ingest.enriched(spark.createDataFrame([("e", "# 2 New\ntext")], ingest.DOCUMENTS))
    assert table.commit("ingest", old, add=again, batch=("ingest", 1)) == table.version() and table.rows("chunks").count() == 4
    assert table.rows("chunks", version=1).count() == 3
