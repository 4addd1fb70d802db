import tempfile

from pyspark.sql import functions as F

from doclens.sources import files, store
from doclens.streaming import jobs


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_files_and_reports(spark):
    base = folder()
    with open(f"{base}/a b.md", "w") as f:
        f.write("# T\ntext")
    with open(f"{base}/c.bin", "w") as f:
        f.write("x")
    assert files.list_files(spark, base).count() == 1
    row = files.read_texts(spark, base).first()
    assert row["text"] == "# T\ntext" and row["document_name"].replace("%20", " ") == "a b"
    results = spark.createDataFrame([(1, "Q?", "ctx", ["s1", "s2"])], "query_id long, query string, context string, sources array<string>")
    assert files.markdown_report(results).first()["report"] == "# Q?\n\nctx\n\n## Sources\n\n1. s1\n2. s2"
    found = spark.createDataFrame([("d<1>", "TQ-001", "high", "r", "c&1")], "source_doc string, number string, severity string, reference_doc string, chunk_id string")
    report = files.html_report(found).first()["report"]
    assert "<h1>d&lt;1&gt;</h1>" in report and "c&amp;1" in report
    out = folder() + "/r"
    files.write_reports(files.html_report(found), out)
    assert spark.read.text(out).count() > 0


def test_toc_and_resolved_text(spark):
    base = folder()
    with open(f"{base}/t.json", "w") as f:
        f.write('{"document_name": "D", "elements": [{"type": "section", "title": "A", "page_number": 1}, {"identifier": "2", "title": "B"}]}')
    assert [(r["pos"], r["identifier"], r["title"]) for r in files.read_toc(spark, base).collect()] == [(0, None, "A"), (1, "2", "B")]
    df = spark.createDataFrame([("", "", '{"text": "n"}'), (None, "t", None), ("o", "t", None)], "original_text string, text string, node string")
    assert [r[0] for r in df.select(files.resolved_text()).collect()] == ["n", "t", "o"]


def test_store_replaces_only_its_documents(spark):
    path = folder() + "/s"
    rows = spark.createDataFrame([("a", 1, "Uncategorized"), ("b", 2, "X")], "file_name string, n int, category string")
    store.save(rows, path)
    store.save(rows.filter("n = 1"), path)  # left alone
    assert spark.read.parquet(path).count() == 2
    store.replace(spark.createDataFrame([("a", 9, "Y")], "file_name string, n int, category string"), path)
    assert {(r["file_name"], r["n"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}
    cats = spark.createDataFrame([("a", "new")], "file_name string, category string")
    assert {(r["file_name"], r["category"]) for r in store.recategorised(rows, cats).collect()} == {("a", "new"), ("b", "X")}


def events(spark, n, begin):
    kinds = F.array(*[F.lit(k) for k in ("purchase", "error", "view")])
    return spark.range(begin, begin + n).select(F.col("id").alias("event_id"), (F.timestamp_seconds(1704067200 + F.col("id") * 3600)).alias("ts"), (F.col("id") % 5).alias("user_id"), F.get(kinds, (F.col("id") % 3).cast("int")).alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") % 30).cast("string"), F.lit("}")).alias("props"))


def test_replay_equals_batch(spark):
    base = folder()
    for i in range(3):
        events(spark, 40, 40 * i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = jobs.as_feedback(jobs.event_stream(spark, f"{base}/in"))
    jobs.latest_into(jobs.running_scores(stream), f"{base}/out", f"{base}/cp", ["document_name"])
    got = {(r["document_name"], r["relevance_score"], r["n"]) for r in jobs.newest(spark, f"{base}/out", ["document_name"]).collect()}
    batch = jobs.running_scores(jobs.as_feedback(spark.read.parquet(f"{base}/in")))
    assert got == {(r["document_name"], r["relevance_score"], r["n"]) for r in batch.collect()}


def test_sessions_and_lifetimes(spark):
    base = folder()
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "k"), (2, "2024-01-01 00:10:00", "k"), (3, "2024-01-01 03:00:00", "k"), (4, "2024-01-03 00:00:00", "z")], "user_id long, t string, key string").selectExpr("1L AS user_id", "timestamp(t) AS ts", "key").coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp, key string").parquet(f"{base}/in")
    jobs.run_available(jobs.sessions(stream), f"{base}/s", f"{base}/c1")
    assert sorted(r["n"] for r in spark.read.parquet(f"{base}/s").collect()) == [1, 2]
    jobs.run_available(jobs.first_lookups(stream), f"{base}/d", f"{base}/c2")
    assert sorted(r["key"] for r in spark.read.parquet(f"{base}/d").collect()) == ["k", "z"]


def test_status_needs_failures_in_a_row(spark):
    base = folder()
    spark.createDataFrame([(i, c, ok) for i, (c, ok) in enumerate([("x", False), ("x", False), ("x", False), ("y", False), ("y", True), ("z", False)])], "id long, component string, ok boolean").selectExpr("id", "timestamp_seconds(id) AS ts", "component", "ok").coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("id long, ts timestamp, component string, ok boolean").parquet(f"{base}/in")
    jobs.status_into(stream, f"{base}/out", f"{base}/cp")
    assert {(r["component"], r["status"]) for r in jobs.status_of(spark, f"{base}/out").collect()} == {("x", "unhealthy"), ("y", "healthy"), ("z", "degraded")}


def test_a_run_of_failures_goes_on_from_batch_to_batch(spark):
    base = folder()
    schema = "id long, ts timestamp, component string, ok boolean"
    for batch, oks in enumerate([(True, False), (False,), (False,)]):
        rows = [(10 * batch + i, "x", ok) for i, ok in enumerate(oks)]
        spark.createDataFrame(rows, "id long, component string, ok boolean").selectExpr("id", "timestamp_seconds(id) AS ts", "component", "ok").coalesce(1).write.mode("append").parquet(f"{base}/in")
        jobs.status_into(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/cp")
        row = jobs.status_of(spark, f"{base}/out").first()
        assert (row["checks"], row["failed"], row["status"]) == (batch + 2, batch + 1, ("degraded", "degraded", "unhealthy")[batch])
