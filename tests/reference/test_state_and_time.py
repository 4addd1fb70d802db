"""Keyed state of the response cache against the sequential rule, over batches and a restart; newest entries as of each lookup."""

import random
from datetime import datetime, timedelta

from doclens.operators import asof, feedback
from doclens.streaming import cache_state

BEGIN = datetime(2024, 5, 1)


def sequential(rows, minutes=60):
    stored, out = {}, {}
    for id_, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in stored and ts - stored[key] < timedelta(minutes=minutes)
        if not hit:
            stored[key] = ts
        out[id_] = hit
    return out


def drawn(n, keys, step, seed):
    rng = random.Random(seed)
    rows, at = [], BEGIN
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, step, 5 * step]))
        rows.append((i, rng.choice(keys), at))
    return rows


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    rows = drawn(400, ["a", "a", "a", "b", "c"], 300, 3) + [(1000, "b", BEGIN + timedelta(days=9)), (1001, "a", BEGIN + timedelta(days=9, minutes=1)), (1002, "a", BEGIN + timedelta(days=9, minutes=61))]
    rows.sort(key=lambda r: (r[2], r[0]))
    df = lambda part: spark.createDataFrame(part, "id long, key string, ts timestamp").coalesce(1)
    source, out, checkpoint = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    for begin, end in ((0, 150), (150, 300), (300, 403)):
        df(rows[begin:end]).write.mode("append").parquet(source)
        cache_state.run_lookups(spark, source, out, checkpoint)  # each run is a restart from the checkpoint
    got = {r["id"]: r["hit"] for r in cache_state.judged(spark, out).collect()}
    assert got == sequential(rows)
    batch = {r["id"]: r["hit"] for r in feedback.cached(df(rows)).collect()}
    assert batch == got
    expired = spark.read.schema(cache_state.OUT).parquet(out).filter("kind = 'expired'").collect()
    assert expired and all(r["hit"] is None and r["lookups"] >= 1 for r in expired)


def test_batch_rule_on_one_hot_key(spark):
    rows = drawn(3000, ["hot", "hot", "hot", "cold"], 40, 4)
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(5)
    assert {r["id"]: r["hit"] for r in feedback.cached(df).collect()} == sequential(rows)
    exact = [(0, "k", BEGIN), (1, "k", BEGIN + timedelta(minutes=50)), (2, "k", BEGIN + timedelta(minutes=100)), (3, "k", BEGIN + timedelta(minutes=160)), (4, "k", BEGIN + timedelta(minutes=160)), (5, None, BEGIN), (6, None, BEGIN), (7, "k", None)]
    got = {r["id"]: r["hit"] for r in feedback.cached(spark.createDataFrame(exact, "id long, key string, ts timestamp")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_newest_entries_as_of_each_lookup(spark):
    rng = random.Random(9)
    moment = lambda: BEGIN + timedelta(hours=rng.randint(0, 600))
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    entries = [(i, vector(), moment()) for i in range(300)] + [(900, None, BEGIN), (901, vector(), None)]
    lookups = [(1000 + i, vector(), moment()) for i in range(120)] + [(5, entries[5][1], BEGIN + timedelta(days=30)), (1500, vector(), BEGIN - timedelta(days=1))]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    want = {}
    for q, v, at in lookups:
        usable = sorted((e for e in entries if e[1] and e[2] and e[2] < at), key=lambda e: (e[2], e[0]))[-20:]
        found = [(cosine(v, e[1]), -e[0]) for e in usable if e[2] > at - timedelta(days=7) and e[0] != q]
        if found and max(found)[0] >= 0.5:
            want[q] = (-max(found)[1], max(found)[0])
    schema = "{} long, vector array<double>, ts timestamp"
    got = asof.nearest_before(spark.createDataFrame(lookups, schema.format("query_id")).repartition(3), spark.createDataFrame(entries, schema.format("key")).repartition(3), 0.5, 20)
    assert {r["query_id"]: (r["key"], r["similarity"]) for r in got.collect()} == want and want
    assert got.limit(0).count() == 0 and asof.nearest_before(spark.createDataFrame([], schema.format("query_id")), spark.createDataFrame(entries, schema.format("key"))).count() == 0
