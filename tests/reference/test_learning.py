"""Learning after each response against a fold that counts anew each time."""

import random
from datetime import datetime, timedelta
from itertools import combinations

from doclens.operators import learning as L

SCHEMA = "basket string, ts timestamp, document_name string, n int, pairs string"


def brute(rows, days, support, least):
    times, documents = {}, {}
    for basket, ts, doc, *_ in rows:
        if None not in (basket, ts, doc):
            times[basket] = max(times.get(basket, ts), ts)
            documents.setdefault(basket, set()).add(doc)
    out, known, done = {}, set(), []
    for basket in sorted(times, key=lambda b: (times[b], b)):
        done.append(basket)
        held = [documents[b] for b in done if times[b] >= times[basket] - timedelta(days=days)]
        for pair in combinations(sorted(documents[basket]), 2):
            n = sum(set(pair) <= d for d in held)
            n1, n2 = (sum(x in d for d in held) for x in pair)
            good = n >= support and n / max(n1, n2) >= least
            out[(basket, *pair)] = (times[basket], n, n1, n2, round(n / max(n1, n2), 6), ("strengthened" if pair in known else "created") if good else None)
            known |= {pair} if good else set()
    return out


def got(spark, rows, days=7, support=3, least=0.6):
    return {(r["basket"], r["doc1"], r["doc2"]): (r["ts"], r["pairs"], r["n1"], r["n2"], r["confidence"], r["learned"]) for r in L.learned_pairs(spark.createDataFrame(rows, SCHEMA), days, support, least).collect()}


def test_rows_enter_and_leave(spark):
    rng, begin = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for i in range(200):
        # few distinct times, so that many are equal and some are exactly seven days apart
        at = begin + timedelta(hours=12 * rng.randint(0, 60))
        rows += [(f"b{i}", at, rng.choice("aaabcd"), i, "x") for _ in range(rng.randint(1, 4))]
    rows += [("b1", None, "z", 0, "x"), (None, begin, "a", 0, "x"), ("b2", begin, None, 0, "x"), *rows[:20]]
    want = brute(rows, 7, 3, 0.3)
    assert got(spark, rows, 7, 3, 0.3) == want and {v[-1] for v in want.values()} == {None, "created", "strengthened"}


def test_exactly_seven_days_count_and_a_moment_more_does_not(spark):
    begin = datetime(2024, 1, 1)
    for late, n in ((timedelta(0), 2), (timedelta(microseconds=1), 1)):
        rows = [(b, at, d, 0, None) for b, at in (("1", begin), ("2", begin + timedelta(days=7) + late)) for d in "ab"]
        assert got(spark, rows)[("2", "a", "b")][1] == n


def test_no_rows(spark):
    assert got(spark, []) == {} and L.learning_runs(L.learned_pairs(spark.createDataFrame([], SCHEMA))).collect() == []
