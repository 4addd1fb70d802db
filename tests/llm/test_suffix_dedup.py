import hashlib
import random

import numpy as np
import pytest

from doclens.llm import suffix_dedup as sd
from doclens.llm.common import Steps


def brute(docs, size=100):
    """docs: (id, text) in order of id, ids distinct."""
    seen, out = set(), {}
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - size + 1):
            w = data[at : at + size]
            if w in seen:
                gone[at : at + size] = True
            seen.add(w)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.dedup(df).collect()}


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(30) for _ in range(4)]
    base = text(150)
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            t = base
        elif kind < 0.45:
            words = base.split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = word()
            t = " ".join(words)
        elif kind < 0.8:
            t = text(rng.randint(0, 40)) + rng.choice(passages) + text(rng.randint(0, 40)) + rng.choice(passages)
        elif kind < 0.9:
            t = "ab" * rng.randint(0, 200)
        else:
            t = rng.choice(["", "x", "a" * 99, "a" * 100, "a" * 101, "\0" * 150])
        docs.append((i, t))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = made(seed) + [(1000, None)]
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("group_rows", [1, 4])
def test_large_groups_are_halved(spark, group_rows):
    docs = made(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = df.selectExpr("doc_id AS d", "0L AS tie", "text")
    got = {}
    for r in sd.repeated_spans(rows, Steps(spark), group_rows=group_rows).collect():
        got.setdefault(r["d"], []).append((r["start"], r["stop"]))
    want = brute(docs)
    for i, _ in docs:
        runs = sd.merged_spans(got.get(i, []))
        assert (sum(b - a for a, b in runs), len(runs)) == want[i][1:3]


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, "y" * 120)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in sd.dedup(df).collect())
    assert got == [(-1, 119), (5, 0), (5, 0), (7, 300)]
    assert sd.dedup(df.limit(0)).count() == 0


def test_interval_tree_of_known_array():
    # suffixes of "banana": a, ana, anana, banana, na, nana
    assert sorted(sd.interval_tree(np.array([0, 1, 3, 0, 0, 2]), 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]
