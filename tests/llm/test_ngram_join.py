import random
import re

import pytest

from doclens.llm import ngram_join as nj


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, bases = text(40), [text(rng.choice((8, 10, 13, 16, 20, 40, 120))) for _ in range(12)]
    big = text(60)
    docs = []
    for i in range(n):
        kind = rng.random()
        w = list(rng.choice(bases))
        if kind < 0.35:
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.6:
            w = list(big)
            for _ in range(rng.randint(0, 3)):
                w[rng.choice((0, 1, 2, 3, rng.randrange(len(w))))] = rng.choice(vocabulary)
        elif kind < 0.75:
            w = text(rng.randint(0, 30)) + passage + text(rng.randint(0, 6))
        elif kind < 0.9:
            w = text(rng.randint(0, 9))
        docs.append((i, " ".join(w).upper() if rng.random() < 0.3 else "\n".join(w)))
    return docs


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.similar_components(df).collect()}


@pytest.mark.parametrize("seed,short", [(1, 16), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(nj, "SHORT_LIST", short)
    docs = made(seed, 260, 3000)
    assert run(spark, docs) == brute(docs)


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "One  two"), (3, "one two three four"), (None, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in nj.similar_components(df).collect())
    assert got == [(-1, 1, 8), (3, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8)]
    assert nj.similar_components(df.limit(0)).count() == 0


def test_bounds_hold_for_all_small_sizes():
    for n in range(1, 40):
        for m in range(n, 60):
            need = nj.overlap_needed(n, m)
            assert 100 * need >= 85 * (n + m - need) and 100 * (need - 1) < 85 * (n + m - need + 1)
            assert (m in nj.partner_sizes(n)) == (need <= n)
