"""Phrases by automata against a pattern for each phrase; cascades of rules."""

import random
import re

from doclens.operators import phrases as P


def brute(texts, words):
    out = {}
    for i, text in texts:
        for w in {w.lower() for w in words if w}:
            hits = [m.start() for m in re.finditer(rf"(?=\b{re.escape(w)}\b)", (text or "").lower())]
            if hits:
                out[(i, w)] = (len(hits), hits[0])
    return out


def test_whole_words_in_one_and_in_many_automata(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(["cat", "Cat", "s", " ", " ", "_", "é", "-", "fire alarm", "duct", "intro", ".", "3"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (92, "cat " * 50_000)]
    words = ["cat", "CAT", "cat cat", "fire alarm", "duct", "a", "s", "é", "", None, "3", "cat-", "-cat"] + [f"word{i}" for i in range(3000)]
    df, vocabulary = spark.createDataFrame([(i, t, "x") for i, t in texts], "id long, text string, phrase string"), spark.createDataFrame([(w,) for w in words], "phrase string")
    want = brute(texts, words)
    for most in (1 << 20, 9000):
        assert {(r["id"], r["phrase"]): (r["n"], r["start"]) for r in P.found(df, vocabulary, most_bytes=most).collect()} == want
    assert ((92, "cat") in want) and P.found(df, vocabulary.limit(0)).count() == 0 and P.found(df.limit(0), vocabulary).count() == 0


def test_topics(spark):
    df = spark.createDataFrame([(1, "The fire alarm and the duct"), (1, "fire alarm"), (2, "introduction")], "id long, text string")
    vocabulary = spark.createDataFrame([("fire alarm", "safety"), ("Fire Alarm", "safety"), ("fire alarm", "electrical"), ("duct", "air"), ("duct", None)], "phrase string, topic string")
    assert [tuple(r) for r in P.tags(P.found(df, vocabulary), vocabulary).collect()] == [(1, ["air", "electrical", "safety"], 3)]


def test_cascade(spark):
    rules = spark.createDataFrame(
        [(1, ["cable"], [], ["trench"], ["current", "area"]), (2, ["Cable", "duct"], ["deep"], None, ["depth"]), (3, None, ["motor", "panel"], [], ["power"]), (4, [], [], ["x"], ["never"])],
        "priority int, any array<string>, all array<string>, none array<string>, types array<string>",
    )
    texts = [(1, "a Cable"), (2, "cable in a trench"), (3, "cable, deep in a trench"), (4, "motor and panel"), (5, "motor"), (6, None), (7, "  "), (8, "cables"), (9, "panel motor cable")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: (r["priority"], r["types"]) for r in P.cascade(df, P.found(df, P.rule_terms(rules)), rules, ("all",)).collect()}
    every = (None, ["all"])
    assert got == {1: (1, ["current", "area"]), 2: every, 3: (2, ["depth"]), 4: (3, ["power"]), 5: every, 6: (None, []), 7: (None, []), 8: every, 9: (1, ["current", "area"])}
