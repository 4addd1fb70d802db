"""The trie of prefixes against one built turn by turn, and hashes of long lists."""

import hashlib
import random
import re
import zlib

from doclens.llm import order, prefix_trie
from doclens.llm.common import Steps

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    words = lambda p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], sum(not children[q] for q in under), sum((len(members[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


def test_trie_of_drawn_conversations(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(60), 1000, 1007, 77777]:
        for t in range(rng.choice([1, 2, 3, 5, 8, 9, 17])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", ""])))
    # copies of one conversation, with shared beginnings of all lengths
    rows += [(c, t, "user", f"turn {t} x" if t < 23 + c % 3 else f"{c}") for c in range(2000, 2024) for t in range(26)]
    assert built(spark, rows) == brute(rows)


def test_trie_of_nulls_ties_repeats_and_turnless_conversations(spark):
    rows = [(20, 0, "user", "a"), (21, None, None, "b"), (21, 1, "user", None), (21, 1, "assistant", "b"), (21, 1, "assistant", "b"), (22, 5, "user", "a"), (None, 0, "user", "x"), (43, 0, "user", "é  x"), (66, 0, "", ""), (67, 0, "u", "ser")]
    assert built(spark, rows) == brute(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 and c - c % 20 not in {20} for c in (43, 66, 67))
    assert built(spark, rows[:1]) == brute(rows[:1])
    assert built(spark, []) == []


def test_extra_columns_and_one_very_long_conversation(spark):
    rng = random.Random(12)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(150)] + [(6, t, "user", "a") for t in range(131)] + [(7, t, "user", "a") for t in range(131)]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], SCHEMA + ", pos int, name binary")
    assert sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str) == brute(rows)


def test_hash_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(order, "JOINED_ROWS", 7)
    df = spark.range(0, 1000, 1, 5).selectExpr("id", "IF(id % 3 = 0, 'x', 'y') g")
    got = {r["g"]: r["sha256"] for r in order.listed_sha256(df, "g", "id", Steps(spark)).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {"x": sha(range(0, 1000, 3)), "y": sha(i for i in range(1000) if i % 3)}
