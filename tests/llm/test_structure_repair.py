"""Repaired conversations against a search that tries all edits in order of cost, and whole rows against a plain rebuild."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from doclens.llm import structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute(codes):
    """(cost, audit): least over all ways, from the end to the front."""
    n = len(codes) // 2

    @cache
    def best(i, state, inserts=0):
        ways = [(0, "")] if i == n and state in ("", "a") else []
        given = "a" if state == "u" else "u"
        if inserts < 3:
            c, a = best(i, STEP[state, given], inserts + 1)
            ways.append((c + 2, "I" + a))
        if i < n:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            c, a = best(i + 1, state)
            ways.append((c + 3, "D" + a))
            if fault != "2":
                more = int(fault)
                if (state, initial) in STEP:
                    c, a = best(i + 1, STEP[state, initial])
                    ways.append((c + more, "K" + a))
                c, a = best(i + 1, STEP[state, given])
                ways.append((c + 2 + more, "R" + a))
        return min(ways, default=(1 << 60, ""))

    for i in range(n, 0, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state)
    return best(0, "")


def test_cheapest_edits_and_least_audits():
    for n in range(4):
        for turns in itertools.product([i + f for i in "sua-" for f in "012"], repeat=n):
            codes = "".join(turns)
            assert structure_repair.cheapest(codes, structure_repair.NOTHING) == brute(codes), codes
    rng = random.Random(13)
    for _ in range(300):
        codes = "".join(rng.choice("suuuaaa-") + rng.choice("00012") for _ in range(rng.randint(4, 40)))
        assert structure_repair.cheapest(codes, structure_repair.NOTHING) == brute(codes), codes


def plain(rows, damage=True):
    """The rows of the query, one conversation at a time."""
    out = []
    for c in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted([(t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for k, t, r, x in rows if k == c], key=lambda r: r[:4])
        turns = []
        for _, _, role, text, t in own:
            kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20 if damage else 19
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        faults, seen, codes = {"2": 0, "d": 0, "1": 0}, set(), ""
        for _, role, text in turns:
            words = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "2" if not words else "d" if (role, text) in seen else "1" if words[-1] not in ".!?" else "0"
            seen.add((role, text))
            if fault != "0":
                faults[fault] += 1
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "-") + ("2" if fault == "d" else fault)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(codes[::2], codes[2::2]))
        cost, audit = brute(codes)
        lines, state, left = [], "", list(turns)
        for letter in audit:
            role = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(f"{role}:")
            else:
                _, own_role, text = left.pop(0)
                if letter == "D":
                    continue
                role = own_role if letter == "K" else role
                lines.append(f"{role}:{text}")
            state = STEP[state, role[:1]]
        out.append((c, gaps, faults["2"], faults["d"], faults["1"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def drawn(rng, convs, most):
    rows = []
    for c in convs:
        t = rng.choice([0, 3])
        for i in range(rng.randint(1, most)):
            t += rng.choice([1, 1, 1, 1, 2, 0])
            role = rng.choice(["system", "user"]) if i == 0 else ("assistant" if rows and rows[-1][2] == "user" else "user")
            role = rng.choice([role] * 8 + ["tool", "", None, "User", "system"])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "Well", "Go on! ", "", " \n", "é?", None, f"{c} {i}.", f"{i} a.\t", f"{i}. ", f"b {i}.\n"])))
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", seg int").repartition(3)
    return sorted(tuple(r) for r in structure_repair.repaired(df, **options).collect())


def test_rows_of_drawn_conversations(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "SEGMENT_BITS", 3)  # most conversations lie in several segments
    rows = [*drawn(random.Random(14), range(120), 20), (500, None, None, None), (None, 1, "user", "x"), *[(501, 1, "user", "Same.")] * 3]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, damage=False) == plain(rows, damage=False)


def test_long_and_empty_conversations(spark):
    rng = random.Random(15)
    rows = drawn(rng, [7], 300) + [(7, 1000 + i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(1500)]
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "x.")]
    assert got(spark, rows) == plain(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got(spark, rows)
    assert got(spark, []) == []
