"""Repair of conversations: the cheapest edits that give an optional system turn and pairs of user and assistant.

The edits of n turns form a lattice: its nodes are (turns read, state of the pattern
`(s?(ua)+)?`), its edges Keep, Rerole, Delete and Insert.  A letter leads from a node
to one other at most.  The cheapest way through is searched from both ends:

* Two heaps, one from the start and one backward from the accepting ends, settle nodes by cost;
  the cheaper one moves.  Each settled node holds the least audit of its cheapest ways.
* When the two heads together cost more than the best crossing, every cheapest
  way has an edge from a node settled forward to one settled backward.  The
  least of the audits that meet at such edges is the answer.

Two different cheapest ways to a node never have one audit begin the other, as letters
determine the way; so a part of a least audit is the least of its part.  For the
same reason a long conversation is cut into segments of SEGMENT turns, dealt out
over tasks: first the cost between all states of each segment's ends, then, with the costs from
the segment's end to the conversation's, the least audit from each state it may be
entered in.  An Insert at a cut belongs to the segment behind it.  One task sees
of a conversation the costs and audits of its segments, never its texts; the hash
of the repaired texts reads them as a stream.

Turns are judged before that: by aggregates per (conversation, role, text), by
segments and by the ends of segments.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, parallelism
from .order import runs, sorted_rows

#: Turns of a segment: 2 ** 9.
SEGMENT_BITS = 9
#: States: nothing yet, after the system turn, after a user turn, after a pair.
NOTHING, SYSTEM, USER, PAIR = range(4)
STATES = range(4)
ACCEPTED = ((NOTHING, 0), (PAIR, 0))
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: The one role that may be given or inserted in a state.
GIVEN = {NOTHING: "u", SYSTEM: "u", USER: "a", PAIR: "u"}
RENAME, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
WORD = r"[^\x20\x09-\x0D]"
#: A cost that stands for "no way".
MISSING = 1 << 60


def _edges(codes: str, at: int, state: int, last: bool):
    """(letter, cost, next node) of a node.

    codes has two characters for each turn: its role's initial, and 0 for no fault, 1 for
    truncated, 2 for one that has to go.  Behind the turns an Insert is for the last segment only.
    """
    n = len(codes) // 2
    if at < n:
        initial, fault = codes[2 * at], codes[2 * at + 1]
        yield "D", DELETE, (at + 1, state)
        if fault != "2":
            more = CUT_SHORT if fault == "1" else 0
            if (state, initial) in NEXT:
                yield "K", more, (at + 1, NEXT[state, initial])
            yield "R", RENAME + more, (at + 1, NEXT[state, GIVEN[state]])
    if at < n or last:
        yield "I", INSERT, (at, NEXT[state, GIVEN[state]])


class _Heap:
    """One direction of the search: settled nodes with their cost and least audit."""

    def __init__(self, start: tuple[int, int], sign: int):
        self.sign, self.open, self.heap, self.settled = sign, {}, [], {}
        self.reach(start, 0, "")

    def reach(self, node: tuple[int, int], cost: int, audit: str) -> None:
        held = self.open.get(node)
        if node not in self.settled and (held is None or (cost, audit) < held):
            if held is None or cost < held[0]:
                heappush(self.heap, (cost, self.sign * node[0], node))
            self.open[node] = cost, audit

    def head(self) -> int:
        """Cost of the cheapest open node.  Edges that cost nothing lead one turn on, so nodes of one cost are settled turn by turn."""
        while self.heap and self.heap[0][2] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else 2 * MISSING

    def settle(self) -> tuple[tuple[int, int], int, str]:
        _, _, node = heappop(self.heap)
        self.settled[node] = self.open.pop(node)
        return (node, *self.settled[node])


def cheapest(codes: str, entry: int, exits: tuple[tuple[int, int], ...] = ACCEPTED, last: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state `entry` before the turns to one of the (state, cost) behind them; None if there is no way."""
    n = len(codes) // 2
    beyond = dict(exits)
    end = n + 1, 0
    onward = {}
    backward: dict[tuple[int, int], list[tuple[str, int, tuple[int, int]]]] = {}
    for at in range(n + 1):
        for state in STATES:
            leaves = [("", beyond[state], end)] if at == n and state in beyond else []
            onward[at, state] = [*_edges(codes, at, state, last), *leaves]
            for letter, cost, to in onward[at, state]:
                backward.setdefault(to, []).append((letter, cost, (at, state)))
    ahead, back = _Heap((0, entry), 1), _Heap(end, -1)
    best = MISSING
    while min(a := ahead.head(), b := back.head()) < MISSING and a + b <= best:
        if a <= b:
            node, cost, audit = ahead.settle()
            best = min(best, cost + back.settled.get(node, (MISSING,))[0])
            for letter, more, to in onward.get(node, ()):
                ahead.reach(to, cost + more, audit + letter)
        else:
            node, cost, audit = back.settle()
            best = min(best, cost + ahead.settled.get(node, (MISSING,))[0])
            for letter, more, source in backward.get(node, ()):
                back.reach(source, cost + more, letter + audit)
    crossings = (
        (cost + more + back.settled[to][0], audit + letter + back.settled[to][1])
        for node, (cost, audit) in ahead.settled.items()
        for letter, more, to in [("", 0, node), *onward.get(node, ())]
        if to in back.settled
    )
    return min(crossings, default=None)


def walk(codes: str, entry: int, audit: str) -> tuple[int, list[str]]:
    """The state behind the turns, and what becomes of each turn and of the place behind the last.

    That is the initials of the roles inserted before it, and then `=` for kept, `-` for deleted, or the initial of its new role.
    """
    state, before, out = entry, "", []
    initials = iter(codes[::2])
    for letter in audit:
        given = GIVEN[state]
        if letter == "I":
            before, state = before + given, NEXT[state, given]
            continue
        initial = next(initials)
        out.append(before + {"K": "=", "D": "-"}.get(letter, given))
        before = ""
        if letter != "D":
            state = NEXT[state, initial if letter == "K" else given]
    return state, [*out, before + "-"]


@lru_cache(1 << 14)
def solved(codes: str, entry: int, exits: tuple[tuple[int, int], ...] = ACCEPTED, last: bool = True) -> tuple[int, int, str, str] | None:
    """(cost, state behind the turns, audit, what becomes of the turns) of the cheapest edits."""
    found = cheapest(codes, entry, exits, last)
    if found is None:
        return None
    state, plan = walk(codes, entry, found[1])
    return found[0], state, found[1], ",".join(plan)


@lru_cache(1 << 14)
def between(codes: str, last: bool) -> tuple[int, ...]:
    """Cost from each state before the turns to each behind them; to the conversation's end, in the first place, for its last segment."""
    goals = [ACCEPTED, None, None, None] if last else [((s, 0),) for s in STATES]
    found = [cheapest(codes, a, g, last) if g else None for a in STATES for g in goals]
    return tuple(f[0] if f else MISSING for f in found)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the damage leaves them, in place; it hangs on conv_id and turn alone."""
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def judged(held: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault) of each row of sorted_rows: blank, duplicate, truncated or null is its first fault."""
    said = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)).alias("said")
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("-").alias("initial")
    rows = held.select("conv_id", "turn", "at", initial, said, F.col("text").rlike(WORD).alias("worded"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"))
    first = rows.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(~F.col("worded"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    return rows.join(first, "at", "left").select("conv_id", "turn", "at", "initial", fault.alias("fault"))


LEGAL = ("su", "ua", "au")
TO_ENDS = "conv_id long, seg long, to_end array<long>, is_first boolean, is_last boolean"
SOLUTION = "conv_id long, seg long, entry int, cost long, leave int, audit string, plan string"
PLANS = "conv_id long, cost long, audit string, plans array<struct<seg:long,plan:string>>"


def _costs(batches):
    for pdf in batches:
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "seg": pdf["seg"], "costs": [between(c, bool(z)) for c, z in zip(pdf["codes"], pdf["seg"] == pdf["last_seg"])]})


def _to_ends(batches):
    """Costs from each state behind a segment to the conversation's end, from the last segment to the first."""
    for pdf in batches:
        out = []
        for conv, parts in zip(pdf["conv_id"], pdf["parts"]):
            beyond = None
            for i in range(len(parts) - 1, -1, -1):
                costs = parts[i]["costs"]
                out.append((conv, parts[i]["seg"], beyond, i == 0, beyond is None))
                beyond = [min(costs[4 * a + b] + (beyond[b] if beyond else 0) for b in STATES) for a in STATES]
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in TO_ENDS.split(", ")])


def _solve(batches):
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            exits = ACCEPTED if r.is_last else tuple((s, int(c)) for s, c in enumerate(r.to_end) if c < MISSING)
            for entry in (NOTHING,) if r.is_first else STATES:
                found = solved(r.codes, entry, exits, bool(r.is_last))
                if found:
                    out.append((r.conv_id, r.seg, entry, *found))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SOLUTION.split(", ")])


def _joined(batches):
    """Each conversation's segments from the first on, each entered in the state that the one before is left in."""
    for pdf in batches:
        out = []
        for conv, parts in zip(pdf["conv_id"], pdf["parts"]):
            by = {(p["seg"], p["entry"]): p for p in parts}
            state, way = NOTHING, []
            for seg in sorted({p["seg"] for p in parts}):
                way.append(by[seg, state])
                state = way[-1]["leave"]
            out.append((conv, way[0]["cost"], "".join(p["audit"] for p in way), [{"seg": p["seg"], "plan": p["plan"]} for p in way]))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in PLANS.split(", ")])


def _hash(batches):
    """SHA-256 of each conversation's repaired turns, read in order; a segment's plan comes before its turns."""
    roles = {"u": "user", "a": "assistant"}
    key, sha, plan, at, empty, done = None, None, ["-"], 0, True, []

    def put(line: str) -> None:
        nonlocal empty
        sha.update((line if empty else "\n" + line).encode())
        empty = False

    def close() -> None:
        for r in plan[at][:-1]:  # behind the last turn
            put(roles[r] + ":")
        done.append((key, sha.hexdigest()))

    for (found,), part in runs(batches, ["conv_id"]):
        if sha is None or found != key:
            if sha is not None:
                close()
            key, sha, plan, at, empty = found, hashlib.sha256(), ["-"], 0, True
        for is_turn, role, text in zip(part["is_turn"], part["role"], part["text"]):
            if not is_turn:
                plan, at = text.split(","), 0
                continue
            *before, action = plan[at]
            at += 1
            for r in before:
                put(roles[r] + ":")
            if action != "-":
                put(f"{roles.get(action, role)}:{text}")
        if len(done) > 5000:
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])
            done.clear()
    if sha is not None:
        close()
        yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])


def repaired(turns: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns: conv_id, turn, role, text; other columns are not read.  With `damage` the rows are
    damaged first, as the query wants it.  Nulls of role and text are one space.
    Turns that share a number are ordered by role, then text, by code point and before
    damage; a copy stands behind its row; rows without a number come first.  Rows without a
    conv_id belong to no conversation.  A role that doesn't begin with a small s, u or a
    can't be kept.  A conversation without rows after damage has zeros, an empty audit and the hash of nothing.
    """
    steps = Steps(turns.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    held = sorted_rows(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], steps, damaged if damage else lambda df: df)

    # a segment: rows of a conversation whose numbers share their upper bits, so they stand together
    segment = F.shiftright("at", SEGMENT_BITS).alias("seg")
    code = F.concat("initial", F.when(F.col("fault").isin("blank", "duplicate"), "2").when(F.col("fault") == "truncated", "1").otherwise("0")).alias("code")
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", code))), lambda x: x["code"]), "").alias("codes")
    faults = [F.sum((F.coalesce(F.col("fault"), F.lit("")) == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    segments = judged(held).groupBy("conv_id", segment).agg(in_order, F.min("turn").alias("low"), F.max("turn").alias("high"), *faults)
    initials = F.regexp_replace("codes", "(.).", "$1")
    legal = F.regexp_count(initials, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    segments = steps.written(segments.withColumn("illegal", F.length(initials) - 1 - legal).withColumn("ends", F.concat(F.left(initials, F.lit(1)), F.right(initials, F.lit(1)))))

    many = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("seg").alias("last_seg")).filter("n > 1").drop("n")
    costs = segments.join(many, "conv_id").select("conv_id", "seg", "last_seg", "codes").mapInPandas(_costs, "conv_id long, seg long, costs array<long>")
    to_ends = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs"))).alias("parts")).mapInPandas(_to_ends, TO_ENDS)
    alone = [F.coalesce(c, F.lit(True)).alias(c) for c in ("is_first", "is_last")]
    asked = segments.select("conv_id", "seg", "codes").join(to_ends, ["conv_id", "seg"], "left").select("conv_id", "seg", "codes", "to_end", *alone)
    answers = asked.mapInPandas(_solve, SOLUTION).groupBy("conv_id").agg(F.collect_list(F.struct("seg", "entry", "cost", "leave", "audit", "plan")).alias("parts"))
    audits = steps.written(answers.mapInPandas(_joined, PLANS))

    plans = audits.select("conv_id", F.explode("plans").alias("p")).select("conv_id", "p.seg", F.lit(False).alias("is_turn"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.col("p")["plan"].alias("text"))
    said = held.select("conv_id", segment, F.lit(True).alias("is_turn"), "at", "role", "text")
    stream = said.unionByName(plans).repartition(parallelism(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seg", "is_turn", "at")
    hashes = stream.mapInPandas(_hash, "conv_id long, repaired_sha256 string")

    # turns that share a number may lie in two segments, so distinct numbers are counted apart
    numbers = held.filter("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("numbers"))
    ends = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "ends"))), lambda x: x["ends"]), "").alias("ends")
    counts = segments.groupBy("conv_id").agg((F.max("high") - F.min("low") + 1).alias("span"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], ends)
    met = lambda i: F.substr("ends", (2 * i).cast("int"), F.lit(2))  # noqa: E731  (the last of one segment, the first of the next)
    borders = F.when(F.length("ends") > 2, F.size(F.filter(F.sequence(F.lit(1), (F.length("ends") / 2).cast("int") - 1), lambda i: ~met(i).isin(*LEGAL)))).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = rows.select("conv_id").distinct()
    for part in (counts, numbers, audits.drop("plans"), hashes):
        out = out.join(part, "conv_id", "left")
    return out.select(
        "conv_id",
        (zero(F.col("span")) - zero(F.col("numbers"))).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
        zero(F.col("illegal") + borders).alias("illegal"),
        zero(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
