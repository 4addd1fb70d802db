"""Best-fit packing of token sequences by bin completion on the histogram of lengths.

How full the sequences can be depends only on how many pieces have each length,
and there are at most `capacity` lengths.  So the search runs on that bounded
histogram: a best-fit plan comes first, each filling applied to as many pieces as it fits at once.
While it is above the bound, its worst-filled sequences are packed anew by a
depth-first search over undominated fillings around the largest remaining length, which
prunes by the bound of what is left.  The search is bounded by a number of nodes; a gap
that it leaves is logged.
The result, a short list of patterns with how often each is used, goes to the
executors, where each piece finds its place from its rank among the pieces of
its length.  Ranks come from salted groups, so a length that a third of all
pieces share is not one task.
"""

from __future__ import annotations

import logging
import sys
import zlib
from array import array
from bisect import bisect_left
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, written
from .token_counts import char_batches, compiled, words_of

_LOG = logging.getLogger(__name__)

CAPACITY = 2048
SEPARATOR = 0
KEPT_WORDS = 200_000
#: Bounds of the search, whatever the number of patterns: fillings looked at for one sequence, steps to decide that one filling dominates another, fillings looked at in all, parts of them for one set of sequences taken back.
FILL_NODES, DEAL_NODES, SEARCH_NODES, WINDOWS = 4000, 200, 400_000, 10
#: Pieces of one length that one salted group holds on average, at most.
GROUP_ROWS = 100_000


@cache
def _library(path: str):
    """The library's tokenizer, a function from a word to its ids, and the store of encoded words.

    tokenizers takes several times as long as tiktoken for a single word.  Where the
    ids of a vocabulary rise in the order of its merges both give the same ids,
    so then words go to tiktoken; otherwise to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    merger, special, _ = compiled(path)
    by_merge = [merger.tokens[a + b] for a, b in merger.ranks]
    if by_merge == sorted(by_merge) and len(merger.tokens) == 256 + len(by_merge):
        encode = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=merger.tokens, special_tokens={}).encode_ordinary
    else:
        encode = lambda w: library.encode(w, add_special_tokens=False).ids
    return library, encode, {}, special


def encoded(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as the library gives them, as little-endian 32-bit numbers.

    Each distinct word is encoded once while it is kept; texts with a special
    string go to the library whole.
    """
    library, encode, known, special = _library(path)
    plain = [not any(s in t for s in special) for t in texts]
    words, counts = words_of([t if p else "" for t, p in zip(texts, plain)])
    got = list(map(known.get, words))
    if None in got:
        if len(known) > KEPT_WORDS:
            known.clear()
        for i, data in enumerate(got):
            if data is None:
                w = words[i]
                data = known.get(w)
                if data is None:
                    data = np.array(encode(w), "<u4").tobytes() if sys.byteorder != "little" else array("I", encode(w)).tobytes()
                    if len(w) <= 64:
                        known[w] = data
                got[i] = data
    out, at = [], 0
    for t, p, n in zip(texts, plain, counts.tolist()):
        out.append(b"".join(got[at : at + n]) if p else np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        at += n
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a separator, cut where longer than capacity; the first piece takes the odd rest."""
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches):
        for pdf in sliced(batches):
            rows, at, ids = [], 0, pdf["doc_id"].tolist()
            for run in char_batches(pdf["text"].tolist()):
                for data in encoded(run, path):
                    data += end
                    n = len(data) // 4
                    count = -(-n // capacity)
                    start, length = 0, n - (count - 1) * capacity
                    for k in range(count):
                        rows.append((ids[at], k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                        start, length = start + length, capacity
                    at += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be dealt into the items of a, each group no larger than its item: then b can give way to a at no loss.

    Both from the largest.  False as well where DEAL_NODES don't decide it, so that both stay.
    """
    if sum(b) > sum(a) or (b and (not a or b[0] > a[0])):
        return False
    room, nodes = list(a), [DEAL_NODES]

    def deal(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, left in enumerate(room):
            if left >= b[i] and left not in tried:
                tried.add(left)
                nodes[0] -= 1
                if nodes[0] < 0:
                    return False
                room[j] -= b[i]
                if deal(i + 1):
                    return True
                room[j] += b[i]
        return False

    return deal(0)


def fillings(room: int, lengths: list[int], counts: dict[int, int], nodes: int = FILL_NODES, every: bool = False) -> tuple[list[tuple[int, ...]], int, bool]:
    """Undominated fillings of `room`, least waste first; the nodes looked at; whether those are all.

    lengths fall; larger items are tried first.  Unless `every`, an exact filling ends the search.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    looked, falling = [0], [-x for x in lengths]

    def grow(left: int, begin: int, items: tuple[int, ...]) -> bool:
        """lengths[begin:] may follow, each distinct length once with all its copies; True ends the search."""
        closed = True
        for i in range(bisect_left(falling, -left, begin), len(lengths)):
            x = lengths[i]
            for n in range(min(left // x, counts[x]), 0, -1):
                closed = False
                looked[0] += 1
                if looked[0] > nodes:
                    return True
                rest, more = left - n * x, items + (x,) * n
                if rest == 0:
                    found.append((0, more))
                    if not every:
                        return True
                elif not every and rest < x and counts.get(rest, 0):
                    found.append((0, (*more, rest)))
                    return True
                elif grow(rest, i + 1, more):
                    return True
        if closed:
            found.append((left, items))
        return False

    grow(room, 0, ())
    whole = looked[0] <= nodes
    if not whole and (not found or min(found)[0]):  # the nodes ran out: largest first
        left, items = room, ()
        for x in lengths:
            n = min(left // x, counts[x])
            left, items = left - n * x, items + (x,) * n
        found.append((left, items))
    found.sort(key=lambda f: (f[0], len(f[1]), [-x for x in f[1]]))
    if not every:
        return [found[0][1]], looked[0], whole
    best: list[tuple[int, ...]] = []
    for _, items in found:
        if not any(dominates(b, items) for b in best):
            best.append(items)
    return best, looked[0], whole


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences needed at least (L2 of Martello and Toth): for each k the items above capacity - k stand alone, those above half never share, and what is k or longer fills the room left by them."""
    x = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[i] for i in x.tolist()], np.int64)
    count, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    half = np.searchsorted(2 * x, capacity, side="right")
    k = np.concatenate([[0], x[:half]])
    alone, begin = np.searchsorted(x, capacity - k, side="right"), np.searchsorted(x, k)
    middle, left = count[alone] - count[half], volume[half] - volume[begin]
    over = left - (middle * capacity - (volume[alone] - volume[half]))
    return int((count[-1] - count[half] + np.maximum(0, -(-over // capacity))).max())


def greedy(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit plan: the largest item with the filling of least waste, as often as it can be had."""
    counts, out = dict(histogram), []
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        pattern = (largest, *fillings(capacity - largest, lengths, counts)[0][0])
        counts[largest] += 1
        out.append((pattern, taken(counts, pattern)))
        lengths = [x for x in lengths if counts[x]]
    return out


def taken(counts: dict[int, int], pattern: tuple[int, ...], times: int | None = None) -> int:
    """Takes a pattern out of counts, as often as it can be had or `times`; how often."""
    need = {x: pattern.count(x) for x in pattern}
    times = min(counts[x] // n for x, n in need.items()) if times is None else times
    for x, n in need.items():
        counts[x] -= n * times
    return times


def search(histogram: dict[int, int], capacity: int, most: int, nodes: int) -> tuple[list[tuple[tuple[int, ...], int]] | None, int, bool]:
    """A plan of at most `most` sequences or None, by depth-first bin completion; the nodes looked at; whether None is proven.

    Each step takes the largest item left with each of its undominated fillings,
    as often as they can be had and then once, and goes back where the bound of what is left
    passes `most` or the same rest has failed before.
    """
    counts, path, used, looked, whole = dict(histogram), [], 0, 0, True
    failed: dict[tuple, int] = {}
    stack: list = []

    def children(nodes: int):
        nonlocal looked, whole
        lengths = sorted((x for x in counts if counts[x]), reverse=True)
        largest = lengths[0]
        counts[largest] -= 1
        options, n, complete_ = fillings(capacity - largest, lengths, counts, min(nodes, FILL_NODES), True)
        counts[largest] += 1
        looked += n + 1
        whole = whole and complete_
        out = []
        for o in options:
            pattern = (largest, *o)
            many = min(counts[x] // pattern.count(x) for x in set(pattern))
            out += [(pattern, many)] + [(pattern, 1)] * (many > 1)
        return iter(out)

    while True:
        rest = {x: n for x, n in counts.items() if n}
        if not rest:
            return path, looked, whole
        key = tuple(sorted(rest.items()))
        if used + lower_bound(rest, capacity) <= most and used < failed.get(key, most + 1):
            failed[key] = used  # holds once this branch has been left
            stack.append(children(nodes - looked))
        elif path:
            pattern, times = path.pop()
            taken(counts, pattern, -times)
            used -= times
        while stack:
            if looked >= nodes:
                return None, looked, False
            step = next(stack[-1], None)
            if step is not None:
                taken(counts, *step)
                path.append(step)
                used += step[1]
                break
            stack.pop()
            if path:
                pattern, times = path.pop()
                taken(counts, pattern, -times)
                used -= times
        if not stack:
            return None, looked, whole


def complete(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths from the largest) and how often each is used, together all items of the histogram.

    While the plan is above the bound, its worst-filled sequences are taken back and
    packed anew by search, ever more of them up to all; what saves a sequence is kept.
    """
    histogram = {x: n for x, n in histogram.items() if n}
    if not histogram:
        return []
    best, bound = greedy(histogram, capacity), lower_bound(histogram, capacity)
    used = sum(n for _, n in best)
    nodes, window = SEARCH_NODES, 0
    while used > bound and nodes > 0:
        # one sequence each, the emptiest first; less than a sequence of waste can't save one
        best.sort(key=lambda p: sum(p[0]))
        back, kept, waste, many = {}, [], 0, 0
        for pattern, times in best:
            n = times
            if waste >= capacity:
                n = min(times, max(0, window - many))
            elif sum(pattern) < capacity:
                n = min(times, max(window - many, -(-(capacity - waste) // (capacity - sum(pattern)))))
            for x in pattern if n else ():
                back[x] = back.get(x, 0) + n
            if times > n:
                kept.append((pattern, times - n))
            waste, many = waste + n * (capacity - sum(pattern)), many + n
        if waste < capacity:
            break
        other, looked, proven = search(back, capacity, many - 1, min(nodes, SEARCH_NODES // WINDOWS))
        nodes -= max(1, looked)
        if other is not None:
            best, used = kept + other, used - many + sum(n for _, n in other)
        elif not kept:
            break  # nothing more can be taken back
        else:
            window = 2 * many
    if used > bound:
        _LOG.warning("packing uses %d sequences of %d, at least %d are needed", used, capacity, bound)
    return best


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to capacity).

    Each row is placed once, so rows that repeat an id are packed separately.
    An empty table gives an empty table.  rows is read twice: give a stored table.
    """
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = complete(histogram, capacity)
    keys, pattern_of, many, bases, offsets = [], [], [], [], []
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        at = np.concatenate([[0], np.cumsum(pattern)[:-1]]).tolist()
        for x in dict.fromkeys(pattern):
            slots = [o for o, y in zip(at, pattern) if y == x]
            keys.append((x, taken.get(x, 0)))
            many.append(len(slots))
            bases.append(base)
            offsets.append(slots)
            taken[x] = taken.get(x, 0) + len(slots) * times
        base += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    wide = 1 << 40
    keys_, many_ = np.array([keys[i][0] * wide + keys[i][1] for i in order], np.int64), np.array([many[i] for i in order], np.int64)
    bases_ = np.array([bases[i] for i in order], np.int64)
    first = np.concatenate([[0], np.cumsum(many_)[:-1]]) if len(order) else np.zeros(0, np.int64)
    slots_ = np.array([o for i in order for o in offsets[i]], np.int64)

    salts = max(8, sum(histogram.values()) // GROUP_ROWS)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("__in", inside).join(groups, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__in") - 1)
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"

    def place(batches):
        for pdf in batches:
            at = np.searchsorted(keys_, pdf["length"].to_numpy() * wide + pdf["__rank"].to_numpy(), side="right") - 1
            behind = pdf["__rank"].to_numpy() - keys_[at] % wide
            yield pdf[columns].assign(sequence_id=bases_[at] + behind // many_[at], offset=slots_[first[at] + behind % many_[at]])

    return ranked.select(*columns, "__rank").mapInPandas(place, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, with the sequence it stands in and where; null text counts as empty and is one separator."""
    out = pack(written(pieces(docs, path, capacity, id_col, text_col)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
