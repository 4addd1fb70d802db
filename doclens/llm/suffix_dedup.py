"""Exact removal of repeated passages with an enhanced suffix array.

A byte goes if a string of `size` bytes that covers it also starts earlier.  The
work is in three steps, none of which holds the corpus in one place:

1. Anchors.  Every window of `size` bytes names the place of the least hash
   among the GRAM-byte strings in it.  Equal windows name the same place, so
   windows can only be equal if their anchors' strings are; and one in about
   thirty-five places is an anchor.  Only anchors whose string occurs twice go
   on.  A bitmap of bounded size drops most of the others where they arise.
2. Contexts.  The windows of an anchor together span a context.  Occurrences of
   one context are alike: all but the first are repeats as a whole, whatever the
   size of their group, and only the first of each goes on.
3. Suffixes.  What is left is sorted by the suffix that starts at the anchor, and
   the array of common prefixes is stack-scanned into the tree of its intervals.
   In each interval the suffixes share a prefix; those that share enough to
   their left are a repeat group.  An interval whose left extensions are too
   diverse for a whole window holds none.  Groups come with all occurrences.

A group of more contexts than GROUP_ROWS is halved by the distance from a window's
start to the anchor, until its parts are small: all windows of one half hold the same
bytes to the left of the anchor, those of the other half the same bytes to its right, so
contexts that differ there go apart, and no window belongs to both.  At a
single distance the windows of a part are equal, and a partial minimum finds the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, parallelism
from .shingles import _powers, in_batches, mix

SIZE = 100
GRAM = 32
#: Contexts of one group that are sorted together, at most.
GROUP_ROWS = 20_000
#: Contexts that a task sorts at a time, about.
SORT_ROWS = 20_000
#: Bytes of text that are scanned at a time; arrays of some sixty times that size come with it.
SCAN_BYTES = 1 << 18
#: Rows of the last step that a task holds at a time.
CUT_ROWS = 500
#: Bits of a bitmap, at most: 16 MB.
BITMAP_BITS = 1 << 27
#: A byte that UTF-8 has no use for, so what isn't there equals no text.
PAD = b"\xff"


def anchors(text: bytes | list[bytes], size: int = SIZE, gram: int = GRAM):
    """Anchors of the texts: index of the text, place in it, least and greatest distance from a window's start to it, hash of the string there."""
    texts = [text] if isinstance(text, bytes) else text
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < size:
        return none
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) + 1 - gram])
    bits = np.uint64(int(len(grams)).bit_length())
    width = size - gram + 1
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # windows that lie in one text
    inside = np.zeros(len(place) + 1, np.int64)
    long = lengths >= size
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, begins[long] + lengths[long] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(starts):
        return none
    place = place[starts]
    owner = np.searchsorted(begins, starts, side="right") - 1
    # empty texts share their begin with the next one; the last of them is the owner
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    last = np.append(new[1:], len(starts)) - 1
    at = place[new]
    return owner[new], at - begins[owner[new]], at - starts[last], at - starts[new], grams[at].view(np.int64)


def interval_tree(lcp: np.ndarray, least: int):
    """Stack scan of common-prefix lengths between neighbours: yields (prefix length, first, last) of each interval with at least `least` in common.

    lcp[i] is between suffixes i - 1 and i; lcp[0] is not read.  Intervals inside
    another come before it.
    """
    stack = [(-1, 0)]
    values = lcp.tolist()
    for i in range(1, len(values) + 1):
        here = values[i] if i < len(values) else -1
        left = i - 1
        while stack[-1][0] > here:
            height, left = stack.pop()
            if height >= least:
                yield height, left, i - 1
        if stack[-1][0] < here:
            stack.append((here, left))


def repeat_groups(group: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, far: np.ndarray, size: int = SIZE):
    """For each context the distances of windows that also start at one of smaller rank.

    group: key of the anchor's string; left, right: bytes before the anchor (from
    the anchor backwards) and from it on, a row per context.  Yields (context,
    least distance, greatest distance): the windows that start between those
    distances before the anchor.  One context may come several times.
    """
    n = len(group)
    keyed = np.concatenate([group.astype(">i8").view(np.uint8).reshape(n, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    group, rank, left, right, near, far = group[order], rank[order], left[order], right[order], near[order], far[order]
    lcp = _common(right[:-1], right[1:])
    lcp = np.append(0, np.where(group[1:] == group[:-1], lcp, 0))
    beside = np.append(0, _common(left[:-1], left[1:]))
    need = size - left.shape[1]
    ranks, nears, fars = rank.tolist(), near.tolist(), far.tolist()
    for height, first, last in interval_tree(lcp, need):
        wanted = size - height  # bytes to the left that a whole window needs
        if last == first + 1:
            i, j = (first, last) if ranks[first] < ranks[last] else (last, first)
            low, high = max(wanted, nears[j], 0), min(int(beside[last]), fars[j])
            if low <= high:
                yield int(order[j]), low, high
            continue
        members = np.arange(first, last + 1)
        rows = left[members]
        by_left = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
        members = members[by_left]
        shared = np.append(0, _common(left[members[:-1]], left[members[1:]]))
        if shared.max() < wanted:  # every left extension differs before a window is full
            continue
        best = _longest_with_earlier(rank[members].tolist(), shared.tolist())
        for i, reach in zip(members.tolist(), best):
            low, high = max(wanted, nears[i], 0), min(reach, fars[i])
            if reach >= wanted and low <= high:
                yield int(order[i]), low, high


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]) if a.shape[1] else np.zeros(len(a), np.int64)


def _longest_with_earlier(ranks: list[int], shared: list[int]) -> list[int]:
    """In sorted order: each row's longest common prefix with a row of smaller rank, by the nearest such row on either side; -1 if there is none."""
    out = [-1] * len(ranks)
    for order in (1, -1):
        stack: list[tuple[int, int]] = []  # rank, common prefix with the row that follows it here
        rows = range(len(ranks)) if order == 1 else range(len(ranks) - 1, -1, -1)
        before = None
        for i in rows:
            if before is not None:
                height = shared[max(i, before)]
                if stack:
                    stack[-1] = stack[-1][0], min(stack[-1][1], height)
            least = 1 << 30
            while stack and stack[-1][0] >= ranks[i]:
                least = min(least, stack.pop()[1])
                if stack:
                    stack[-1] = stack[-1][0], min(stack[-1][1], least)
            if stack:
                out[i] = max(out[i], stack[-1][1])
            stack.append((ranks[i], 1 << 30))
            before = i
    return out


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs in order; touching spans join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# What is done with the anchors of a text in the three passes.
_FIND, _FILTER, _CONTEXT = "h long", "h long, c long, d long, tie long, at long", "h long, d long, tie long, at long, left binary, right binary"


def _packed(place, near, far):
    return (place << 14) | (near << 7) | far


def _scan(texts: DataFrame, mode: str, size: int, bitmap=None) -> DataFrame:
    """Anchors of (d, tie, text) as rows of the given form; with a bitmap only those whose key is in it."""

    def run(batches):
        for pdf in batches:
            at = 0
            for part in in_batches((t.encode() for t in pdf["text"]), SCAN_BYTES):
                owner, place, near, far, h = anchors(part, size)
                rows = at + owner
                at += len(part)
                d, tie = pdf["d"].to_numpy()[rows], pdf["tie"].to_numpy()[rows]
                packed = _packed(place, near, far)
                if bitmap is not None:
                    key = h if mode == _FILTER else _place_key(d, tie, packed)
                    kept = _in_bitmap(bitmap.value, key)
                    owner, place, near, far, h, d, tie, packed = (x[kept] for x in (owner, place, near, far, h, d, tie, packed))
                if not len(h):
                    continue
                if mode == _FIND:
                    yield pd.DataFrame({"h": h})
                    continue
                if mode == _FILTER:
                    yield pd.DataFrame({"h": h, "c": [_digest(part[o], p, n, f, size) for o, p, n, f in zip(owner.tolist(), place.tolist(), near.tolist(), far.tolist())], "d": d, "tie": tie, "at": packed})
                    continue
                spans = list(zip(owner.tolist(), place.tolist(), near.tolist(), far.tolist()))
                yield pd.DataFrame({"h": h, "d": d, "tie": tie, "at": packed, "left": [part[o][p - f : p] for o, p, _, f in spans], "right": [part[o][p : p - n + size] for o, p, n, _ in spans]})

    return texts.select("d", "tie", "text").mapInPandas(run, mode)


def _digest(text: bytes, place: int, near: int, far: int, size: int) -> int:
    data = text[place - far : place - near + size] + bytes((near, far))
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _place_key(d: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = mix(d.astype(np.int64).view(np.uint64) + mix(tie.astype(np.int64).view(np.uint64) + mix(at.astype(np.int64).view(np.uint64))))
    return x.view(np.int64)


def _in_bitmap(bitmap: bytes, key: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap, np.uint8)
    slot = key.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(keys: DataFrame, columns: list[str], make) -> bytes:
    """A bitmap of the keys, at most BITMAP_BITS large; each part of it is filled in one task, from distinct slots."""
    n = keys.count()
    size = min(BITMAP_BITS, max(1 << 16, 1 << int(16 * n).bit_length()))
    part = min(1 << 21, size)

    def slots(batches):
        for pdf in batches:
            yield pd.DataFrame({"slot": (make(pdf).view(np.uint64) & np.uint64(size - 1)).astype(np.int64)})

    def fill(key, rows):
        bits = np.zeros(part, np.uint8)
        bits[rows["slot"].to_numpy() % part] = 1
        return pd.DataFrame({"i": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = keys.select(*columns).mapInPandas(slots, "slot long").distinct()
    parts = found.groupBy(F.floor(F.col("slot") / part).alias("i")).applyInPandas(fill, "i long, bits binary").collect()
    out = bytearray(size // 8)
    for r in parts:
        out[r["i"] * (part // 8) : (r["i"] + 1) * (part // 8)] = r["bits"]
    return bytes(out)


def repeated_spans(texts: DataFrame, steps: Steps, size: int = SIZE, group_rows: int | None = None) -> DataFrame:
    """(d, tie, start, stop): spans of (d, tie, text) that windows with an earlier equal cover; d, tie and place give the order."""
    spark, group_rows = texts.sparkSession, group_rows or GROUP_ROWS
    broadcast = spark.sparkContext.broadcast
    counted = _scan(texts, _FIND, size).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    repeated = steps.written(counted)
    own = _bitmap(repeated, ["h"], lambda pdf: pdf["h"].to_numpy())
    steps.drop(repeated)
    found = steps.written(_scan(texts, _FILTER, size, broadcast(own)))
    # what the bitmap lets through by mistake stands alone in its group and falls out below
    order = F.struct("d", "tie", "at")
    contexts = steps.written(found.groupBy("h", "c").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    start = (F.shiftright("at", 14) - F.col("at").bitwiseAND(127)).alias("start")
    stop = (F.shiftright("at", 14) - F.shiftright("at", 7).bitwiseAND(127) + size).alias("stop")
    # the later occurrences of a context are covered as a whole
    whole = steps.written(found.join(contexts.filter("n > 1").select("h", "c", "first"), ["h", "c"]).filter(order != F.col("first")).select("d", "tie", start, stop))
    steps.drop(found)
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    needed = steps.written(contexts.join(several, "h").select("h", "m", "first.d", "first.tie", "first.at"))
    steps.drop(contexts)
    places = _bitmap(needed, ["d", "tie", "at"], lambda pdf: _place_key(pdf["d"].to_numpy(), pdf["tie"].to_numpy(), pdf["at"].to_numpy()))
    scanned = _scan(texts, _CONTEXT, size, broadcast(places))
    rows = steps.written(scanned.join(needed, ["h", "d", "tie", "at"]).dropDuplicates(["h", "d", "tie", "at"]))
    steps.drop(needed)
    width = size - GRAM

    def sort(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= SORT_ROWS:
                every = pd.concat(held)
                open_ = every["h"] == every["h"].iloc[-1]  # the last group may go on
                held = [every[open_]]
                if not open_.all():
                    yield spans_of(every[~open_])
        if held:
            yield spans_of(pd.concat(held))

    def spans_of(pdf):
        at = pdf["at"].to_numpy()
        place = at >> 14
        near, far = np.maximum((at >> 7) & 127, pdf["low"].to_numpy()), np.minimum(at & 127, pdf["high"].to_numpy())
        left = np.frombuffer(b"".join(x[::-1].ljust(width, PAD) for x in pdf["left"]), np.uint8).reshape(-1, width)
        right = np.frombuffer(b"".join(x.ljust(size, PAD) for x in pdf["right"]), np.uint8).reshape(-1, size)
        d, tie = pdf["d"].to_numpy(), pdf["tie"].to_numpy()
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((at, tie, d))] = np.arange(len(at))
        got = list(repeat_groups(pdf["h"].to_numpy(), rank, left, right, near, far, size))
        i = np.array([g[0] for g in got], np.int64)
        low, high = np.array([g[1] for g in got], np.int64), np.array([g[2] for g in got], np.int64)
        return pd.DataFrame({"d": d[i], "tie": tie[i], "start": place[i] - high, "stop": place[i] - low + size})

    def sorted_groups(part: DataFrame) -> DataFrame:
        part = part.select("h", "d", "tie", "at", "left", "right", "low", "high")
        return part.repartition(parallelism(spark), "h").sortWithinPartitions("h").mapInPandas(sort, "d long, tie long, start long, stop long")

    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(width)})
    out = whole.unionByName(sorted_groups(rows.filter(F.col("m") <= group_rows)))
    large, low, high = rows.filter(F.col("m") > group_rows).drop("m"), F.col("low"), F.col("high")
    # log2 of the width rounds bring every part to a single distance
    while large.limit(1).count():
        middle = F.floor((low + high) / 2).cast("int")
        halves = F.explode(F.when(low < high, F.array(F.struct(low.alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), high.alias("b")))).otherwise(F.array(F.struct(low.alias("a"), high.alias("b"))))).alias("half")
        parts = large.select("h", "d", "tie", "at", "left", "right", halves).withColumns({"low": F.col("half.a"), "high": F.col("half.b")}).drop("half")
        # only rows with a window in that half
        parts = parts.filter((F.col("at").bitwiseAND(127) >= low) & (F.shiftright("at", 7).bitwiseAND(127) <= high))
        shared = F.concat(F.expr("CASE WHEN low > 0 THEN substring(left, -low, low) ELSE CAST('' AS BINARY) END"), F.expr(f"substring(right, 1, {size} - high)"))
        parts = steps.written(parts.withColumn("h", F.xxhash64("h", "low", "high", F.lit(1), shared)))
        sizes = parts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        sized = parts.join(sizes, "h")
        out = out.unionByName(sorted_groups(sized.filter(F.col("m") <= group_rows)))
        # equal windows: all but the first go
        single = sized.filter((F.col("m") > group_rows) & (low == high)).select("h", "d", "tie", (F.shiftright("at", 14) - low).alias("start"))
        here = F.struct("d", "tie", "start")
        first = single.groupBy("h").agg(F.min(here).alias("first"))
        out = out.unionByName(single.join(first, "h").filter(here != F.col("first")).select("d", "tie", "start", (F.col("start") + size).alias("stop")))
        large = sized.filter((F.col("m") > group_rows) & (low < high)).drop("m")
    return out


def dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: its text without repeated bytes.

    Null text counts as empty.  Documents are ordered by id, null first; rows with
    one id and different texts by a hash of the text; rows that repeat id and text
    are one document and get one result.  Texts shorter than `size` bytes lose
    nothing.  kept may cut through a character, so it is binary.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text", F.length("text"))})
    steps = Steps(docs.sparkSession)
    spans = steps.written(repeated_spans(rows, steps, size).groupBy("d", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    steps.drop_all_but(spans)
    joined = rows.join(spans, ["d", "tie"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for pdf in batches:
            out = []
            for i, t, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                data = t.encode()
                runs = merged_spans([(s["start"], s["stop"]) for s in spans]) if spans is not None else []
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                if len(out) == CUT_ROWS:
                    yield framed(out)
                    out = []
            yield framed(out)

    def framed(out):
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
