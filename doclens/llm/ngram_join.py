"""N-gram Jaccard join and its components, by a size-aware heavy-light join.

Documents with one set of shingles are one class, so copies cost nothing beyond
their first.  Between classes:

* Small sets (light side) are joined by enumerating subsets.  Two sets of sizes n
  and m link only if they share a subset of the fixed size c(n, m), so each small
  set emits its subsets of those sizes and equal keys meet.
* Large sets (heavy side) scan inverted lists.  In one order of all shingles, two
  linked sets share MATCHES of the first P(n) shingles of each, so only these are
  listed.  The order puts frequent shingles last, whatever passage or phrase
  makes them frequent.
* The boundary between the sides is the size with the least cost: subsets to
  emit against list entries to scan, from the sizes and lists of this corpus.

Which shingles are frequent is counted over all documents, and the order is
exact whatever is counted as frequent.  Sets that hold too few rare shingles to fill
their first P(n) (parts of large families, or made of common passages) are ordered
again among themselves by their exact counts, over all their shingles.

Short lists are scanned pair by pair.  Long lists are not: each round compares
the members with one pivot of the list, and lists whose members have come
together in one component are done.  What is left after the rounds is scanned
in full, cut by classes of size, of which only neighbours meet, and with one side
of each class dealt out over as many tasks as the list is long.  Every candidate is
verified on the whole sets of its shingles' 63-bit hashes; what could tell two
shingles of one hash apart is not read again.

Each table is dropped once what was made of it is stored.
"""

from __future__ import annotations

import logging
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, sliced
from .graph import components
from .shingles import in_batches, mix, shingle_sets
from .suffix_dedup import _bitmap, _in_bitmap

_LOG = logging.getLogger(__name__)

SHINGLE = 4
NUM, DEN = 85, 100
#: Shingles that the listed parts of two linked sets have in common at least.
MATCHES = 3
#: Lists up to this length are scanned pair by pair; a shingle listed more often counts as frequent.
SHORT_LIST = 16
#: Frequent shingles that are sent to the executors, at most (2 MB); the threshold rises until they fit.
FREQUENT = 1 << 18
#: Sets above this size are never on the light side: such a set has more subsets than entries in short lists (one of 33 shingles 528 against 112), so cost never picks a larger boundary.
LARGEST_SMALL = 32
ROUNDS = 6
#: Pairs left in the long lists at which the rounds end early.
RESIDUAL = 100_000
#: Entries of a list that one part of the full scan takes against the whole list.
DEALT = 512


def overlap_needed(n: int, m: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles that sets of sizes n and m must share to link."""
    return -(-num * (n + m) // (num + den))


def partner_sizes(n: int, num: int = NUM, den: int = DEN) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def listed(n: int, num: int = NUM, den: int = DEN) -> int:
    """P(n): shingles of a set of size n that go into the lists."""
    return n - -(-num * n // den) + MATCHES


def has_partners(n: int, num: int = NUM, den: int = DEN) -> bool:
    return len(partner_sizes(n, num, den)) > 1


def subset_sizes(n: int, limit: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Sizes of the subsets that a small set of size n emits for small partners of other or equal size."""
    return sorted({overlap_needed(n, m, num, den) for m in partner_sizes(n, num, den) if m <= limit and overlap_needed(n, m, num, den) <= min(n, m) and (m != n or overlap_needed(n, m, num, den) < n)})


def boundary(sizes: dict[int, int], list_length: float, num: int = NUM, den: int = DEN) -> int:
    """The largest size on the light side: of all choices the one with the fewest subsets plus list entries read."""
    costs = []
    for x in range(LARGEST_SMALL + 1):
        light = sum(k * sum(comb(n, c) for c in subset_sizes(n, x, num, den)) for n, k in sizes.items() if n <= x)
        heavy = sum(k * listed(n, num, den) * list_length for n, k in sizes.items() if n >= num * (x + 1) // den and has_partners(n, num, den))
        costs.append((light + heavy, x))
    return min(costs)[1]


def _sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Shingle sets as sorted non-negative 63-bit numbers."""
    return [np.unique((s >> np.uint64(1)).astype(np.int64)) for part in in_batches([t.encode() for t in texts]) for s in shingle_sets(part, size)]


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same in any order."""
    u = s.view(np.uint64)
    return int(mix(u).sum(dtype=np.uint64).view(np.int64)), int(mix(u * np.uint64(5) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))


def _region(n: int, num: int, den: int) -> int:
    """Shingles of least hash that are kept of a set at first: enough to fill the listed part though some are frequent."""
    p = listed(n, num, den)
    return n if n <= LARGEST_SMALL else min(n, p + p // 2 + 8)


def _reachable(n: Column, pos_n: Column, m: Column, pos_m: Column, num: int, den: int) -> Column:
    """Whether two sets can share enough if their first common shingle stands at these places of their orders: all that is common follows."""
    rest = F.least(n - pos_n, m - pos_m)
    return rest * (num + den) >= (n + m) * num


def _compatible(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of docs.

    Two documents link when den * shared >= num * united of their shingle sets;
    component_id is the smallest id that links lead to, one's own included.
    n_links counts the verified links of the document's class to other classes,
    of which the join needs no more than keep the components together.  Null and
    empty texts, and texts without words, have no shingles and link with nothing:
    component_id is their own id, null for a null id.  Rows that repeat an id are
    rows of their own.  Equal rows and copies share a class.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketch(batches):
        for pdf in sliced(batches):
            sets = _sets(pdf["text"].tolist(), shingle)
            prints = [_fingerprint(s) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "h1": [p[0] for p in prints], "h2": [p[1] for p in prints], "first": pd.Series([s[: _region(len(s), num, den)].copy() for s in sets], dtype=object)})

    spark = docs.sparkSession
    steps = Steps(spark)
    sketches = steps.written(rows.mapInPandas(sketch, "doc_id long, n int, h1 long, h2 long, first array<bigint>").withColumn("rid", F.monotonically_increasing_id()))
    ids = steps.written(sketches.select("rid", "doc_id", "n", "h1", "h2"))
    classes = steps.written(ids.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("rid").alias("cls"), F.min("doc_id").alias("low")))
    reps = sketches.select("rid", "first").join(classes.select("cls", "n", "h1", "h2"), F.col("rid") == F.col("cls")).select("cls", "n", "first")
    reps = steps.written(reps.filter(_has_partners("n", num, den)))
    steps.drop(sketches)

    # How often a shingle stands among those kept of a set; only what repeats is kept.
    repeated = steps.written(reps.select(F.explode("first").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    sizes = {r["n"]: r["k"] for r in reps.filter(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    totals = reps.agg(F.sum(F.size("first")).alias("entries")).first()
    spread = {r["log"]: (r["shingles"], r["scanned"]) for r in repeated.groupBy(F.floor(F.log2("k")).cast("int").alias("log")).agg(F.count(F.lit(1)).alias("shingles"), F.sum(F.least("k", F.lit(SHORT_LIST)) * F.col("k")).alias("scanned")).collect()}
    scanned = sum(s for _, s in spread.values()) + (totals["entries"] or 0)
    limit = boundary(sizes, scanned / max(1, totals["entries"] or 0), num, den)
    _LOG.info("sets of up to %d shingles are joined by subsets, larger ones by lists", limit)
    level = SHORT_LIST
    while sum(c for log, (c, _) in spread.items() if 2**log >= level) > FREQUENT:
        level *= 2
    frequent = np.sort(repeated.filter(F.col("k") >= level).select("t").toPandas()["t"].to_numpy(np.int64))
    steps.drop(repeated)
    shared = spark.sparkContext.broadcast(frequent)

    def parts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared.value, s)
        known = (at < len(shared.value)) & (shared.value[np.minimum(at, max(len(shared.value) - 1, 0))] == s) if len(shared.value) else np.zeros(len(s), bool)
        return s[~known], s[known]

    def listing(batches):
        """Keys of the lists (kind 1) and of subsets (kind 3); a set that can't fill its listed part comes as kind 0."""
        for pdf in sliced(batches):
            keys, kinds, ids, ns, places = [], [], [], [], []
            for cls, n, first in zip(pdf["cls"], pdf["n"], pdf["first"]):
                if n <= limit:
                    for c in subset_sizes(n, limit, num, den):
                        rows_ = np.array(list(combinations(first.tolist(), c)), np.int64).view(np.uint64)
                        h = np.full(len(rows_), c, np.uint64)
                        for k in range(c):
                            h = mix(h * np.uint64(3) + rows_[:, k])
                        keys.append(h.view(np.int64))
                        kinds.append(np.full(len(h), 3))
                        ids.append(np.full(len(h), cls))
                        ns.append(np.full(len(h), n))
                        places.append(np.zeros(len(h), np.int64))
                if n < num * (limit + 1) // den:
                    continue
                light, _ = parts(np.asarray(first))
                most = listed(n, num, den)
                key = light[:most] if len(light) >= most else np.zeros(1, np.int64)
                keys.append(key)
                kinds.append(np.full(len(key), 1 if len(light) >= most else 0))
                ids.append(np.full(len(key), cls))
                ns.append(np.full(len(key), n))
                places.append(np.arange(len(key)))
            if keys:
                yield pd.DataFrame({"kind": np.concatenate(kinds), "t": np.concatenate(keys), "cls": np.concatenate(ids), "n": np.concatenate(ns), "pos": np.concatenate(places), "central": 0})

    entry = "kind int, t long, cls long, n int, pos int, central long"
    emitted = steps.written(reps.mapInPandas(listing, entry))
    steps.drop(reps)
    again = emitted.filter("kind = 0").select("cls", "n")

    # Whole sets of some classes, read from the texts; a bitmap keeps other rows out early.
    by_class = classes.select("cls", "n", "h1", "h2", "low")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        named = steps.written(wanted.join(by_class, "cls"))
        bits = spark.sparkContext.broadcast(_bitmap(named, ["low"], lambda pdf: _id_key(pdf["low"])))

        def read(batches):
            for pdf in sliced(batches):
                mine = pdf[_in_bitmap(bits.value, _id_key(pdf["doc_id"]))]
                if not len(mine):
                    continue
                sets = _sets(mine["text"].tolist(), shingle)
                prints = [_fingerprint(s) for s in sets]
                yield pd.DataFrame({"n": [len(s) for s in sets], "h1": [p[0] for p in prints], "h2": [p[1] for p in prints], "low": mine["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "s": pd.Series(sets, dtype=object)})

        found = rows.mapInPandas(read, "n int, h1 long, h2 long, low long, s array<bigint>")
        return found.join(named, (found["n"] == named["n"]) & (found["h1"] == named["h1"]) & (found["h2"] == named["h2"]) & found["low"].eqNullSafe(named["low"])).select("cls", named["n"], "s")

    # The sets that are ordered again: by exact counts among themselves, shingles that stand alone first.
    sat = steps.written(whole_sets(again.select("cls")).dropDuplicates(["cls"]))
    entries = sat.select("cls", "n", F.explode("s").alias("t"))
    counts = entries.groupBy("t").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared_only = entries.join(counts, "t").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("kt"))
    alone = F.col("n") - F.size("kt")
    most = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + MATCHES
    # how common a set's shingles are: the original of a family of copies has the most common ones
    central = F.floor(F.aggregate("kt", F.lit(0).cast("long"), lambda a, x: a + x["k"]) / F.col("n"))
    kept = shared_only.filter(F.size("kt") >= F.ceil(F.col("n") * num / den)).select(F.lit(2).alias("kind"), F.posexplode(F.slice("kt", F.lit(1), F.greatest(most - alone, F.lit(0)))["t"]).alias("i", "t"), "cls", "n", alone.alias("alone"), central.alias("central"))
    # the shingles that stand alone come first in the order
    kept = kept.select("kind", "t", "cls", "n", (F.col("i") + F.col("alone")).alias("pos"), "central")

    def first_order(batches):
        for pdf in sliced(batches):
            out = []
            for s, n in zip(pdf["s"], pdf["n"]):
                light, heavy = parts(np.asarray(s))
                out.append(np.concatenate([light, heavy])[: listed(n, num, den)])
            yield pd.DataFrame({"kind": 1, "t": np.concatenate(out) if out else np.zeros(0, np.int64), "cls": np.repeat(pdf["cls"].to_numpy(), [len(o) for o in out]), "n": np.repeat(pdf["n"].to_numpy(), [len(o) for o in out]), "pos": np.concatenate([np.arange(len(o)) for o in out]) if out else np.zeros(0, np.int64), "central": 0})

    late = sat.mapInPandas(first_order, entry)
    late = steps.written(late.withColumn("new", F.lit(1)).unionByName(kept.withColumn("new", F.lit(0))))
    steps.drop(sat)
    every = emitted.filter("kind > 0").withColumn("new", F.lit(0)).unionByName(late)
    # lists of kind 1 that hold only sets ordered again are left to kind 2
    lists = every.groupBy("kind", "t").agg(F.count(F.lit(1)).alias("k"), F.min("new").alias("new")).filter("k > 1 AND new = 0").select("kind", "t", "k")
    lists = steps.written(every.drop("new").join(lists, ["kind", "t"]).withColumn("long", F.col("k") > SHORT_LIST), by="long")
    steps.drop(emitted, late)

    short, long = lists.filter("NOT long"), lists.filter("long").select("kind", "t", "cls", "n", "pos", "central")
    in_long = long.groupBy("kind", "cls").agg(F.count(F.lit(1)).alias("more"))
    short = short.join(in_long, ["kind", "cls"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    a = short.select("kind", "t", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("more").alias("ma"), F.col("pos").alias("pa"))
    b = short.select("kind", "t", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("more").alias("mb"), F.col("pos").alias("pb"))
    met = a.join(b, ["kind", "t"]).filter((F.col("a") < F.col("b")) & _compatible(F.col("na"), F.col("nb"), num, den))
    met = met.groupBy("kind", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"), F.first("ma").alias("ma"), F.first("mb").alias("mb"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    # without long lists in common the first shingle in common is the first one here
    first = (F.least("ma", "mb") > 0) | _reachable(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den)
    met = met.filter((F.col("kind") == 3) | ((F.col("k") + F.least("ma", "mb") >= MATCHES) & first))
    pairs = steps.written(met.groupBy("a", "b").agg(F.max("k").alias("k")))
    found = _verified(pairs, long, whole_sets, steps, num, den)
    label = components(found, steps)
    degree = found.select(F.col("a").alias("cls")).union(found.select("b")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    # classes that link with nothing are their own component
    named = steps.written(named.join(lows, "label").join(degree, "cls", "left").select("n", "h1", "h2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    steps.drop_all_but(ids, named)
    out = ids.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _id_key(ids) -> np.ndarray:
    x = np.array([-1 if pd.isna(i) else int(i) for i in ids], np.int64)
    return mix(x.view(np.uint64)).view(np.int64)


def _has_partners(n: str, num: int, den: int) -> Column:
    return F.floor(F.col(n) * den / num) > F.ceil(F.col(n) * num / den)


def _verified(pairs: DataFrame, long: DataFrame, whole_sets, steps: Steps, num: int, den: int) -> DataFrame:
    """Links (a, b) that keep the components together, of candidate pairs and long lists: rounds against pivots, then whatever is left between components."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(long.select("cls")).distinct()
    sets = steps.written(whole_sets(wanted).dropDuplicates(["cls"]))

    def links(candidates: DataFrame) -> DataFrame:
        """Those of (a, b) that link."""
        x = candidates.join(sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        x = x.join(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return x.filter(_compatible(F.col("na"), F.col("nb"), num, den) & (shared * (num + den) >= (F.col("na") + F.col("nb")) * num)).select("a", "b")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # first, each set against the candidate it shares most with
    tried = pairs.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")
    found, done, label = None, None, None
    for round_ in range(ROUNDS):
        members = long if label is None else long.join(label, long["cls"] == label["node"], "left").select("kind", "t", "cls", "n", "pos", "central", F.coalesce("label", "cls").alias("comp"))
        members = members.withColumn("comp", F.col("cls")) if label is None else members
        # the pivot is the most central member, in later rounds any of the central ones: what links to any member mostly links to it
        share = -F.col("central") if not round_ else -F.floor(F.log2(F.col("central") + 1) * 4)
        central = F.struct(share.alias("share"), F.xxhash64(F.col("cls"), F.lit(round_)).alias("h"), "cls", "comp", "n", "pos")
        whole = members.groupBy("kind", "t").agg(F.min(central).alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        against = members.join(whole.select("kind", "t", "pivot"), ["kind", "t"]).filter((F.col("comp") != F.col("pivot.comp")) & _compatible(F.col("n"), F.col("pivot.n"), num, den) & _reachable(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"), num, den)).select(*ordered(F.col("cls"), F.col("pivot.cls"))).distinct()
        new = against if round_ else against.union(tried).distinct()
        new = steps.written(new.join(done, ["a", "b"], "left_anti") if done is not None else new)
        if round_ and not new.limit(1).count():
            break
        fresh = steps.written(links(new))
        done = new if done is None else done.union(new)
        found = fresh if found is None else found.union(fresh)
        if label is not None:
            steps.drop(label)
        label = components(found, steps)
        if round_ and not _left(long, label, RESIDUAL, num, den):
            break
    # whatever lies between components and wasn't tried: the rest of the pairs, and the rest of the long lists
    rest = _scanned(long, label, num, den)
    apart = pairs.select("a", "b").join(label.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b", "left")
    apart = apart.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    last = steps.written(rest.union(apart).distinct().join(done, ["a", "b"], "left_anti"))
    return steps.written(found.union(links(last)).distinct())


def _scanned(long: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the long lists that lie in two components and can link.

    Sizes fall into classes a factor den / num apart, so partners stand in one class
    or in neighbouring ones; in each class one side is dealt out over as many
    parts as DEALT goes into it, and the other side meets every part.
    """
    open_ = long.join(label, long["cls"] == label["node"], "left").select("kind", "t", "cls", "n", "pos", F.coalesce("label", "cls").alias("comp"))
    # an entry that is reachable for no partner, not even the smallest, pairs with nothing
    open_ = open_.filter(_reachable(F.col("n"), F.col("pos"), F.ceil(F.col("n") * num / den).cast("int"), F.lit(0), num, den))
    # a little wider than den / num, so that rounding parts no partners
    open_ = open_.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / (log(den / num) * 1.001)).cast("int"))
    mixed = open_.groupBy("kind", "t").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("kind", "t")
    counts = open_.join(mixed, ["kind", "t"]).groupBy("kind", "t", "size").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
    x = open_.join(counts, ["kind", "t", "size"]).select("kind", "t", "size", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")
    y = open_.select("kind", "t", near, F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    y = y.join(counts, ["kind", "t", "size"]).select("kind", "t", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b", "nb", "pb", "cb")
    met = x.join(y, ["kind", "t", "size", "part"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    return met.filter(_compatible(F.col("na"), F.col("nb"), num, den) & _reachable(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den)).select("a", "b")


def _left(long: DataFrame, label: DataFrame, most: int, num: int, den: int) -> bool:
    """Whether the long lists still hold more than about `most` pairs between components, counted among entries that reach a set of their size."""
    members = long.filter(_reachable(F.col("n"), F.col("pos"), F.col("n"), F.col("pos"), num, den)).join(label, long["cls"] == label["node"], "left").select("kind", "t", F.coalesce("label", "cls").alias("comp"))
    sizes = members.groupBy("kind", "t", "comp").agg(F.count(F.lit(1)).cast("double").alias("k"))
    pairs = sizes.groupBy("kind", "t").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"))
    return (pairs.agg(F.sum("pairs")).first()[0] or 0) > most


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near duplicates: of each component the row with the smallest id stays, and of rows that repeat that id all.

    Rows with a null id or without shingles stay.
    """
    found = similar_components(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__low")).filter("__id <> __low").select("__id").distinct()
    return docs.join(found, docs[id_col] == found["__id"], "left_anti")
