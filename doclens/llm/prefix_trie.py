"""The trie of all prefixes of conversations, built by cutting sequences at half depth.

Sequences lie in blocks of BLOCK turns.  Names go down, totals come back up, and both by
the same recursion, all sequences and both halves of each at once:

* Names.  A segment of 2k blocks, which has a name for the prefix it starts from and
  one for that it ends in, is cut into an upper half and a lower one.  The prefix at
  the cut gets a name from the first of these and the hash of the upper half: there a path of
  the upper trie ends, and a tree of the lower forest is rooted.  After log2(blocks) cuts each
  block has its root's name, which hangs on the prefix alone, not on what follows.
* Blocks that share root and turns are one from then on, with the number of their
  sequences and the least of them.  Their turns are named in order: nodes.
* Totals.  A node belongs to its least member, so each sequence owns the lower end of its
  path, and the trie is a forest of such ends.  What a sequence owns in lower
  halves is added up, and grafted onto all blocks above the cut.

Work on segments halves with each level.  No step holds a sequence or the members
of a node together: both may be a large part of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps
from .order import listed_sha256, positions, sorted_rows

#: Turns of a block, and conversations that share the first turns of one of them.
BLOCK, FAMILY = 4, 20
#: The root's name.
ROOT = b""
WORDS = r"[^\x20\x09-\x0D]+"


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def rebuilt(turns: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length), (conv_id, pos, key, words, length)): rebuilt conversations, and their turns.

    turns: conv_id, turn, role, text.  pos counts from 0; key stands for role and text; turnless
    conversations are in the first table only.
    """
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    key = _sha(F.unhex(F.sha2("role", 256)), F.unhex(F.sha2("text", 256)))
    held = sorted_rows(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], steps, lambda df: df.select("conv_id", key.alias("key"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")))
    own = steps.written(positions(held, "conv_id"))
    steps.drop(held)
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    sizes = own.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    convs = sizes.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = steps.written(convs)
    heads = own.filter(f"conv_id % {FAMILY} = 0 AND pos < 3").withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").filter("pos < taken").select("conv_id", "pos", "key", "words", "length")
    rest = own.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words", "length")
    return convs.select("conv_id", "length"), first.unionByName(rest)


def _recursion(blocks: DataFrame, steps: Steps, zero: Column, merge: Callable[[Column, Column], Column], hand: Callable[[Column, Column, Column], tuple[Column, Column]]) -> DataFrame:
    """blocks (conv_id, j, n_blocks, v) with `held`: what reaches each block from the halves that it isn't in.

    Upward, merge(left, right) is the value of two halves, never null though right may be; downward, hand(held, left, right)
    gives what their segment holds to the one half and to the other.  A sequence
    takes part in as many levels as it has cuts.
    """
    longest = blocks.agg(F.max("n_blocks")).first()[0] or 0
    levels, below, span = [], blocks, 1
    while span < longest:
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("v")))
        pairs = below.filter(F.col("n_blocks") > span).groupBy("conv_id", F.floor(F.col("j") / 2).alias("half")).agg(F.first("n_blocks").alias("n_blocks"), side(0).alias("left"), side(1).alias("right"))
        below = steps.written(pairs.select("conv_id", F.col("half").alias("j"), "n_blocks", "left", "right", merge(F.col("left"), F.col("right")).alias("v")))
        levels.append(below)
        span *= 2
    held = None
    for pairs in reversed(levels):
        met = pairs.withColumn("held", zero) if held is None else pairs.join(held, ["conv_id", "j"], "left").withColumn("held", F.coalesce("held", zero))
        upper, lower = hand(F.col("held"), F.col("left"), F.col("right"))
        halves = F.array(F.struct((F.col("j") * 2).alias("j"), upper.alias("held")), F.when(F.col("right").isNotNull(), F.struct((F.col("j") * 2 + 1).alias("j"), lower.alias("held"))))
        given = steps.written(met.select("conv_id", F.explode(F.array_compact(halves)).alias("x")).select("conv_id", "x.j", "x.held"))
        steps.drop(pairs, *([held] if held is not None else []))
        held = given
    return blocks.withColumn("held", zero) if held is None else blocks.join(held, ["conv_id", "j"], "left").withColumn("held", F.coalesce("held", zero))


def _path(root: Column, end: Column, turns: Column) -> Column:
    """The names of a block's root and of the prefixes that end at each of its turns; a full block ends where the next one's root is."""
    names = F.aggregate(F.slice(turns, 1, BLOCK - 1), F.array(root), lambda names, t: F.concat(names, F.array(_sha(F.element_at(names, -1), t["key"]))))
    return F.when(F.size(turns) == BLOCK, F.concat(names, F.array(end))).otherwise(names)


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; turns has conv_id, turn, role and text.

    Turns that share a number are ordered by role, then text, by code point.  Rows
    without a conv_id belong to no conversation and take no part; rows that
    repeat stay as turns of their own.  An empty table gives no node, as there is no
    member to name one by; other columns are not read.
    """
    steps = Steps(turns.sparkSession)
    convs, rows = rebuilt(turns, steps)
    block = F.floor(F.col("pos") / BLOCK).alias("j")
    grouped = rows.groupBy("conv_id", block).agg(F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("turns"))
    content = _sha(F.concat(*[F.coalesce(F.get(F.transform("turns", lambda t: t["key"]), F.lit(i)), F.lit(b"")) for i in range(BLOCK)]))
    blocks = steps.written(grouped.select("conv_id", "j", "length", F.ceil(F.col("length") / BLOCK).alias("n_blocks"), "turns", content.alias("v")))
    pair = lambda root, end: F.struct(root.alias("root"), end.alias("end"))
    cut = lambda held, upper: _sha(held["root"], upper)
    top = pair(F.lit(ROOT), _sha(F.lit(ROOT), F.col("v")))
    named = _recursion(blocks.select("conv_id", "j", "n_blocks", "v"), steps, top, lambda a, b: _sha(a, F.coalesce(b, F.lit(ROOT))), lambda held, a, b: (pair(held["root"], cut(held, a)), pair(cut(held, a), held["end"])))
    named = steps.written(named.select("conv_id", "j", "v", "held.root", "held.end").join(blocks.drop("v"), ["conv_id", "j"]))
    steps.drop(blocks)

    distinct = named.groupBy("root", "v").agg(F.first("j").alias("j"), F.first("turns").alias("turns"), F.first("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    distinct = steps.written(distinct.withColumn("path", _path(F.col("root"), F.col("end"), F.col("turns"))))
    each = distinct.select("j", "turns", "n", "conv_id", "path", F.posexplode("turns").alias("i", "t"))
    each = each.select(F.element_at("path", F.col("i") + 2).alias("name"), F.element_at("path", F.col("i") + 1).alias("parent"), (F.col("j") * BLOCK + F.col("i") + 1).alias("depth"), F.col("t")["words"].alias("words"), "n", "conv_id")
    below = each.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")
    nodes = below.unionByName(top)
    children = below.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = steps.written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))

    # what each conversation owns in its blocks; lower halves are grafted onto what lies above them
    owned = nodes.filter("depth > 0").groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("j")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.collect_list(F.struct("depth", "leaf", "saved")).alias("own"))
    sums = F.struct(F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    none = F.struct(F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    plus = lambda a, b: F.when(b.isNull(), a).otherwise(F.struct((a["leaf"] + b["leaf"]).alias("leaf"), (a["saved"] + b["saved"]).alias("saved")))
    values = steps.written(named.select("conv_id", "j", "root", "v", F.ceil(F.col("length") / BLOCK).alias("n_blocks")).join(owned, ["conv_id", "j"], "left").select("conv_id", "j", "n_blocks", "root", F.col("v").alias("content"), sums.alias("v"), "own"))
    grafted = _recursion(values.select("conv_id", "j", "n_blocks", "v"), steps, none, plus, lambda held, a, b: (plus(held, b), held))
    grafted = grafted.select("conv_id", "j", "held").join(values, ["conv_id", "j"])
    totals = grafted.groupBy("root", F.col("content").alias("v")).agg(F.sum("held.leaf").alias("leaf"), F.sum("held.saved").alias("saved"), F.max("own").alias("own"))
    spread = distinct.select("root", "v", "j", "path").join(totals, ["root", "v"]).select("j", "leaf", "saved", "own", F.posexplode(F.slice("path", 2, BLOCK)).alias("i", "name"))
    mine = lambda what: F.aggregate(F.coalesce("own", F.array()), F.lit(0).cast("long"), lambda s, o: s + F.when(o["depth"] > F.col("j") * BLOCK + F.col("i"), o[what]).otherwise(0))
    subtree = spread.select("name", (F.col("leaf") + mine("leaf")).alias("n_leaves"), (F.col("saved") + mine("saved")).alias("saved_tokens")).groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    whole = nodes.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(F.lit(ROOT).alias("name"), "n_leaves", "saved_tokens")
    subtree = subtree.unionByName(whole)

    last = named.filter("j = n_blocks - 1").select("conv_id", F.element_at(_path(F.col("root"), F.col("end"), F.col("turns")), -1).alias("name"))
    ends = last.unionByName(convs.filter("length = 0").select("conv_id", F.lit(ROOT).alias("name")))
    hashes = listed_sha256(ends, "name", "conv_id", steps).withColumnRenamed("sha256", "ends_sha256")

    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(subtree, "name").join(hashes, "name", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
