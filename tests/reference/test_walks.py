"""Shortest ways in the graph against a search from each start."""

import random

from doclens.operators import graph


def brute(edges, start, hops, limit):
    links = {}
    for a, b, t in edges:
        for x, y in ((a, b), (b, a)):
            if x != y:
                links.setdefault(x, {}).setdefault(y, []).append(t)
    ways, front = {start: ()}, {start: ()}
    for _ in range(hops):
        new = {}
        for node, way in front.items():
            for other, types in links.get(node, {}).items():
                if other not in ways:
                    longer = (*way, (min(types), other))
                    new[other] = min(new.get(other, longer), longer)
        kept = sorted(new)[: limit - (len(ways) - 1)]
        front = {n: new[n] for n in kept}
        ways |= front
        if len(ways) > limit:
            break
    return {(start, n, len(w), w) for n, w in ways.items() if n != start}


def test_walks_keep_the_least_shortest_way(spark):
    rng = random.Random(31)
    names = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("ABC")) for _ in range(70)] + [("hub", f"x{i}", "H") for i in range(60)] + [("hub", "n0", "Z"), ("n1", "n1", "A"), ("n1", "n2", "B"), ("n1", "n2", "A")]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    starts = spark.createDataFrame([(n,) for n in [*names, "hub", "nowhere"]], "id string")
    for hops, limit in ((3, 50), (4, 7)):
        got = {(r["start"], r["node"], r["hops"], tuple((p["type"], p["node"]) for p in r["path"])) for r in graph.walks(df, starts, hops, limit).collect()}
        want = set().union(*[brute(edges, n, hops, limit) for n in [*names, "hub", "nowhere"]])
        assert got == want
    assert graph.walks(df.limit(0), starts).count() == 0


def test_display_shows_edges_between_shown_nodes(spark):
    nodes = spark.createDataFrame([("doc:b", "DOCUMENT"), ("sec:1", "SECTION"), ("std:z", "STANDARD"), ("doc:a", "DOCUMENT")], "id string, type string")
    edges = spark.createDataFrame([("doc:a", "std:z", "REFERS_TO"), ("doc:a", "sec:1", "CONTAINS")], "src string, dst string, type string")
    shown, between = graph.display(nodes, edges, 3)
    assert [r["id"] for r in shown.collect()] == ["doc:a", "doc:b", "std:z"] and [(r["src"], r["dst"]) for r in between.collect()] == [("doc:a", "std:z")]
