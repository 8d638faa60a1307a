"""Hierarchies against a walk in plain Python."""

import random

import pytest

from loomgraph.operators.hierarchy import Hierarchy, edges_from_triples

SCHEMA = "parent string, child string"


def walk(edges):
    parent = {}
    for p, c in edges:
        if p is not None and c is not None:
            parent[c] = min(p, parent.get(c, p))
    nodes = set(parent) | set(parent.values())
    out = {}
    for n in nodes:
        path, x = [n], n
        while x in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        out[n] = (None, "", -1) if x in parent else (tuple(reversed(path)), x, len(path) - 1)
    return out


def check(spark, edges):
    want = walk(edges)
    h = Hierarchy(spark.createDataFrame(edges, SCHEMA))
    got = {r["node"]: (tuple(r["path"]) if r["path"] is not None else None, r["root"], r["depth"]) for r in h.nodes.collect()}
    assert got == want
    pairs = {(a, n, len(p) - 1 - i) for n, (p, _, d) in want.items() if d > 0 for i, a in enumerate(p[:-1])}
    assert {tuple(r) for r in h.descendants().collect()} == pairs
    sizes = {r["node"]: r["subtree_size"] for r in h.nodes.collect()}
    for n, (p, _, _) in want.items():
        assert sizes[n] == (1 + sum(a == n for a, _, _ in pairs) if p else None)
    h.ws.drop_all()


def test_chain_star_and_cycles(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(200)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x"), ("z", "hang"), ("hang", "more")]
    loop = [("self", "self"), ("self", "below")]
    check(spark, chain + star + cycle + loop + [("c010", "side"), ("side", "deep"), ("c000", "c001"), (None, "q"), ("q", None)])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(max(0, i - r.choice([1, 1, 3, i])), i)}", f"n{i}") for i in range(1, 120)]
    edges += [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(3)]
    check(spark, edges)


def test_no_links(spark):
    h = Hierarchy(spark.createDataFrame([], SCHEMA))
    assert h.nodes.count() == 0 and h.descendants().count() == 0


def test_links_of_triples(spark):
    rows = [("a", "contains", "b"), ("b", "partOf", "a"), ("c", "partOf", "b"), (None, "contains", "x"), ("a", "calls", "z")]
    t = spark.createDataFrame([(*r, 1) for r in rows], "s string, p string, o string, parent int")  # an extra column with a name of ours
    assert {tuple(r) for r in edges_from_triples(t).collect()} == {("a", "b"), ("b", "c")}


def test_second_parents_are_said(spark):
    edges = [("a", "x"), ("b", "x"), ("x", "y"), ("a", "x"), (None, "x"), ("b", "z")]
    h = Hierarchy(spark.createDataFrame(edges, SCHEMA))
    assert {tuple(r) for r in h.dropped.collect()} == {("x", "b")}
    assert {r["node"]: r["root"] for r in h.nodes.collect()} == {"a": "a", "b": "b", "x": "a", "y": "a", "z": "b"}


def test_hot_parent(spark):
    """One parent with most of all links: its children are joined by broadcast, the result is the same."""
    n = 5_000
    edges = [("hub", f"c{i}") for i in range(n)] + [("top", "mid"), ("mid", "hub")] + [(f"c{i}", f"d{i}") for i in range(200)] + [(f"d{i}", f"e{i}") for i in range(100)]
    h = Hierarchy(spark.createDataFrame(edges, SCHEMA))
    assert h.hot == ["hub"]
    want = walk(edges)
    rows = h.nodes.collect()
    assert {r["node"]: (tuple(r["path"]), r["root"], r["depth"]) for r in rows} == want
    assert {r["node"]: r["subtree_size"] for r in rows if r["node"] in ("hub", "mid", "c0", "c150")} == {"hub": n + 301, "mid": n + 302, "c0": 3, "c150": 2}
