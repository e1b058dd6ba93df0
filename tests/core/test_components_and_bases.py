"""Strongly connected components and best common ancestors, held against brute force."""

import random
from collections import defaultdict

import pytest

from tidelark.operators import catalog, components


def reach_by_hand(edges):
    to, nodes = defaultdict(set), sorted({n for e in edges for n in e})
    for a, b in edges:
        to[a].add(b)
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = seen
    return out


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(1, 30, 25), (2, 30, 45), (3, 12, 60), (4, 60, 70)])
def test_components_and_reach_equal_brute_force(spark, monkeypatch, seed, nodes, edges):
    r = random.Random(seed)
    pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)] + [(100, 101), (101, 100), (200, 200), (300, 301), (301, 302)]
    if seed == 3:  # colours from the first round on
        monkeypatch.setattr(components, "FEW", 2.0)
    reach = reach_by_hand(pairs)
    got = {x.node: (x.component, x.reach) for x in components.components_with_reach(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: (min(m for m in reach[n] if n in reach[m]), len(reach[n])) for n in reach}


def test_long_cycles_and_chains_settle(spark, monkeypatch):
    """A cycle of 100,000 nodes and a chain into it: few rounds, and never more rows than edges."""
    rows = []
    cut = components.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "edges":
            rows.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    n = 100_000
    cycle = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    chain = spark.range(n, n + 20_000).selectExpr("id AS src", f"IF(id = {n}, 5, id - 1) AS dst")
    found = components.strong_components(cycle.unionByName(chain))
    assert found.where("component = 0").count() == n and found.where("component = node AND node > 0").count() == 20_000
    assert rows == sorted(rows, reverse=True) and rows[0] == 120_000 and len(rows) < 80


def test_reach_of_chains_and_trees_makes_no_closure(spark, monkeypatch):
    from tidelark.operators import graphs

    made = []
    monkeypatch.setattr(graphs, "cut", lambda df, name, cut=graphs.cut: made.append(cut(df, name)) or made[-1])
    n = 3_000
    chain = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    got = components.reach_sizes(chain, spark.range(n).selectExpr("id AS node", "1 AS size")).selectExpr(f"count_if(reach = {n} - node) AS n").first()
    assert got.n == n
    assert sum(t.count() for t in made) < components.SMALL**2


@pytest.mark.parametrize("seed", [0])
def test_rounds_of_reach_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(components, "SMALL", 0)
    monkeypatch.setattr(components, "FEW", 0.02)
    r = random.Random(seed)
    pairs = [(i, r.randrange(i + 1, 62)) for i in range(60) for _ in range(r.choice([0, 1, 1, 1, 2]))]
    reach = reach_by_hand(pairs)
    nodes = spark.createDataFrame([(i, i % 3 + 1) for i in reach], "node long, size long")
    got = {x.node: x.reach for x in components.reach_sizes(spark.createDataFrame(pairs, "src long, dst long").distinct(), nodes).collect()}
    assert got == {i: sum(j % 3 + 1 for j in reach[i]) for i in reach}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert components.components_with_reach(none).count() == 0


def bases_by_hand(edges, heads):
    reach = reach_by_hand([*edges, *((n, n) for _, n in heads)])
    groups = defaultdict(set)
    for g, n in heads:
        groups[g].add(n)
    out = set()
    for g, ns in groups.items():
        common = set.intersection(*(reach[n] for n in ns))
        out |= {(g, c) for c in common if not any(c in reach[o] for o in common - {c})}
    return out


def test_bases_of_a_fork_that_groups_share(spark):
    # x is where y and z fork; both groups have the same heads but for one.
    edges = [("a2", "a1"), ("a3", "a2"), ("x", "a3"), ("y", "x"), ("z", "x"), ("w", "y")]
    heads = [("g", "y"), ("g", "z"), ("h", "w"), ("h", "z"), ("one", "a3"), ("apart", "a1"), ("apart", "lost")]
    got = catalog.merge_bases(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(heads, "group string, node string"))
    assert {tuple(r) for r in got.collect()} == {("g", "x"), ("h", "x"), ("one", "a3")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bases_equal_brute_force(spark, seed):
    """Several bases, two to four heads, groups that share commits."""
    r = random.Random(seed)
    edges = [(n, p) for n in range(1, 60) for p in {max(0, n - r.randint(1, 6)) for _ in range(r.choice([1, 1, 2]))} if r.random() < 0.97]
    heads = [(g, r.randrange(30, 60)) for g in range(12) for _ in range(2 + g % 3)]
    got = catalog.merge_bases(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(heads, "group long, node long"))
    assert {tuple(x) for x in got.collect()} == bases_by_hand(edges, heads)


def test_each_reached_row_is_written_once(spark, monkeypatch):
    from tidelark.operators import graphs

    made = []
    monkeypatch.setattr(graphs, "cut", lambda df, name, cut=graphs.cut: made.append((name, cut(df, name))) or made[-1][1])
    edges = spark.createDataFrame([(i, i - k) for i in range(30) for k in (2, 3) if i >= k], "src long, dst long")
    heads = spark.createDataFrame([(g, n) for g in range(4) for n in (29, 28)], "group long, node long")
    assert sorted(map(tuple, catalog.merge_bases(edges, heads).collect())) == [(g, n) for g in range(4) for n in (25, 26)]
    rows = [(r.seed, r.node) for name, t in made if name not in ("jumps", "others") for r in t.collect()]
    assert len(rows) == len(set(rows)) and {s for s, _ in rows} == {28, 29}
