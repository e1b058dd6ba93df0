"""Symbol links, base classes and inherited members against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidelark.operators import hierarchy as H

SYMBOL = "sym_id long, file long, name string, fqn string, parent string, kind string, role string, start long, stop long"
VISIBLE = "file long, target long"


def got(df):
    return {tuple(r) for r in df.collect()}


def by_hand(symbols, visible):
    """Links by the rule, one use at a time."""
    defs = [s for s in symbols if s[6] == "definition" and s[2] is not None]
    decls = [s for s in symbols if s[6] == "declaration"]
    unified = {}
    for s in decls:
        same = [x for x in defs if x[3] == s[3]]
        if len(same) == 1:
            unified[s[0]] = same[0][0]
    links = set()
    for u in symbols:
        if u[6] != "use" or u[2] is None:
            continue
        seen = {t for f, t in visible if f == u[1]} | {u[1]}
        left = [x for x in defs if x[1] in seen and (x[2] == u[2] if u[5] == "call" else x[3] == u[3]) and not (x[1] == u[1] and x[7] < u[7] and x[8] >= u[8])]
        if len(left) == 1:
            links.add((u[0], left[0][0]))
            continue
        found = [unified[x[0]] for x in decls if x[1] in seen and x[3] == u[2] and x[0] in unified]
        if found:
            links.add((u[0], found[0]))
    return links


def test_a_call_inside_the_only_definition_is_no_link_to_it(spark):
    rows = [
        (1, 1, "f", "f", None, "callable", "definition", 0, 100),
        (2, 1, "f", "f", "f", "call", "use", 50, 60),
        (3, 1, "f", "f", None, "call", "use", 200, 210),
        (4, 2, "f", "f", None, "call", "use", 5, 6),
    ]
    found = got(H.linked(spark.createDataFrame(rows, SYMBOL), spark.createDataFrame([(3, 1)], VISIBLE)))
    assert found == {(3, 1)}


def test_a_declaration_leads_to_the_only_definition(spark):
    rows = [
        (1, 1, "f", "f", None, "callable", "definition", 0, 9),
        (2, 2, "f", "f", None, "callable", "declaration", 0, 0),
        (3, 3, "f", "f", None, "call", "use", 5, 6),
        (4, 1, "g", "g", None, "callable", "definition", 20, 29),
        (5, 4, "g", "g", None, "callable", "definition", 0, 9),
        (6, 2, "g", "g", None, "callable", "declaration", 1, 1),
        (7, 3, "g", "g", None, "call", "use", 7, 8),
    ]
    symbols = spark.createDataFrame(rows, SYMBOL)
    assert got(H.declared(symbols)) == {(2, 1)}
    assert got(H.linked(symbols, spark.createDataFrame([(3, 2)], VISIBLE))) == {(3, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_the_rule_on_random_symbols(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        role = rng.choice(["definition", "definition", "declaration", "use", "use", "use"])
        kind = rng.choice(["call", "type"]) if role == "use" else "callable"
        name = rng.choice(["a", "b", "c", "d", None])
        start = rng.randrange(60)
        rows.append((i + 1, rng.randrange(5), name, f"{rng.choice(['x.', '', ''])}{name}", None, kind, role, start, start + rng.randrange(25)))
    visible = [(rng.randrange(5), rng.randrange(5)) for _ in range(6)]
    assert got(H.linked(spark.createDataFrame(rows, SYMBOL), spark.createDataFrame(visible, VISIBLE))) == by_hand(rows, visible)


CLASSES = [(i, 1, n, n, None, "class", "definition", i, i) for i, n in enumerate("ABCDE", 1)]


def order_of(spark, names):
    """Linearised order of classes A to E with the base names given."""
    classes = spark.createDataFrame(CLASSES, SYMBOL)
    rows = [("ABCDE".index(c) + 1, 1, k, b) for c, bases in names.items() for k, b in enumerate(bases)]
    bases = spark.createDataFrame(rows, "class_id long, file long, position int, name string")
    found = H.base_classes(classes, bases, spark.createDataFrame([], VISIBLE))
    return H.linearised(classes, found)


def test_the_nearest_class_hides_others_over_three_levels(spark):
    order = order_of(spark, {"A": ["B"], "B": ["C", "D"], "C": ["E"], "D": ["E"]})
    mine = [r["ancestor"] for r in order.where("class_id = 1").orderBy("depth", "place").collect()]
    assert mine == [1, 2, 3, 4, 5]
    members = spark.createDataFrame([(5, "deep", 50), (2, "near", 20), (5, "near", 51), (4, "both", 40), (3, "both", 30)], "owner long, name string, def_id long")
    uses = spark.createDataFrame([(1, 1, "deep"), (2, 1, "near"), (3, 1, "both"), (4, 5, "both"), (5, 4, "near"), (6, 1, None)], "use_id long, class_id long, name string")
    assert got(H.inherited(uses, members, order)) == {(1, 50, 5, 3), (2, 20, 2, 1), (3, 30, 3, 2), (5, 51, 5, 1)}


def test_nearest_members_equal_those_of_the_linearised_order(spark):
    r = random.Random(5)
    ids = range(14)
    classes = spark.createDataFrame([(i,) for i in ids], "sym_id long")
    bases = spark.createDataFrame([(i, k, r.choice([j for j in ids if j >= i - 3])) for i in ids for k in range(2)], "class_id long, position int, base_id long")
    members = spark.createDataFrame([(r.choice(ids), r.choice("abcd"), 100 + k) for k in range(12)] + [(99, "a", 1)], "owner long, name string, def_id long")
    uses = spark.createDataFrame([(i, r.choice([*ids, 99]), r.choice(["a", "b", "c", "d", "e", None])) for i in range(80)], "use_id long, class_id long, name string")
    found = got(H.nearest_members(uses, members, classes, bases))
    assert found == got(H.inherited(uses, members, H.linearised(classes, bases))) and {x[3] for x in found} > {0, 1}


def test_member_calls_make_no_linearised_order(spark, monkeypatch):
    monkeypatch.setattr(H, "linearised", None)
    assert H.QUERIES["g10_inherited_members"](spark, "/root/testdata/sf0.001").columns == ["use_id", "def_id", "owner", "depth"]


def test_hierarchies_in_a_circle_end(spark):
    order = order_of(spark, {"A": ["B"], "B": ["C"], "C": ["A", "C", "missing"]})
    assert got(order.where("class_id < 4").select("class_id", "ancestor", "depth")) == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 1, 2), (3, 3, 0), (3, 1, 1), (3, 2, 2)}


def ordered_by_hand(ids, bases):
    """Nearest places by walking from each class, a depth at a time."""
    out = set()
    for c in ids:
        known = front = {c: ()}
        while front:
            out |= {(c, x, len(place), place) for x, place in front.items()}
            more = {}
            for x, place in front.items():
                for i, k, b in bases:
                    if i == x and b not in known:
                        more[b] = min(more.get(b, (*place, k)), (*place, k))
            known, front = known | more, more
    return out


@pytest.mark.parametrize("back", [0, 3])
def test_the_linearised_order_equals_the_rule_on_random_hierarchies(spark, back):
    r = random.Random(7 + back)
    ids, named = range(12), range(16)
    bases = [(i, k, r.choice([j for j in named if j > i - back])) for i in range(14) for k in (0, 1, 1)]
    found = H.linearised(spark.createDataFrame([(i,) for i in ids], "sym_id long"), spark.createDataFrame(bases, "class_id long, position int, base_id long"))
    assert {(c, a, d, tuple(p)) for c, a, d, p in found.collect()} == ordered_by_hand(ids, bases)
    assert found.count() == len(ordered_by_hand(ids, bases))


def test_only_circles_are_ordered_in_rounds(spark, monkeypatch):
    walked, rounds = [], H._in_rounds
    monkeypatch.setattr(H, "_in_rounds", lambda step: walked.extend(step.collect()) or rounds(step))
    classes = spark.createDataFrame([(i,) for i in range(8)], "sym_id long")
    # 0 to 3 derive one from another, 4 and 5 go round in a circle and reach 6 and 7; 3 names itself too.
    bases = [(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 0, 3), (3, 1, 4), (4, 0, 5), (5, 0, 4), (5, 1, 6), (6, 0, 7)]
    order = H.linearised(classes, spark.createDataFrame(bases, "class_id long, position int, base_id long"))
    assert got(order.where("class_id = 0").select("ancestor", "depth")) == {(i, i) for i in range(8)}
    assert {r["class_id"] for r in walked} == {4, 5, 6}


def test_base_names_take_the_first_visible_class(spark):
    rows = [(7, 9, "A", "m.A", None, "class", "definition", 0, 5), (8, 2, "A", "n.A", None, "class", "definition", 3, 5), (9, 2, "A", "n.A", None, "class", "definition", 1, 2), (1, 4, "B", "B", None, "class", "definition", 0, 1)]
    bases = spark.createDataFrame([(1, 4, 0, "A"), (1, 4, 1, "m.A"), (1, 4, 2, "n.A")], "class_id long, file long, position int, name string")
    found = got(H.base_classes(spark.createDataFrame(rows, SYMBOL), bases, spark.createDataFrame([(4, 2), (4, 3)], VISIBLE)))
    assert found == {(1, 0, 9), (1, 2, 9)}


def test_edges_turned_round(spark):
    rows = [
        (1, 1, "K", "K", None, "class", "definition", 0, 50),
        (2, 2, "K", "K", None, "class", "definition", 0, 50),
        (3, 2, "m", "K.m", "K", "callable", "definition", 5, 20),
        (4, 3, "p", "K.p", "K", "callable", "definition", 5, 20),
        (5, 2, "p", "p", "K.m", "call", "use", 7, 8),
        (6, 1, "m", "K.m", None, "callable", "declaration", 9, 9),
    ]
    symbols = spark.createDataFrame(rows, SYMBOL)
    members = H.members_of(symbols)
    assert got(members) == {(2, "m", 3), (1, "p", 4)}
    links = H.linked(symbols, spark.createDataFrame([(2, 3)], VISIBLE))
    bases = spark.createDataFrame([(1, 0, 2)], "class_id long, position int, base_id long")
    assert got(H.reified(symbols, links, bases, members)) == {
        (4, "usage", 5), (3, "declaration", 6), (3, "calls", 4), (1, "inherits", 2), (2, "inherited_by", 1), (2, "member", 3), (1, "member", 4),
    }


def test_no_symbols(spark):
    symbols, visible = spark.createDataFrame([], SYMBOL), spark.createDataFrame([], VISIBLE)
    bases = spark.createDataFrame([], "class_id long, position int, base_id long")
    assert H.linked(symbols, visible).count() == 0
    assert H.linearised(symbols, bases).count() == 0
    assert H.reified(symbols, H.linked(symbols, visible), bases, H.members_of(symbols)).count() == 0


def test_base_names_are_looked_up_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BASE_ROWS", 50)
    classes = spark.createDataFrame([(i, i // 10, f"C{i % 7}", f"C{i % 7}@{i // 10}", i) for i in range(500)], "sym_id long, file long, name string, fqn string, start long")
    bases = spark.createDataFrame([(i, i // 10, 0, f"C{i * 3 % 7}") for i in range(500)], "class_id long, file long, position int, name string")
    visible = spark.createDataFrame([(f, f // 2) for f in range(50)], VISIBLE)
    found = H.base_classes(classes, bases, visible)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and sum(r["count"] for r in tasks) == 500
    by_hand = {(i, 0, min((f, k) for f in {i // 10, i // 20} for k in range(f * 10, f * 10 + 10) if k % 7 == i * 3 % 7)[1]) for i in range(500)}
    assert got(found) == by_hand
