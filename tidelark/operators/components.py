"""Strongly connected components without a closure, and what they reach.

Each round works on what is left of the edges, which never become more:

* nodes without edges in or out are components of their own (trimming);
* a node with one edge out, or one in, is folded into that neighbour, its anchor: its other edges go over to the anchor.  It is
  in the anchor's component just if one of its other neighbours is, which is looked up when all later rounds are done.  A coin
  for each node and round keeps an anchor from being folded itself, so chains, trees and cycles of any length halve in a few
  rounds;
* where few nodes can be folded, every node takes the largest node that reaches it for its colour, along edges until nothing
  changes; those that reach their colour backwards within it are its component.

Reach is counted over the components' own graph only, by `reach_sizes`; a closure is made of what is branched on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.plans.standins import table
from tidelark.sources.stores import cut

#: Below this share of nodes that a round folds or trims, components are coloured.
FEW = 0.1
#: Nodes whose closure is made at once, at most half a million pairs.
SMALL = 1_000


def _coin(node, turn: int):
    return F.pmod(F.xxhash64(F.col(node), F.lit(turn)), F.lit(2)) == 1


def _folding(edges: DataFrame, turn: int) -> DataFrame:
    """node, anchor (null: not folded), trimmed of the nodes of edges."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outs"), F.min("dst").alias("to"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("of"))
    x = outs.join(ins, "node", "full").withColumn("trimmed", F.col("outs").isNull() | F.col("ins").isNull())
    anchor = F.when(F.col("trimmed"), None).when(F.col("outs") == 1, F.col("to")).when(F.col("ins") == 1, F.col("of"))
    return x.select("node", F.when(_coin("node", turn), anchor).alias("anchor"), "trimmed").withColumn("anchor", F.when(~_coin("anchor", turn), F.col("anchor")))


def _renamed(edges: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Edges whose `column` is its anchor where it has one; names (node, anchor)."""
    x = edges.join(names.select(F.col("node").alias(column), F.col("anchor").alias("_anchor")), column, "left")
    return x.withColumn(column, F.coalesce("_anchor", column)).drop("_anchor")


def _coloured(edges: DataFrame) -> DataFrame:
    """node, component of the components that the largest node reaching a node leads to."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = cut(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        came = edges.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
        new = cut(colours.join(came, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("changed")), "colours")
        colours = new.select("node", "colour")
        if new.where("changed").isEmpty():
            break
    inner = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
    inner = cut(inner.select("src", "dst"), "inner")
    found = front = cut(colours.where("node = colour").select("node", F.col("colour").alias("component")), "found")
    while not front.isEmpty():
        step = inner.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct()
        front = cut(step.join(found, "node", "left_anti"), "front")
        found = cut(found.unionByName(front), "found")
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (src, dst)."""
    left = cut(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "nodes")
    merged: list[DataFrame] = []  # node, component of nodes that aren't components by themselves
    folded: list[DataFrame] = []  # node, anchor, other: by round
    turn = 0
    while not left.isEmpty():
        turn += 1
        x = cut(_folding(left, turn), "folding")
        n, done = x.agg(F.count("*"), F.count_if("trimmed") + F.count("anchor")).first()
        if done < FEW * n:
            found = cut(_coloured(left), "coloured")
            merged.append(found.where("node <> component"))
            gone = found.select("node")
            left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
            continue
        names = x.where("anchor IS NOT NULL").select("node", "anchor")
        trimmed = x.where("trimmed").select("node")
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(left.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        # The edge to the anchor is left out once: an anchor that is a neighbour both ways stays among the others.
        beside = both.join(names, "node").groupBy("node", "anchor", "other").agg(F.count("*").alias("times")).where("other <> anchor OR times > 1")
        folded.append(cut(_renamed(beside.select("node", "anchor", "other"), names, "other"), "folded"))
        # What led only to, or came only from, a trimmed node goes with it.
        new = _renamed(_renamed(left, names, "src"), names, "dst").where("src <> dst").select("src", "dst").distinct()
        left = cut(new.join(trimmed.withColumnRenamed("node", "src"), "src", "left_anti").join(trimmed.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")

    # A node that no table of `merged` has is a component of its own, so only merged ones are written and looked up.
    out = _union(merged, nodes)
    for f in reversed(folded):
        a = f.join(out.select(F.col("node").alias("anchor"), F.col("component").alias("ca")), "anchor", "left").withColumn("ca", F.coalesce("ca", "anchor"))
        a = a.join(out.select(F.col("node").alias("other"), F.col("component").alias("co")), "other", "left").where("coalesce(co, other) = ca")
        new = cut(a.groupBy("node").agg(F.max("ca").alias("component")), "merged")
        if not new.isEmpty():
            merged.append(new)
            out = _union(merged, nodes)
    # By the smallest node: the one that the others were merged into takes that name too.
    least = cut(out.groupBy("component").agg(F.least(F.min("node"), F.col("component")).alias("least")), "least")
    named = out.join(least, "component").select("node", F.col("least").alias("component")).unionByName(least.select(F.col("component").alias("node"), F.col("least").alias("component")))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _union(tables: list[DataFrame], nodes: DataFrame) -> DataFrame:
    out = nodes.limit(0).withColumn("component", F.col("node"))
    for t in tables:
        out = out.unionByName(t)
    return out


def reach_sizes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, reach: the sizes (node, size) of all that each node reaches in a graph without circles, itself included.

    Nodes are taken out in rounds, with what was `held` by them.  One with at most one edge out reaches what it holds and what that
    neighbour reaches; if one edge leads to it, the node before it holds it from then on, and if none does, no other counts it.  A
    coin keeps a node and the one that is to hold it from going at once.  Only for what no round takes out is a closure made.
    """
    from tidelark.operators.graphs import closure

    nothing = sizes.select(F.col("node").alias("dst")).schema["dst"].dataType
    # A row without dst is a node and what it holds.
    left = sizes.select(F.col("node").alias("src"), F.lit(None).cast(nothing).alias("dst"), F.col("size").cast("long").alias("held"))
    left = cut(left.unionByName(edges.select("src", "dst", F.lit(0).cast("long").alias("held"))), "reach-edges")
    gone: list[DataFrame] = []  # node, to, before, held: by round
    turn = 0
    while True:
        turn += 1
        outs = left.groupBy(F.col("src").alias("node")).agg(F.count("dst").alias("outs"), F.min("dst").alias("to"), F.sum("held").alias("held"))
        ins = left.where("dst IS NOT NULL").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ins"), F.min("src").alias("before"))
        x = outs.join(ins, "node", "left").withColumn("ins", F.coalesce("ins", F.lit(0)))
        goes = F.when(F.col("outs") > 1, False).when(F.col("ins") == 0, (F.col("outs") == 0) | _coin("node", turn)).when(F.col("ins") == 1, ~_coin("before", turn) & ((F.col("outs") == 0) | _coin("node", turn))).otherwise(False)
        x = cut(x.select("node", "to", "before", "held", goes.alias("goes")), "reach")
        n, done = x.agg(F.count("*"), F.count_if("goes")).first()
        if not n:
            break
        if n <= SMALL or done < FEW * n:
            held, rest = x.select("node", "held"), left.where("dst IS NOT NULL").select("src", "dst")
            beyond = closure(rest).join(held.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("held").alias("more"))
            gone.append(cut(held.join(beyond, "node", "left").select("node", F.lit(None).cast(nothing).alias("to"), F.lit(None).cast(nothing).alias("before"), (F.col("held") + F.coalesce("more", F.lit(0))).alias("held")), "reach"))
            break
        taken = x.where("goes").drop("goes")
        gone.append(taken)
        inner = taken.where("before IS NOT NULL")
        less = lambda t, a, b: t.select(F.col(a).alias("src"), (F.col(b) if b else F.lit(None).cast(nothing)).alias("dst"), F.lit(0).cast("long").alias("held"), F.lit(True).alias("off"))
        more = lambda b, held: inner.select(F.col("before").alias("src"), b.alias("dst"), held.cast("long").alias("held"), F.lit(False).alias("off"))  # noqa: E731, B023
        every = left.withColumn("off", F.lit(False)).unionByName(less(taken, "node", None)).unionByName(less(taken.where("to IS NOT NULL"), "node", "to")).unionByName(less(inner, "before", "node"))
        every = every.unionByName(more(F.lit(None).cast(nothing), F.col("held"))).unionByName(more(F.col("to"), F.lit(0)).where("dst IS NOT NULL"))
        left = cut(every.groupBy("src", "dst").agg(F.sum("held").alias("held"), F.max("off").alias("off")).where("NOT off").drop("off"), "reach-edges")
    out = sizes.select("node", F.col("size").cast("long").alias("reach")).limit(0)
    for t in reversed(gone):
        after = out.select(F.col("node").alias("to"), "reach")
        out = out.unionByName(cut(t.join(after, "to", "left").select("node", (F.col("held") + F.coalesce("reach", F.lit(0))).alias("reach")), "reached"))
    return out


def components_with_reach(edges: DataFrame) -> DataFrame:
    """node, component, reach: the nodes that each reaches, itself included."""
    of = cut(strong_components(edges), "components")
    sizes = of.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("size"))
    others = of.where("node <> component").select("node", F.col("component").alias("anchor"))
    between = _renamed(_renamed(edges.select("src", "dst"), others, "src"), others, "dst").where("src <> dst").select("src", "dst").distinct()
    reach = reach_sizes(between, cut(sizes, "sizes")).withColumnRenamed("node", "component")
    return of.join(reach, "component").select("node", "component", "reach")


def _lines(s: SparkSession, d: str) -> DataFrame:
    """Each order line leads to the next of its order, the last back to the first in every third order, and the first of every
    second order to the first line of the customer's next order."""
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    x = line.withColumn("next", F.lead("node").over(w)).withColumn("first", F.first("node").over(w))
    inside = x.where("next IS NOT NULL").select(F.col("node").alias("src"), F.col("next").alias("dst"))
    back = x.where("next IS NULL AND l_orderkey % 3 = 0").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    order = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("follows", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    heads = line.groupBy("l_orderkey").agg(F.min("node").alias("head"))
    on = order.where("o_orderkey % 2 = 0").join(heads.select(F.col("l_orderkey").alias("o_orderkey"), F.col("head").alias("src")), "o_orderkey").join(heads.select(F.col("l_orderkey").alias("follows"), F.col("head").alias("dst")), "follows")
    return cut(inside.unionByName(back).unionByName(on.select("src", "dst")), "lines")


QUERIES = {"g9_line_components": lambda s, d: components_with_reach(_lines(s, d))}
SQL = {
    "g9_line_components": """WITH RECURSIVE l AS (SELECT l_orderkey, l_orderkey * 8 + l_linenumber AS node, lead(l_orderkey * 8 + l_linenumber) OVER w AS nx, first_value(l_orderkey * 8 + l_linenumber) OVER w AS hd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
o AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS follows FROM orders), h AS (SELECT l_orderkey, min(node) AS head FROM l GROUP BY 1),
e AS (SELECT node AS src, nx AS dst FROM l WHERE nx IS NOT NULL UNION SELECT node, hd FROM l WHERE nx IS NULL AND l_orderkey % 3 = 0 UNION SELECT a.head, b.head FROM o JOIN h a ON a.l_orderkey = o_orderkey JOIN h b ON b.l_orderkey = follows WHERE o_orderkey % 2 = 0),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(src, dst) AS (SELECT node, node FROM v UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)
SELECT a.src AS node, min(CASE WHEN b.src IS NOT NULL THEN a.dst END) AS component, count(*) AS reach FROM r a LEFT JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY 1"""
}
