"""Links between symbols of source files: declarations, uses, base classes, inherited members and the edges turned round.

Symbols are rows (sym_id, file, name, fqn, parent, kind, role, start, stop): fqn is the name with its parents before it, parent the
fqn of what encloses it, role one of definition, declaration and use.  `visible` has (file, target); a file sees itself too.

A name is looked up from the distinct (file, name) pairs of the uses, through the files that each sees: candidates are brought by
an equi join on (target, name), so a name that every file defines never meets all its namesakes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.plans.standins import table
from tidelark.sources.stores import TASK_ROWS, cut, new_path, tasks_for

CLASS = "class"
#: Base names and classes of one task, where base names are looked up; rows of orders, where they go on to the classes that derive.
BASE_ROWS = 100_000


def _seen(wanted: DataFrame, visible: DataFrame) -> DataFrame:
    """(file, target, ...) of wanted rows with a file, once for each file that it sees, its own included."""
    own = wanted.select("file").distinct().select("file", F.col("file").alias("target"))
    return wanted.join(visible.select("file", "target").unionByName(own).distinct(), "file")


def _unified(symbols: DataFrame, tasks: int) -> DataFrame:
    """decl_id, file, fqn, def_id of declarations whose fqn exactly one definition has."""
    only = symbols.where("role = 'definition'").select("fqn", "sym_id").repartition(tasks, "fqn").groupBy("fqn").agg(F.count("*").alias("_n"), F.min("sym_id").alias("def_id")).where("_n = 1")
    found = symbols.where("role = 'declaration'").select(F.col("sym_id").alias("decl_id"), "file", "fqn").repartition(tasks, "fqn").join(only, "fqn")
    return found.select("decl_id", "file", "fqn", "def_id")


def declared(symbols: DataFrame) -> DataFrame:
    """decl_id, def_id of declarations whose fqn exactly one definition has."""
    return _unified(symbols, tasks_for(symbols.count())).select("decl_id", "def_id")


def _only_definition(uses: DataFrame, definitions: DataFrame, visible: DataFrame, tasks: int) -> DataFrame:
    """use_id, file, name, def_id of all uses (sym_id, file, name, key, start, stop); def_id where one visible definition (key) is
    left beside what encloses the use, else null.

    Definitions are counted for each (file, key); those of a use's own file that enclose it are taken off where the uses of that
    (file, key) are, so a use is shuffled once.
    """
    key = ["file", "key"]
    there = definitions.select(F.col("file").alias("target"), "key", F.col("sym_id").alias("def_id"), F.col("start").alias("_from"), F.col("stop").alias("_to"))
    # The sum tells which one is left after one is taken off.
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = _seen(uses.select(*key).distinct(), visible).repartition(tasks, "target", "key").join(there.repartition(tasks, "target", "key"), ["target", "key"])
    found = found.select(*key, "def_id").repartition(tasks, *key).groupBy(*key).agg(F.count("*").alias("_n"), total("def_id").alias("_sum"))
    asked = uses.select("sym_id", "name", *key, "start", "stop").repartition(tasks, *key).join(found, key, "left").alias("u")
    own = there.withColumnRenamed("target", "file").repartition(tasks, *key).alias("d")
    c = F.col
    encloses = (c("u.file") == c("d.file")) & (c("u.key") == c("d.key")) & (c("d._from") < c("u.start")) & (c("d._to") >= c("u.stop"))
    counted = asked.join(own, encloses, "left").groupBy("u.file", "u.key", "u.sym_id", "u.name", "u._n", "u._sum").agg(F.count("d.def_id").alias("_around"), total("d.def_id").alias("_less"))
    left = F.when(c("_n") - c("_around") == 1, (c("_sum") - F.coalesce("_less", F.lit(0))).cast("long"))
    return counted.select(c("sym_id").alias("use_id"), "file", "name", left.alias("def_id"))


def linked(symbols: DataFrame, visible: DataFrame) -> DataFrame:
    """use_id, def_id: calls are looked up by name, other uses by fqn; a definition that encloses the use (a recursion) doesn't count.

    A use is linked where one definition is left; otherwise to the definition that a visible declaration of its plain name was
    unified with.  sym_ids are whole numbers and unique.
    """
    tasks = tasks_for(symbols.count())
    uses = symbols.where("role = 'use' AND name IS NOT NULL")
    definitions = symbols.where("role = 'definition' AND name IS NOT NULL")
    calls = _only_definition(uses.where("kind = 'call'").withColumn("key", F.col("name")), definitions.withColumn("key", F.col("name")), visible, tasks)
    others = _only_definition(uses.where("kind <> 'call'").withColumn("key", F.col("fqn")), definitions.withColumn("key", F.col("fqn")), visible, tasks)
    neither = uses.where("kind IS NULL").select(F.col("sym_id").alias("use_id"), "file", "name", F.lit(None).cast("long").alias("def_id"))
    found = cut(calls.unionByName(others).unionByName(neither), "direct")
    direct = found.where("def_id IS NOT NULL").select("use_id", "def_id")
    rest = found.where("def_id IS NULL").select("use_id", "file", "name")
    unified = _unified(symbols, tasks).select(F.col("file").alias("target"), F.col("fqn").alias("name"), "def_id")
    # All declarations of one fqn have one definition, so the least is the only one.
    by_name = _seen(rest.select("file", "name").distinct(), visible).repartition(tasks, "target", "name").join(unified.repartition(tasks, "target", "name"), ["target", "name"])
    by_name = by_name.select("file", "name", "def_id").repartition(tasks, "file", "name").groupBy("file", "name").agg(F.min("def_id").alias("def_id"))
    return direct.unionByName(rest.repartition(tasks, "file", "name").join(by_name, ["file", "name"]).select("use_id", "def_id"))


def base_classes(classes: DataFrame, bases: DataFrame, visible: DataFrame) -> DataFrame:
    """class_id, position, base_id of base names (class_id, file, position, name): the first visible class, by file, start and id, of
    that name or fqn; a name that no visible class has is left out."""
    # Each base name is looked up in several files, so a task takes fewer of them.
    tasks = tasks_for(bases.count() + classes.count(), BASE_ROWS)
    key, there = ["file", "name"], ["target", "name"]
    keys = classes.select(F.col("file").alias("target"), F.explode(F.array_distinct(F.array("name", "fqn"))).alias("name"), "sym_id", "start").repartition(tasks, *there)
    keys = keys.groupBy(*there).agg(F.min(F.struct("start", "sym_id")).alias("_first"))
    found = _seen(bases.select(*key).distinct(), visible).repartition(tasks, *there).join(keys, there)
    first = found.select(*key, F.struct("target", "_first").alias("_first")).repartition(tasks, *key).groupBy(*key).agg(F.min("_first").alias("_first"))
    return bases.repartition(tasks, *key).join(first, key).select("class_id", "position", F.col("_first._first.sym_id").alias("base_id"))


def _in_rounds(step: DataFrame) -> DataFrame:
    """class_id, ancestor, depth, place of the classes of step (class_id, _base, _at), found a depth at a time; a class comes once,
    so hierarchies that go round in a circle end.  Each round meets all that is known."""
    first = step.select("class_id", F.col("class_id").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place")).distinct()
    front = known = cut(first, "linearised")
    step = step.select(F.col("class_id").alias("ancestor"), "_base", "_at")
    while not front.isEmpty():
        more = front.join(step, "ancestor").groupBy("class_id", F.col("_base").alias("ancestor")).agg((F.min("depth") + 1).alias("depth"), F.min(F.concat("place", F.array("_at"))).alias("place"))
        front = cut(more.join(known.select("class_id", "ancestor"), ["class_id", "ancestor"], "left_anti"), "linearised")
        known = known.unionByName(front)
    return known


def _layered(step: DataFrame) -> tuple[DataFrame, int]:
    """step with the layer of its class, and the last layer: 0 where no class derives from it, else one more than the highest of
    those that do.  Classes in circles, and all that they reach, are left together in the last layer."""
    spark, path = step.sparkSession, new_path(step.sparkSession, "layers")
    left, k = step, 0
    while True:
        named = left.select(F.col("_base").alias("class_id")).distinct().withColumn("_named", F.lit(True))
        left.join(named, "class_id", "left").write.parquet(f"{path}/layer={k}")
        every = spark.read.schema("class_id long, _base long, _at int, _named boolean, layer int").parquet(path)
        here = every.where(F.col("layer") == k)
        if here.where("_named IS NULL").isEmpty():
            return every.where((F.col("layer") == k) | F.col("_named").isNull()).drop("_named"), k
        left, k = here.where("_named").drop("_named", "layer"), k + 1


def linearised(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """class_id, ancestor, depth, place: each class at depth 0 and all its base classes, nearest first, then by the place of the
    bases on the way.  A class comes once, at its nearest place.

    A class is ordered once, from the finished orders of its bases, layer by layer: what came to it is put together and goes on to
    the classes that derive from it.  Only circles and the classes that they reach are ordered in rounds.
    """
    spark, order = bases.sparkSession, ["class_id", "ancestor", "depth", "place"]
    step = bases.where("base_id <> class_id").groupBy("class_id", F.col("base_id").alias("_base")).agg(F.min("position").cast("int").alias("_at"))
    edges, last = _layered(cut(step.select(F.col("class_id").cast("long"), F.col("_base").cast("long"), "_at"), "bases"))
    # Edges are kept by the layer of the base, so each is read once.
    of = edges.select(F.col("class_id").alias("_base"), F.col("layer").alias("_from")).distinct()
    below, came = new_path(spark, "below"), new_path(spark, "orders")
    edges.where(F.col("layer") < last).join(of, "_base").select(F.col("class_id").alias("_derived"), F.col("_base").alias("class_id"), "_at", "layer", "_from").write.partitionBy("_from").parquet(below)
    edges.where(F.col("layer") < last).select("class_id", F.col("_base").alias("ancestor"), F.lit(1).alias("depth"), F.array("_at").alias("place"), "layer").write.partitionBy("layer").parquet(came)

    def arrived(rows: DataFrame, per_task: int = TASK_ROWS) -> DataFrame:
        rows = rows.repartition(tasks_for(rows.count(), per_task), "class_id")
        return rows.groupBy("class_id", "ancestor").agg(F.min(F.struct("depth", "place")).alias("_near")).select("class_id", "ancestor", "_near.depth", "_near.place")

    def orders() -> DataFrame:
        return spark.read.schema("class_id long, ancestor long, depth int, place array<int>, layer int").parquet(came)

    circles = cut(_in_rounds(edges.where(F.col("layer") == last).drop("layer")).where("depth > 0"), "circles")
    for k in range(last, 0, -1):
        rows = circles if k == last else arrived(orders().where(F.col("layer") == k), BASE_ROWS)
        derived = spark.read.schema("_derived long, class_id long, _at int, layer int, _from int").parquet(below).where(F.col("_from") == k)
        on = rows.join(derived, "class_id").select(F.col("_derived").alias("class_id"), "ancestor", (F.col("depth") + 1).alias("depth"), F.concat(F.array("_at"), "place").alias("place"), "layer")
        on.write.mode("append").partitionBy("layer").parquet(came)
    itself = classes.select(F.col("sym_id").alias("class_id"), F.col("sym_id").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"))
    found = arrived(orders()).unionByName(circles).join(itself.select("class_id").distinct(), "class_id", "left_semi")
    return itself.unionByName(found.select(*order))


def inherited(uses: DataFrame, members: DataFrame, order: DataFrame) -> DataFrame:
    """use_id, def_id, owner, depth of uses (use_id, class_id, name): the member (owner, name, def_id) of the nearest class in the
    linearised `order`, which hides those behind it; of one class the member with the least def_id."""
    wanted = uses.select("class_id", "name").distinct()
    there = members.groupBy(F.col("owner").alias("ancestor"), "name").agg(F.min("def_id").alias("def_id"))
    near = F.struct("depth", "place")
    best = wanted.join(order, "class_id").join(there, ["ancestor", "name"]).groupBy("class_id", "name").agg(F.min_by(F.struct("def_id", F.col("ancestor").alias("owner"), "depth"), near).alias("_best"))
    return uses.join(best, ["class_id", "name"]).select("use_id", "_best.def_id", "_best.owner", "_best.depth")


def nearest_members(uses: DataFrame, members: DataFrame, classes: DataFrame, bases: DataFrame) -> DataFrame:
    """What `inherited` gives for the linearised order of classes (sym_id), without making that order.

    A name is asked of a class once, however many classes below it ask for it, and only of the bases of classes that haven't it.
    Answers come down the same ways, those at a distance of k in round k: the first that comes is the nearest, and of one round the
    one by the first place.
    """
    step = cut(bases.groupBy("class_id", F.col("base_id").alias("_base")).agg(F.min("position").alias("_at")), "bases")
    there = cut(members.groupBy(F.col("owner").alias("class_id"), "name").agg(F.min("def_id").alias("def_id")), "members")
    key = ["class_id", "name"]
    asking = uses.select(*key).where("class_id IS NOT NULL AND name IS NOT NULL").distinct()
    front = cut(asking.join(classes.select(F.col("sym_id").alias("class_id")).distinct(), "class_id", "left_semi"), "asked")
    asked, ways = front, None
    while not front.isEmpty():
        new = cut(front.join(there, key, "left_anti").join(step, "class_id"), "ways")
        ways = new if ways is None else ways.unionByName(new)
        front = cut(new.select(F.col("_base").alias("class_id"), "name").distinct().join(asked, key, "left_anti"), "asked")
        asked = asked.unionByName(front)
    # Places of one depth are as long; arrays are ordered number by number.
    front = asked.join(there, key).select(*key, "def_id", F.col("class_id").alias("owner"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("place"))
    known = front = cut(front, "nearest")
    depth = 0
    while ways is not None and not front.isEmpty():
        depth += 1
        came = ways.join(front.withColumnRenamed("class_id", "_base"), ["_base", "name"]).select(*key, F.struct(F.concat(F.array(F.col("_at").cast("int")), "place").alias("place"), "owner", "def_id").alias("_way"))
        came = came.groupBy(*key).agg(F.min("_way").alias("_way")).join(known.select(*key), key, "left_anti")
        front = cut(came.select(*key, "_way.def_id", "_way.owner", F.lit(depth).alias("depth"), "_way.place"), "nearest")
        known = known.unionByName(front)
    return uses.join(known, key).select("use_id", "def_id", "owner", "depth")


def members_of(symbols: DataFrame) -> DataFrame:
    """owner, name, def_id of the definitions whose parent is a class; of classes that share a fqn the one of the same file, else the
    first by id."""
    classes = symbols.where(f"role = 'definition' AND kind = '{CLASS}'").select(F.col("sym_id").alias("owner"), F.col("fqn").alias("parent"), F.col("file").alias("_file"))
    inside = symbols.where(f"role = 'definition' AND kind <> '{CLASS}'").select("parent", "name", "file", F.col("sym_id").alias("def_id"))
    first = classes.groupBy("parent").agg(F.min("owner").alias("_first"))
    own = classes.groupBy("parent", F.col("_file").alias("file")).agg(F.min("owner").alias("_own"))
    return inside.join(first, "parent").join(own, ["parent", "file"], "left").select(F.coalesce("_own", "_first").alias("owner"), "name", "def_id")


def reified(symbols: DataFrame, links: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """sym_id, edge, other: edges turned round.  `usage` and `declaration` lead from a definition to what names it, `calls` from a
    callable to the definitions that calls inside it link to, `inherits` from a class to its bases, `inherited_by` back, and `member`
    from a class to its members."""
    tasks = tasks_for(symbols.count())
    uses = symbols.where("role = 'use' AND kind = 'call'").select(F.col("sym_id").alias("use_id"), "file", "parent").repartition(tasks, "use_id")
    usage = links.select(F.col("def_id").alias("sym_id"), F.lit("usage").alias("edge"), F.col("use_id").alias("other"))
    decl = _unified(symbols, tasks).select(F.col("def_id").alias("sym_id"), F.lit("declaration").alias("edge"), F.col("decl_id").alias("other"))
    callers = symbols.where("role = 'definition' AND kind = 'callable'").select("file", F.col("fqn").alias("parent"), "sym_id").repartition(tasks, "file", "parent")
    calls = uses.join(links.repartition(tasks, "use_id"), "use_id").repartition(tasks, "file", "parent").join(callers, ["file", "parent"]).select("sym_id", F.lit("calls").alias("edge"), F.col("def_id").alias("other"))
    edge = lambda t, a, name, b: t.select(F.col(a).alias("sym_id"), F.lit(name).alias("edge"), F.col(b).alias("other"))
    rest = [edge(bases, "class_id", "inherits", "base_id"), edge(bases, "base_id", "inherited_by", "class_id"), edge(members, "owner", "member", "def_id")]
    out = usage.unionByName(decl).unionByName(calls)
    for x in rest:
        out = out.unionByName(x)
    return out.repartition(tasks, "sym_id", "edge", "other").distinct()


def _text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as classes, ten a file: (classes, base names, visible files).  A file sees those at a half and a third of its number."""
    k = F.col("p_partkey")
    parts = table(s, d, "part").select(k.alias("sym_id"), F.floor(k / 10).cast("long").alias("file"), _text("C", k % 7).alias("name"), k.alias("start"))
    classes = parts.withColumn("fqn", F.concat("name", F.lit("@"), F.col("file").cast("string")))
    # A class names two bases; every fifth names its own name first, which may find itself.
    names = F.array(F.when(k % 5 == 0, k % 7).otherwise(k * 3 % 7), k * 2 % 7)
    bases = table(s, d, "part").select(k.alias("class_id"), F.floor(k / 10).cast("long").alias("file"), F.posexplode(names).alias("position", "n")).select("class_id", "file", "position", _text("C", F.col("n")).alias("name"))
    files = classes.select("file").distinct()
    visible = files.select("file", F.explode(F.array(F.floor(F.col("file") / 2), F.floor(F.col("file") / 3))).alias("target"))
    return classes, bases, visible


def _lines(s: SparkSession, d: str) -> DataFrame:
    """One symbol for each number of an order's lines, since numbers repeat."""
    columns = ["l_partkey", "l_suppkey", "l_quantity"]
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    return lines.repartition(tasks_for(lines.count()), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in columns])


def _hierarchy(s: SparkSession, d: str) -> DataFrame:
    classes, bases, visible = _classes(s, d)
    return cut(base_classes(classes, bases, visible), "base-classes")


def _linearised(s: SparkSession, d: str) -> DataFrame:
    order = linearised(_classes(s, d)[0], _hierarchy(s, d))
    return order.select("class_id", "ancestor", F.col("depth").cast("int").alias("depth"), F.array_join(F.col("place").cast("array<string>"), ".").alias("place"))


def _member_calls(s: SparkSession, d: str) -> DataFrame:
    """Lines of few pieces define a method of their part's class; the others call one by name."""
    line = _lines(s, d).select(F.col("l_partkey").alias("class_id"), _text("m", F.col("l_suppkey") % 13).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), (F.col("l_quantity") < 5).alias("defines"))
    line = cut(line, "lines")
    members = line.where("defines").select(F.col("class_id").alias("owner"), "name", F.col("use_id").alias("def_id"))
    found = nearest_members(line.where("NOT defines"), members, _classes(s, d)[0], _hierarchy(s, d))
    return found.select("use_id", "def_id", "owner", F.col("depth").cast("int").alias("depth"))


def _functions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as functions in files of their customers, lines as calls inside them: (symbols, visible files).

    Every third order has a name of its own and is declared in the file at half its file's number; odd lines call their own function.
    """
    key = F.col("o_orderkey")
    own = key % 3 == 0
    name = F.when(own, _text("g", key)).otherwise(_text("f", key % 5))
    orders = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), name.alias("name"), (key * 10).alias("start"), (key * 10 + 9).alias("stop"), own.alias("own"))
    shape = lambda t, i, file, name, parent, kind, role, start, stop: t.select(i.cast("long").alias("sym_id"), file.cast("long").alias("file"), name.alias("name"), name.alias("fqn"), parent.alias("parent"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), start.cast("long").alias("start"), stop.cast("long").alias("stop"))
    nothing = F.lit(None).cast("string")
    c = F.col
    defs = shape(orders, c("start"), c("file"), c("name"), nothing, "callable", "definition", c("start"), c("stop"))
    decls = shape(orders.where("own"), c("start") + 9, F.floor(c("file") / 2), c("name"), nothing, "callable", "declaration", c("start"), c("start"))
    by_order = orders.repartition(tasks_for(table(s, d, "lineitem").count()), "o_orderkey")
    lines = _lines(s, d).join(by_order, F.col("l_orderkey") == F.col("o_orderkey"))
    called = F.when(c("l_linenumber") % 2 == 1, c("name")).otherwise(_text("f", c("l_partkey") % 5))
    uses = shape(lines, c("start") + c("l_linenumber"), c("file"), called, c("name"), "call", "use", c("start") + c("l_linenumber"), c("start") + c("l_linenumber"))
    visible = orders.select("file").distinct().select("file", F.floor(c("file") / 2).alias("target"))
    return defs.unionByName(decls).unionByName(uses), visible


def _linked(s: SparkSession, d: str) -> DataFrame:
    symbols, visible = _functions(s, d)
    return linked(cut(symbols, "symbols"), visible).select("use_id", "def_id")


def _reified(s: SparkSession, d: str) -> DataFrame:
    symbols, visible = _functions(s, d)
    symbols = cut(symbols, "symbols")
    links = cut(linked(symbols, visible), "links")
    classes = _classes(s, d)[0]
    methods = _lines(s, d).where("l_quantity < 5").select(F.col("l_partkey").alias("_part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("def_id"))
    members = methods.join(classes, F.col("_part") == F.col("sym_id")).select(F.col("sym_id").alias("owner"), "def_id")
    edges = reified(symbols, links, _hierarchy(s, d), members)
    return edges.groupBy("sym_id", "edge").agg(F.count("*").alias("n"), F.min("other").alias("first_other"))


_HIERARCHY = """c AS (SELECT p_partkey AS k, p_partkey // 10 AS file, 'C' || (p_partkey % 7) AS name FROM part),
v AS (SELECT DISTINCT file, unnest([file, file // 2, file // 3]) AS target FROM c),
w AS (SELECT k, file, 0 AS position, 'C' || CASE WHEN k % 5 = 0 THEN k % 7 ELSE k * 3 % 7 END AS name FROM c UNION ALL SELECT k, file, 1, 'C' || (k * 2 % 7) FROM c),
b AS (SELECT w.k AS class_id, position, arg_min(c.k, (c.file, c.k)) AS base_id FROM w JOIN v ON v.file = w.file JOIN c ON c.file = v.target AND c.name = w.name GROUP BY 1, 2)"""
_ORDER = """r(class_id, ancestor, depth, place, way) AS (SELECT k, k, 0, CAST([] AS INT[]), [k] FROM c
 UNION ALL SELECT r.class_id, b.base_id, r.depth + 1, list_append(r.place, b.position), list_append(r.way, b.base_id) FROM r JOIN b ON b.class_id = r.ancestor WHERE NOT list_contains(r.way, b.base_id)),
o AS (SELECT class_id, ancestor, min((depth, place)) AS near FROM r GROUP BY 1, 2)"""
_LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"
_LINKED = f"""{_LINES}, f AS (SELECT o_orderkey * 10 AS id, o_custkey AS file, o_orderkey % 3 = 0 AS own, CASE WHEN o_orderkey % 3 = 0 THEN 'g' || o_orderkey ELSE 'f' || (o_orderkey % 5) END AS name FROM orders),
u AS (SELECT f.id + l_linenumber AS id, f.file, f.id AS inside, f.name AS parent, CASE WHEN l_linenumber % 2 = 1 THEN f.name ELSE 'f' || (l_partkey % 5) END AS name FROM li JOIN f ON f.id = l_orderkey * 10),
s AS (SELECT DISTINCT file, unnest([file, file // 2]) AS target FROM f),
x AS (SELECT u.id AS use_id, min(f.id) AS def_id FROM u JOIN s ON s.file = u.file JOIN f ON f.file = s.target AND f.name = u.name AND f.id <> u.inside GROUP BY 1 HAVING count(*) = 1),
y AS (SELECT u.id AS use_id, f.id AS def_id FROM u JOIN f ON f.name = u.name AND f.own JOIN s ON s.file = u.file AND s.target = f.file // 2 WHERE u.id NOT IN (SELECT use_id FROM x)),
l AS (SELECT * FROM x UNION ALL SELECT * FROM y)"""
QUERIES = {
    "g10_linearised": _linearised,
    "g10_inherited_members": _member_calls,
    "g10_linked": _linked,
    "g11_reified": _reified,
}
SQL = {
    "g10_linearised": f"WITH RECURSIVE {_HIERARCHY}, {_ORDER} SELECT class_id, ancestor, CAST(near[1] AS INT) AS depth, array_to_string(near[2], '.') AS place FROM o",
    "g10_inherited_members": f"""WITH RECURSIVE {_LINES}, {_HIERARCHY}, {_ORDER}, m AS (SELECT l_partkey AS owner, 'm' || (l_suppkey % 13) AS name, min(l_orderkey * 10 + l_linenumber) AS def_id FROM li WHERE l_quantity < 5 GROUP BY 1, 2),
q AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, l_partkey AS class_id, 'm' || (l_suppkey % 13) AS name FROM li WHERE NOT l_quantity < 5)
SELECT use_id, arg_min(def_id, near) AS def_id, arg_min(owner, near) AS owner, CAST(min(near)[1] AS INT) AS depth FROM q JOIN o ON o.class_id = q.class_id JOIN m ON m.owner = o.ancestor AND m.name = q.name GROUP BY 1""",
    "g10_linked": f"WITH {_LINKED} SELECT * FROM l",
    "g11_reified": f"""WITH {_LINKED}, {_HIERARCHY}, e AS (SELECT def_id AS sym_id, 'usage' AS edge, use_id AS other FROM l UNION SELECT id, 'declaration', id + 9 FROM f WHERE own
UNION SELECT f.id, 'calls', l.def_id FROM l JOIN u ON u.id = l.use_id JOIN f ON f.file = u.file AND f.name = u.parent UNION SELECT class_id, 'inherits', base_id FROM b UNION SELECT base_id, 'inherited_by', class_id FROM b
UNION SELECT l_partkey, 'member', l_orderkey * 10 + l_linenumber FROM li WHERE l_quantity < 5) SELECT sym_id, edge, count(*) AS n, min(other) AS first_other FROM e GROUP BY 1, 2""",
}
