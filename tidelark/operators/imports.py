"""Which files or packages an import names, by the rules of six languages, as joins over paths.

Imports come as (path, name), files as (path).  A result is (path, name, unit): `unit` is a file, or a package (a directory or a
namespace) whose files `members` lists.  A package is one row a link, however many files it has, so that links of a package with
a third of all files aren't multiplied out.  Names are resolved once each where the rule doesn't ask for the importing file;
frequent names and crowded packages are aggregated before they meet the imports.  Null names and paths resolve to nothing, repeated
rows to one; where the rule takes any one of several files, the first by name is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.operators.listing import first_by
from tidelark.plans.standins import table
from tidelark.sources.stores import cut

JS_SUFFIXES = [".ts", ".js"]


def normal_path(path: Column | str) -> Column:
    """A path without empty and . segments; .. takes the segment before away, where there is one."""
    done = F.array().cast("array<string>")

    def step(above: Column, segment: Column) -> Column:
        up = (segment == "..") & (F.size(above) > 0) & (F.try_element_at(above, F.lit(-1)) != "..")
        return F.when(segment.isin("", "."), above).when(up, F.slice(above, 1, F.size(above) - 1)).otherwise(F.concat(above, F.array(segment)))

    return F.array_join(F.aggregate(F.split(C.col(path), "/"), done, step), "/")


def beside(path: Column | str, name: Column | str) -> Column:
    """`name` as a path from the folder of `path`."""
    return normal_path(F.concat(C.parent(path), F.lit("/"), C.col(name)))


def _tails(text: Column) -> Column:
    """Every ending of a text, whole words or not."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, n)))


def _wanted(imports: DataFrame, *more: str) -> DataFrame:
    return imports.where("path IS NOT NULL AND name IS NOT NULL AND name <> ''").select("path", "name", *more).distinct()


def _paths(files: DataFrame) -> DataFrame:
    return files.where("path IS NOT NULL").select("path").distinct()


def _first_ending(names: DataFrame, heads: DataFrame) -> DataFrame:
    """name, unit, n: of the files (path, head) whose head ends with name, the first by path and their number.

    A name meets at most one ending of each head, so there are no more pairs than characters in paths.
    """
    ends = heads.select("path", F.explode(_tails(F.col("head"))).alias("name")).distinct()
    ends = ends.groupBy("name").agg(F.min("path").alias("unit"), F.count("*").alias("n"))
    return names.select("name").distinct().join(ends, "name")


def c_includes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file at the include's path from the including file; else the first whose path ends with the include.

    Direct includes only; `graphs.closure` follows them.
    """
    wanted, paths = _wanted(imports), _paths(files)
    near = wanted.withColumn("unit", beside("path", "name")).join(paths.select(F.col("path").alias("unit")), "unit", "left_semi")
    rest = wanted.join(near, ["path", "name"], "left_anti")
    far = rest.join(_first_ending(rest, paths.withColumn("head", F.col("path"))), "name")
    return near.select("path", "name", "unit").unionByName(far.select("path", "name", "unit"))


def java_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The class's file, the first whose path has the dotted name as a path with .java; else the packages (directories) that end
    with that path.  A name without a dot names nothing."""
    slashed = F.translate("name", ".", "/")
    wanted, paths = _wanted(imports).where(F.contains("name", F.lit("."))), _paths(files)
    # A path has the name in it where what goes before one of its ".java" ends with the name.
    cut_at = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), i, F.lit(5)) == ".java")
    heads = paths.select("path", F.explode(F.transform(cut_at, lambda i: F.substring(F.col("path"), F.lit(1), i - 1))).alias("head"))
    names = wanted.select("name").distinct().withColumn("dotted", F.col("name")).withColumn("name", slashed)
    classes = _first_ending(names, heads).join(names, "name").select(F.col("dotted").alias("name"), "unit")
    rest = names.join(classes.select(F.col("name").alias("dotted")), "dotted", "left_anti")
    folders = paths.select(C.parent("path").alias("unit")).distinct()
    packages = folders.select("unit", F.explode(_tails(F.col("unit"))).alias("name")).join(rest, "name").select(F.col("dotted").alias("name"), "unit")
    return wanted.join(classes.unionByName(packages), "name").select("path", "name", "unit")


def js_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports only: a path that ends in .ts or .js as it is, one without any suffix with .ts, .js, or its index file."""
    wanted = _wanted(imports).where(F.startswith("name", F.lit("./")) | F.startswith("name", F.lit("../")))
    at = wanted.withColumn("_at", beside("path", "name"))
    suffix = C.suffix("_at")
    tries = [F.concat("_at", F.lit(x)) for x in [*JS_SUFFIXES, *("/index" + s for s in JS_SUFFIXES)]]
    tries = F.when(suffix.isin(JS_SUFFIXES), F.array("_at")).when(suffix == "", F.array(*tries)).otherwise(F.array().cast("array<string>"))
    found = at.select("path", "name", F.posexplode(tries).alias("_k", "unit")).join(_paths(files).withColumnRenamed("path", "unit"), "unit", "left_semi")
    return found.groupBy("path", "name").agg(F.min_by("unit", "_k").alias("unit"))


def ruby_requires(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (path, name, relative): a relative one is a path from the requiring file; any other the only file whose path ends
    with it as whole segments, and none where there are several."""
    wanted, paths = _wanted(imports, "relative"), _paths(files)
    bare = F.concat(F.regexp_replace("name", r"\.rb$", ""), F.lit(".rb"))
    near = wanted.where("relative").withColumn("unit", beside("path", bare)).join(paths.select(F.col("path").alias("unit")), "unit", "left_semi")
    far = wanted.where("NOT coalesce(relative, false)").withColumn("_end", F.concat(F.lit("/"), bare))
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    ends = paths.where(F.contains("path", F.lit("/"))).select("path", F.explode(tails).alias("_end"))
    ends = ends.groupBy("_end").agg(F.min("path").alias("unit"), F.count("*").alias("_n")).where("_n = 1")
    return near.select("path", "name", "unit").unionByName(far.join(ends, "_end").select("path", "name", "unit")).distinct()


def go_modules(files: DataFrame) -> DataFrame:
    """root, module of the go.mod files among files (path, text)."""
    name = F.trim(F.regexp_extract("text", r"(?m)^module\s+(.+)$", 1))
    return files.where(C.file_name("path") == "go.mod").select(C.parent("path").alias("root"), name.alias("module")).where("module <> ''")


def go_packages(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, root, package of Go files: the module (root, module) of the nearest folder above, and the folder's path from there."""
    x = _paths(files).where(C.suffix("path") == ".go").withColumn("_dir", C.parent("path"))
    # ancestors() begins with the root and ends with the file's own folder.
    above = x.select("path", "_dir", F.posexplode(C.ancestors("path")).alias("_k", "root")).join(modules.groupBy("root").agg(F.min("module").alias("module")), "root")
    nearest = first_by(above, ["path"], F.desc("_k"))
    below = F.when(F.col("root") == "", F.col("_dir")).otherwise(F.substring(F.col("_dir"), F.length("root") + 2, F.length("_dir")))
    return nearest.select("path", "root", F.when(below == "", F.col("module")).otherwise(F.concat("module", F.lit("/"), below)).alias("package"))


def go_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports (path, name, skipped): packages of the importing file's own module; blank and dot imports are skipped.

    `unit` is the package's folder.
    """
    wanted = _wanted(imports, "skipped").where("NOT coalesce(skipped, false)")
    known = packages.select("root", F.col("package").alias("name"), C.parent("path").alias("unit")).distinct()
    return wanted.join(packages.select("path", "root"), "path").join(known, ["root", "name"]).select("path", "name", "unit")


def csharp_usings(declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declarations (path, name, kind), kind namespace, using or global: links of each file to namespaces, and the namespaces
    (unit) of global usings, which every file with a declaration sees.

    A using that is no namespace loses its last segment once.  A file sees the namespaces it declares.
    """
    x = _wanted(declarations, "kind")
    spaces = x.where("kind = 'namespace'").select(F.col("name").alias("unit")).distinct()
    tries = F.when(F.col("kind") == "namespace", F.array("name")).otherwise(F.array("name", F.regexp_replace("name", r"\.?[^.]*$", "")))
    found = x.select("name", "kind").distinct().select("name", "kind", F.posexplode(tries).alias("_k", "unit")).join(spaces, "unit")
    found = found.groupBy("name", "kind").agg(F.min_by("unit", "_k").alias("unit"))
    everywhere = found.where("kind = 'global'").select("unit").distinct()
    return x.join(found, ["name", "kind"]).select("path", "name", "unit").distinct(), everywhere


def members(files: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """unit, path: every file as a unit of itself, every folder with its files, and namespaces (path, name) with those in them."""
    paths = _paths(files)
    found = paths.select(F.col("path").alias("unit"), "path").unionByName(paths.select(C.parent("path").alias("unit"), "path"))
    if namespaces is not None:
        found = found.unionByName(namespaces.select(F.col("name").alias("unit"), "path"))
    return found.distinct()


def link_uses_by_unit(uses: DataFrame, definitions: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """use_id, def_id where exactly one definition of the name (name, def_file, def_id) is in a unit that the use's file imports.

    Definitions are aggregated by unit and name before they meet the uses.
    """
    held = definitions.join(members.select("unit", F.col("path").alias("def_file")), "def_file").groupBy("unit", "name").agg(F.min("def_id").alias("_low"), F.max("def_id").alias("_high"))
    seen = uses.join(links.select(F.col("path").alias("file"), "unit").distinct(), "file").join(held, ["unit", "name"])
    found = seen.groupBy("use_id").agg(F.min("_low").alias("def_id"), F.max("_high").alias("_high"))
    return found.where("def_id = _high").select("use_id", "def_id")


# Stand-ins: a part is a file, a line an import of the part numbered by its supplier.


def _parts(s: SparkSession, d: str, suffix: Column | str) -> DataFrame:
    k = F.col("p_partkey")
    brand, folder = F.lower(F.translate("p_brand", "#", "")), F.concat(F.lit("mod"), (F.col("p_size") % 4).cast("string"))
    base = F.when(k % 50 == 7, "index").otherwise(F.concat(F.lit("f"), (k % 100).cast("string")))
    path = F.concat(F.lit("app/"), brand, F.lit("/"), folder, F.lit("/"), base, F.lit(suffix) if isinstance(suffix, str) else suffix)
    return table(s, d, "part").select("p_partkey", brand.alias("brand"), folder.alias("folder"), base.alias("base"), path.alias("path"))


def _numbered(values: DataFrame, number: str) -> DataFrame:
    """The distinct rows, each with a number of its own; written, so that numbers stay."""
    return cut(values.distinct().withColumn(number, F.monotonically_increasing_id()), "numbered")


def _imports(s: SparkSession, d: str, suffix: Column | str, *names: Column) -> tuple[DataFrame, DataFrame]:
    """(imports, files): a line's name is that of its number's rule, made of the imported file's brand, folder and base.

    Lines meet numbers instead of texts, and their distinct pairs get the texts.
    """
    parts = _parts(s, d, suffix)
    texts = ["path", "brand", "folder", "base"]
    shapes = _numbered(parts.select(*texts).where("path IS NOT NULL"), "_shape")
    named = shapes.select(F.col("_shape").alias("_to"), F.posexplode(F.array(*names)).alias("rule", "name")).where("name IS NOT NULL")
    known = _numbered(named.select("rule", "name"), "_name")
    of_shape = named.join(known, ["rule", "name"]).select("_to", "rule", "_name")
    by_part = cut(parts.join(shapes, texts).select("p_partkey", "_shape"), "shapes")
    rule = (F.col("l_linenumber") % len(names)).cast("int").alias("rule")
    lines = table(s, d, "lineitem").select("l_partkey", "l_suppkey", rule)
    lines = lines.join(by_part.select(F.col("p_partkey").alias("l_partkey"), F.col("_shape").alias("_from")), "l_partkey")
    lines = lines.join(by_part.select(F.col("p_partkey").alias("l_suppkey"), F.col("_shape").alias("_to")), "l_suppkey")
    pairs = lines.join(of_shape, ["_to", "rule"]).select("_from", "_name").distinct()
    pairs = pairs.join(shapes.select(F.col("_shape").alias("_from"), "path"), "_from").join(known, "_name")
    return pairs.select("path", "name", "rule"), shapes.select("path").distinct()


def _of(text: str) -> Column:
    """A pattern with {brand}, {folder} and {base}."""
    return F.expr("concat('" + text.replace("{", "', ").replace("}", ", '") + "')")


def _c(s, d):
    return c_includes(*_imports(s, d, ".h", _of("../{folder}/{base}.h"), _of("{folder}/{base}.h"), _of("{base}.h")))


def _java(s, d):
    return java_imports(*_imports(s, d, ".java", _of("app.{brand}.{folder}.{base}"), _of("{brand}.{folder}"), _of("{base}")))


def _js(s, d):
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".js").otherwise(".ts")
    return js_imports(*_imports(s, d, suffix, _of("./{base}"), _of("../{folder}/{base}.ts"), _of("../{folder}"), _of("{base}")))


def _ruby(s, d):
    imports, files = _imports(s, d, ".rb", _of("../{folder}/{base}"), _of("{brand}/{folder}/{base}.rb"), _of("{base}"))
    return ruby_requires(imports.withColumn("relative", F.col("rule") == 0), files)


def _go(s, d):
    imports, files = _imports(s, d, ".go", _of("example.com/app/{brand}/{folder}"), _of("example.com/{brand}/{folder}"), _of("fmt"))
    brands = _parts(s, d, ".go").select("brand").distinct().where("substr(brand, -1) IN ('1', '3', '5')")
    texts = brands.select(_of("app/{brand}/go.mod").alias("path"), _of("module example.com/{brand}\n\ngo 1.22\n").alias("text"))
    texts = texts.unionByName(brands.limit(1).select(F.lit("app/go.mod").alias("path"), F.lit("module example.com/app\n").alias("text")))
    return go_imports(imports.withColumn("skipped", F.lit(False)), go_packages(files, go_modules(texts)))


def _csharp(s, d):
    imports, _ = _imports(s, d, ".cs", _of("App.{brand}.{folder}"), _of("App.{brand}.{folder}.{base}"), _of("App.{brand}.{folder}.{base}.Deep"))
    own = _parts(s, d, ".cs").select("path", _of("App.{brand}.{folder}").alias("name"), F.lit("namespace").alias("kind")).distinct()
    links, everywhere = csharp_usings(imports.select("path", "name", F.when(F.col("name") == "App.brand11.mod1", "global").otherwise("using").alias("kind")).unionByName(own))
    return links.unionByName(everywhere.select(F.lit("*").alias("path"), F.lit("*").alias("name"), "unit"))


def _files_sql(suffix: str, *names: str) -> str:
    """f: files, i: imports, as the stand-ins make them; names are SQL over q, the imported file."""
    rules = " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(names))
    return f"""p AS (SELECT p_partkey, lower(translate(p_brand, '#', '')) AS brand, 'mod' || (p_size % 4) AS folder, CASE WHEN p_partkey % 50 = 7 THEN 'index' ELSE 'f' || (p_partkey % 100) END AS base,
  'app/' || lower(translate(p_brand, '#', '')) || '/mod' || (p_size % 4) AS dir, 'app/' || lower(translate(p_brand, '#', '')) || '/mod' || (p_size % 4) || '/' || CASE WHEN p_partkey % 50 = 7 THEN 'index' ELSE 'f' || (p_partkey % 100) END || {suffix} AS path FROM part),
f AS (SELECT DISTINCT path, brand, folder, dir FROM p),
i AS (SELECT DISTINCT o.path, o.brand, o.dir, l_linenumber % {len(names)} AS rule, q.brand AS q_brand, q.folder AS q_folder, q.base AS q_base, CASE l_linenumber % {len(names)} {rules} END AS name FROM lineitem JOIN p o ON o.p_partkey = l_partkey JOIN p q ON q.p_partkey = l_suppkey)"""


QUERIES = {"j15_c_includes": _c, "j16_java_imports": _java, "j16_js_imports": _js, "j15_ruby_requires": _ruby, "j16_go_imports": _go, "j16_csharp_usings": _csharp}
SQL = {
    "j15_c_includes": f"""WITH {_files_sql("'.h'", "'../' || q.folder || '/' || q.base || '.h'", "q.folder || '/' || q.base || '.h'", "q.base || '.h'")},
w AS (SELECT path, name, CASE rule WHEN 0 THEN 'app/' || brand || substr(name, 3) ELSE dir || '/' || name END AS unit FROM i), near AS (SELECT DISTINCT w.path, name, unit FROM w WHERE unit IN (SELECT path FROM f)),
n AS (SELECT name, min(f.path) AS unit FROM (SELECT DISTINCT name FROM i) JOIN f ON ends_with(f.path, name) GROUP BY 1)
SELECT * FROM near UNION ALL SELECT DISTINCT i.path, i.name, n.unit FROM i JOIN n ON n.name = i.name WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.path = i.path AND near.name = i.name)""",
    "j16_java_imports": f"""WITH {_files_sql("'.java'", "'app.' || q.brand || '.' || q.folder || '.' || q.base", "q.brand || '.' || q.folder", "q.base")},
n AS (SELECT DISTINCT name, replace(name, '.', '/') AS slashed FROM i WHERE contains(name, '.')), c AS (SELECT name, min(path) AS unit FROM n JOIN f ON contains(path, slashed || '.java') GROUP BY 1),
k AS (SELECT DISTINCT name, dir AS unit FROM n JOIN f ON ends_with(dir, slashed) WHERE name NOT IN (SELECT name FROM c))
SELECT DISTINCT i.path, i.name, u.unit FROM i JOIN (SELECT * FROM c UNION ALL SELECT * FROM k) u ON u.name = i.name""",
    "j16_js_imports": f"""WITH {_files_sql("CASE WHEN p_partkey % 3 = 0 THEN '.js' ELSE '.ts' END", "'./' || q.base", "'../' || q.folder || '/' || q.base || '.ts'", "'../' || q.folder", "q.base")},
w AS (SELECT DISTINCT path, name, rule, CASE rule WHEN 0 THEN dir || substr(name, 2) ELSE 'app/' || brand || substr(name, 3) END AS a FROM i WHERE rule < 3),
t AS (SELECT path, name, a AS unit, 0 AS k FROM w WHERE rule = 1 UNION ALL SELECT path, name, a || x.s, x.k FROM w, (VALUES ('.ts', 0), ('.js', 1), ('/index.ts', 2), ('/index.js', 3)) x(s, k) WHERE rule <> 1)
SELECT path, name, arg_min(unit, k) AS unit FROM t WHERE unit IN (SELECT path FROM f) GROUP BY 1, 2""",
    "j15_ruby_requires": f"""WITH {_files_sql("'.rb'", "'../' || q.folder || '/' || q.base", "q.brand || '/' || q.folder || '/' || q.base || '.rb'", "q.base")},
n AS (SELECT name, min(f.path) AS unit FROM (SELECT DISTINCT name FROM i WHERE rule > 0) JOIN f ON ends_with(f.path, '/' || regexp_replace(name, '\\.rb$', '') || '.rb') GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT path, name, 'app/' || brand || substr(name, 3) || '.rb' AS unit FROM i WHERE rule = 0 AND 'app/' || brand || substr(name, 3) || '.rb' IN (SELECT path FROM f) UNION ALL SELECT DISTINCT i.path, i.name, n.unit FROM i JOIN n ON n.name = i.name WHERE rule > 0""",
    "j16_go_imports": f"""WITH {_files_sql("'.go'", "'example.com/app/' || q.brand || '/' || q.folder", "'example.com/' || q.brand || '/' || q.folder", "'fmt'")},
g AS (SELECT path, dir, CASE WHEN right(brand, 1) IN ('1', '3', '5') THEN brand ELSE 'app' END AS root, CASE WHEN right(brand, 1) IN ('1', '3', '5') THEN 'example.com/' ELSE 'example.com/app/' END || brand || '/' || folder AS package FROM f)
SELECT DISTINCT i.path, i.name, b.dir AS unit FROM i JOIN g a ON a.path = i.path JOIN g b ON b.root = a.root AND b.package = i.name""",
    "j16_csharp_usings": f"""WITH {_files_sql("'.cs'", "'App.' || q.brand || '.' || q.folder", "'App.' || q.brand || '.' || q.folder || '.' || q.base", "'App.' || q.brand || '.' || q.folder || '.' || q.base || '.Deep'")},
s AS (SELECT DISTINCT 'App.' || brand || '.' || folder AS unit FROM f)
SELECT DISTINCT i.path, name, unit FROM i JOIN s ON unit = 'App.' || q_brand || '.' || q_folder WHERE rule < 2 UNION SELECT path, 'App.' || brand || '.' || folder, 'App.' || brand || '.' || folder FROM f
UNION ALL SELECT '*', '*', unit FROM s WHERE unit = 'App.brand11.mod1' AND EXISTS (SELECT 1 FROM i WHERE name = 'App.brand11.mod1')""",
}
