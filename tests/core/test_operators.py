"""Operators on literal rows: the cases of the surveyed tests, in spirit."""

import datetime
import io
import itertools
import random
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.operators import access, aggregates, components, graphs, imports, listing, search, symbols, usage
from tidelark.plans import standins
from tidelark.plans.analytics import AnalyticsRun
from tidelark.sources.stores import ChunkStore, KeyedStore, ParquetStore, archive_members, git_log, next_cursor, page_text, paged_log, read_json, require_columns, walk, write_json
from tidelark.streaming import events

DATA = "/root/testdata/sf0.001"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    paths = ["a/b/c.tar.gz", ".bashrc", "x/.env.local", "name.", "Dockerfile", "src/main.py", "", None, ".git/config", "a/x.BIN", "d.o/f.txt"]
    got = values(spark, [(p,) for p in paths], "p string", C.suffix("p"), C.directory_of("p"), C.language_of("p"), C.is_analyzable("p"), C.naive_extension("p"), C.depth("p"))
    by = dict(zip(paths, got, strict=True))
    assert by["a/b/c.tar.gz"][:2] == (".gz", "a/b") and by[".bashrc"][0] == "" and by["x/.env.local"][0] == ".local" and by["name."][0] == ""
    assert by["src/main.py"][1:4] == ("src", "Python", True) and by["Dockerfile"][2] == "Dockerfile" and by[None][1] == "root" and by[""][1] == "root"
    assert not by[".git/config"][3] and not by["a/x.BIN"][3] and by["d.o/f.txt"][4] == ".txt" and by["a/b/c.tar.gz"][5] == 3


def test_texts_and_sizes(spark):
    got = values(spark, [("a\nb",), ("a\nb\n",), ("",)], "t string", C.line_count("t"))
    assert [g[0] for g in got] == [2, 2, 0]
    got = values(spark, [(99, 4, 6), (-101, 120, 80), (0, 0, 0)], "b int, a int, d int", C.bytes_to_sloc("b"), C.size_category(F.col("a") + F.col("d")), C.is_refactor("a", "d"), C.bytes_per_line("b", F.col("a") + F.col("d")))
    assert got == [(1, "small", False, 9.9), (2, "large", False, -0.505), (0, "tiny", False, 0.0)]
    assert values(spark, [(100, 95)], "a int, d int", C.is_refactor("a", "d")) == [(True,)]
    got = values(spark, [("deadBEEF 01\n",), ("xyz",), ("",), ("a\x00b",)], "t string", C.is_hex("t"), C.looks_binary("t"))
    assert got == [(True, False), (False, False), (False, False), (False, True)]
    got = values(spark, [(chr(c),) for c in range(32)], "t string", C.looks_binary("t"))
    assert [c for c in range(32) if not got[c][0]] == [9, 10, 11, 12, 13, 28, 29, 30, 31]


def test_encodings_of_contents(spark):
    text = "Größe: 12 €\n\tпривет 😀"
    cases = [(text.encode(), "utf-8"), (b"", "utf-8"), (text.encode("utf-16"), "utf-16le"), (b"\xfe\xff" + text.encode("utf-16-be"), "utf-16be"), ("plain text".encode("utf-16-le"), "utf-16le"), ("plain text".encode("utf-16-be"), "utf-16be")]
    cases += [("Größe".encode("latin-1"), "other"), (b"a\x07b", None), (b"a\x1bb", None), (b"\x00\x01\x02\x03", None), ("a\x07b".encode("utf-16-le"), None), (b"\xff\xfe\x00\xd8", None), (b"\xff\xfea", None), (bytes(range(256)), None), (("ж😀 a" * 100_000).encode("utf-16"), "utf-16le"), (("ж a" * 100_000).encode(), "utf-8")]
    got = values(spark, [(bytearray(c),) for c, _ in cases], "c binary", C.content_encoding("c"))
    assert [g[0] for g in got] == [e for _, e in cases]


def test_grants_are_ranked_before_members_meet_them(spark):
    day = datetime.datetime
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} string, asset_id string, role string, created_at timestamp")
    direct = frame([("u", "a", "viewer", day(2020, 1, 1)), ("u", "a", "asset_admin", day(2021, 1, 1)), ("u", "b", "odd", None)], "user_id")
    team = frame([("t", "a", "asset_admin", day(2019, 1, 1)), ("t", "a", "viewer", None), ("t", "c", "viewer", None), ("t", "c", "viewer", day(2022, 1, 1))], "team_id")
    org = frame([("o", "c", "super_admin", None), ("o", "a", "viewer", day(2018, 1, 1))], "org_id")
    members = spark.createDataFrame([("u", "t"), ("v", "t")], "user_id string, team_id string")
    staff = spark.createDataFrame([("v", "o")], "user_id string, org_id string")
    parts = (direct, team, members, org, staff)
    one_by_one = access.effective_role(access.effective_grants(*parts)).select("user_id", "asset_id", "role", "inherited", "created_at").collect()
    assert sorted(map(str, access.effective_roles(*parts).select("user_id", "asset_id", "role", "inherited", "created_at").collect())) == sorted(map(str, one_by_one))
    assert {tuple(r) for r in access.strongest_roles(*parts).collect()} == {tuple(r) for r in access.strongest_role(access.effective_grants(*parts)).collect()} == {("u", "asset_admin"), ("v", "super_admin")}
    assert {tuple(r) for r in access.users_by_asset(*parts).collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_strings(spark):
    got = values(spark, [("origin/feature/x", "it's naïve_café 2", "[a](b) [c](d/e)", "https://bk.s3.amazonaws.com/k%20ey?sig=1", "u1")], "b string, t string, m string, u string, i string", C.local_branch("b"), C.words("t"), C.markdown_links("m"), C.object_location("u"), C.user_key("i"), C.markdown_escaped(F.lit("a_b*c")))
    assert got[0][0] == "feature/x" and got[0][1] == ["it's", "naïve_café", "2"] and got[0][2] == ["b", "d/e"] and tuple(got[0][3]) == ("bk", "k ey") and got[0][4] == "auth0|u1" and got[0][5] == r"a\_b\*c"
    assert values(spark, [("origin/HEAD",)], "b string", C.local_branch("b")) == [(None,)]


def test_scores(spark):
    got = values(spark, [(0.0,), (1.0,), (2.5,)], "x double", C.semantic_score("x"), C.keyword_score("x"))
    assert got == [(0.0, 0.0), (1.0, 0.5), (0.0, 1 - 1 / 3.5)]


def test_file_ownership(spark):
    df = spark.createDataFrame([("m.py", "alice", 100, 0), ("m.py", "bob", 50, 0), ("z.py", "a", 5, 5), ("z.py", "b", 1, 1), ("", "a", 9, 0), ("m.py", "", 9, 0)], "file_path string, author_email string, additions_lines int, deletions_lines int")
    got = {(r.file_path, r.author_email): round(r.share, 2) for r in aggregates.file_ownership(df).collect()}
    assert got == {("m.py", "alice"): 66.67, ("m.py", "bob"): 33.33, ("z.py", "a"): 50.0, ("z.py", "b"): 50.0}


def test_diff_sizes(spark):
    diff = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n-old é\n+new\n+more\n ctx"
    got = {r.id: (r.added_lines, r.removed_lines, r.added_bytes, r.removed_bytes) for r in aggregates.diff_sizes(spark.createDataFrame([(1, diff), (2, "Binary files a and b differ"), (3, "")], "id int, diff string")).collect()}
    assert got == {1: (2, 1, 7, 6), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_invariants_of_rollups(spark):
    commits = standins.commits(spark, DATA)
    total = sum(r.total_net_lines for r in aggregates.repository_summary(commits).collect())
    assert total == sum(r.total_net_lines for r in aggregates.daily_rollup(commits).collect())
    shares = aggregates.directory_ownership(standins.file_changes(spark, DATA), commits, top=10**6).groupBy("directory").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-6 for r in shares)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", '{"x": {"y": "2"}}'), (2, "b", "{}"), (3, None, None)], "id int, name string, meta string")
    ids = lambda **f: [r.id for r in listing.where_all(df, f, ("meta",)).orderBy("id").collect()]
    assert ids(name="a,b") == [1, 2] and ids(id__gte=2) == [2, 3] and ids(nothing="x") == [1, 2, 3]
    assert [r.id for r in listing.where_all(df, {"meta.x.y__eq": "2"}, ("meta",)).collect()] == [1]
    with pytest.raises(ValueError, match="unknown comparison"):
        listing.where_all(df, {"id__about": 1})
    with pytest.raises(ValueError, match="limit"):
        listing.page(df, "id", "id", limit=101)
    assert [r.id for r in listing.page(df, "name", "id", descending=True, limit=10).collect()] == [2, 1, 3]
    assert listing.page_info(df, 0, 2) == (2, 1) and listing.page_info(df, 2, 2) == (None, 0)


def test_relational_division(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    sources = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "page_id int, source_id int")
    got = access.all_sources_authorised(pages, sources, spark.createDataFrame([(10,)], "source_id int"))
    assert {r.page_id for r in got.collect()} == {2, 3}


def test_suffix_join(spark):
    files = spark.createDataFrame([("a/x.h",), ("b/x.h",), ("c/lib/y.h",), ("zx.h",)], "path string")
    wanted = spark.createDataFrame([("x.h",), ("lib/y.h",), ("b/x.h",)], "include string")
    assert {tuple(r) for r in access.suffix_join(wanted, files).collect()} == {("x.h", "a/x.h"), ("lib/y.h", "c/lib/y.h"), ("b/x.h", "b/x.h")}
    assert {r.include for r in access.suffix_join(wanted, files, unique=True).collect()} == {"lib/y.h", "b/x.h"}


def test_closure_on_a_diamond_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (6, 5)], "src int, dst int")
    assert {tuple(r) for r in graphs.closure(edges).collect()} == {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (5, 6), (6, 5), (5, 5), (6, 6)}
    got = {r.node: (r.component, r.reach) for r in components.components_with_reach(edges).collect()}
    assert got == {1: (1, 4), 2: (2, 2), 3: (3, 2), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    seeds = spark.createDataFrame([("m", 2), ("d", 1)], "seed string, node int")
    assert {tuple(r) for r in graphs.reachable(edges, seeds).collect()} == {("m", 2), ("m", 4), ("d", 1), ("d", 2), ("d", 3), ("d", 4)}


def test_topological_numbers_within_ranges(spark):
    # All paths of a root were numbered by one task.
    paths = [f"a/d{i % 7}/f{i}" for i in range(400)] + [f"a/d{i}" for i in range(7)] + ["a", "b", "b/c"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = graphs.topological(spark.createDataFrame([(p,) for p in paths], "path string")).withColumn("task", F.spark_partition_id()).collect()
        got, tasks = {r.path: r.position for r in found}, Counter(r.task for r in found)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = {p: i + 1 for root in "ab" for i, p in enumerate(sorted((p for p in paths if p[0] == root), key=lambda p: (-p.count("/"), p)))}
    assert got == expected and max(tasks.values()) < 400


def test_approximate_neighbours(spark):
    # Recall of the default was 0.1, and fewer than k rows came back.
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").cache()
    recall = []
    for query in vectors.where("vec_id % 50 = 0").collect():
        found, exact = ({r.vec_id for r in f(vectors, [float(x) for x in query.embedding], 10).collect()} for f in (search.lsh_candidates, search.nearest))
        recall.append(len(found & exact) / 10)
    vectors.unpersist()
    assert len(recall) == 10 and sum(recall) / 10 >= 0.9
    few = spark.createDataFrame([(i, [-1.0] * 64) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.lsh_candidates(few, [1.0] * 64, 3).collect()] == [0, 1, 2]


def test_reachable_on_long_chains(spark):
    # A round of one step each stopped at 1,000 rounds.
    n = 1500
    chain = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    side = spark.createDataFrame([(700, 5000), (5000, 5001), (5001, 3), (6000, 5001), (5001, 5000)], "src long, dst long")
    seeds = spark.createDataFrame([("m", n - 1), ("d", 699), ("x", 6000), ("y", 9)], "seed string, node long")
    got = {(r.seed, r.node) for r in graphs.reachable(chain.union(side), seeds).collect()}
    expected = {("m", i) for i in [*range(n), 5000, 5001]} | {("d", i) for i in range(700)} | {("x", i) for i in [6000, 5000, 5001, 3, 2, 1, 0]} | {("y", i) for i in range(10)}
    assert got == expected
    assert graphs.reachable(chain, seeds.limit(0)).count() == 0


def test_reachable_equals_a_search(spark):
    r = random.Random(4)
    edges = list({(r.randrange(40), r.randrange(40), r.random() < 0.5) for _ in range(55)})
    seeds = [("a", 1), ("a", 17), ("b", 30)]
    expected, todo = set(seeds), list(seeds)
    while todo:
        seed, node = todo.pop()
        more = {(seed, d) for s, d, _ in edges if s == node} - expected
        expected |= more
        todo += more
    found = graphs.reachable(spark.createDataFrame(edges, "src long, dst long, first boolean"), spark.createDataFrame(seeds, "seed string, node long"))
    assert sorted(tuple(x) for x in found.collect()) == sorted(expected)


def test_reduced_documents_of_any_length(spark):
    # 4 * 2^13 words, halved 13 times; the cap was 12 rounds.
    docs = spark.createDataFrame([(1, " ".join(["w"] * (4 << 13))), (2, "a b c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in symbols.reduced(docs, symbols._half, 4).collect()} == {1: "w w", 2: "a c"}
    with pytest.raises(RuntimeError):
        symbols.reduced(docs.where("doc_id = 1"), lambda c: c, 4096, 2)


def test_folded_sizes_clamp(spark):
    deltas = [10, -30, 5, -2, -9, 7]
    size, expected = 0, []
    for d in deltas:
        size = max(0, size + d)
        expected.append(size)
    got = graphs.folded_sizes(spark.createDataFrame([("g", i, d) for i, d in enumerate(deltas)], "g string, n int, d int"), "g", "n", "d").orderBy("n").collect()
    assert [r.size for r in got] == expected


def test_bm25_equals_the_formula(spark):
    import math

    docs = [(1, "red fox and red hen"), (2, "the fox"), (3, "the the hen runs"), (4, "")]
    got = {r.id: r.bm25 for r in search.bm25(spark.createDataFrame(docs, "id int, text string"), ["red", "the", "none"]).collect()}
    bags = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, bags.values())) / len(docs)
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w in {w for b in bags.values() for w in b} for c in [sum(w in b for b in bags.values())]}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    for i, b in bags.items():
        assert abs(got[i] - sum(idf.get(w, 0) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in ("red", "the", "none"))) < 1e-9


def test_usage_balance(spark):
    rows = [(1, "credit", 1000, 0), (1, "view", -120, -30), (2, "view", -49, 0)]
    got = {r.organization_id: (r.credits, r.debits, r.balance) for r in usage.balance(spark.createDataFrame(rows, "organization_id int, event_type string, bytes_in long, bytes_out long")).collect()}
    assert got == {1: (20, 3, 17), 2: (0, 0, 0)}


def test_stores(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    keyed = KeyedStore(spark, str(tmp_path / "hot"), schema, ["k"])
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    assert keyed.read().count() == 0
    keyed.upsert(frame((1, "b"), (2, "b")), "v")
    keyed.upsert(frame((1, "a"), (2, "c")), "v")
    keyed.insert_ignore(frame((2, "z"), (3, "z")))
    keyed.delete(F.col("k") == 1)
    assert sorted(map(tuple, keyed.read().collect())) == [(2, "c"), (3, "z")]
    store = ParquetStore(spark, str(tmp_path / "root"))
    assert store.read("7", "t", schema).count() == 0
    store.write(frame((1, "x"), (2, "y")), "7", "t", partition_by="v")
    store.write(frame((9, "y")), "7", "t", partition_by="v")
    assert sorted(map(tuple, store.read("7", "t", schema).collect())) == [(1, "x"), (9, "y")]
    assert store.repositories() == ["7"] and store.delete("7") and store.repositories() == []
    chunked = ChunkStore(spark, str(tmp_path / "chunks"))
    chunked.write(frame((3, "c"), (4, "d")), 0)
    chunked.write(frame((1, "a"), (2, "b")), 1)
    chunked.merge_sorted(str(tmp_path / "merged"), "k")
    assert [r.k for r in spark.read.parquet(str(tmp_path / "merged")).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()] == [1, 2, 3, 4]
    assert chunked.chunks() == ["chunk_00000", "chunk_00001"] and chunked.delete_all() == 2 and chunked.chunks() == []
    write_json(frame((1, "a")), str(tmp_path / "j"))
    (tmp_path / "j" / "bad.json").write_text("no json\n")
    assert sorted((r.k or 0) for r in read_json(spark, str(tmp_path / "j"), schema).collect()) == [0, 1]
    assert read_json(spark, str(tmp_path / "none"), schema) is None


def test_required_columns(spark):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("a", LongType(), False), StructField("b", StringType())])
    assert require_columns(spark.createDataFrame([(1, None)], "a int, b string"), schema).collect()[0].a == 1
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.createDataFrame([(1,)], "a int"), schema)
    with pytest.raises(Exception, match="null in a"):
        require_columns(spark.createDataFrame([(None, "x")], "a int, b string"), schema).collect()


def test_archives_and_pages(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/x.txt", "hello")
        z.writestr("__MACOSX/x", "no")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "f.zip").write_bytes(data.getvalue())
    (tmp_path / "in" / "g.txt").write_text("t")
    got = archive_members(walk(spark, str(tmp_path / "in"), (".zip",))).collect()
    assert [(r.member, r.size, bytes(r.content)) for r in got] == [("a/x.txt", 5, b"hello")]
    html = "<html><title>t</title><script>x</script><p>a &amp; b</p><!-- c --><p>d<br>e</p></html>"
    assert spark.createDataFrame([(html,)], "h string").select(page_text("h")).first()[0] == "t a & b\nd\ne"


def test_python_symbols_and_imports(spark):
    files = spark.createDataFrame([("pkg/a.py", "import pkg.b\nfrom pkg.b import f\nclass K:\n    def m(self):\n        return f()\n"), ("pkg/b.py", "def f():\n    return 1\n"), ("bad.py", "def (")], "path string, source string")
    found = symbols.python_symbols(files)
    got = {(r.path, r.kind, r.name, r.parent) for r in found.collect()}
    assert {("pkg/a.py", "class", "K", ""), ("pkg/a.py", "function", "m", "K"), ("pkg/a.py", "call", "f", "K.m"), ("pkg/b.py", "function", "f", "")} <= got
    assert {(r.path, r.target) for r in symbols.resolved_imports(found, files).collect()} == {("pkg/a.py", "pkg/b.py")}


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"))
    got = events.result_of(events.tumbling(stream, lateness="400 days"), "t", str(tmp_path / "c1"), "complete")
    assert sorted((r.start, r.event_type, r.events) for r in got.collect()) == sorted((r.start, r.event_type, r.events) for r in events.tumbling(batch).collect())
    twice = batch.unionByName(batch)
    twice.repartition(2).write.parquet(str(tmp_path / "twice"))
    once = events.result_of(events.once_each(events.read_stream(spark, str(tmp_path / "twice")), "400 days"), "d", str(tmp_path / "c2"), "append")
    assert once.count() == batch.count()


@pytest.mark.parametrize("times_kept", [True, False])
def test_streams_of_many_files_lose_nothing(spark, tmp_path, monkeypatch, times_kept):
    # Each batch was some file of the table, so that later ones were behind the watermark or the last event let through.
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    read = events.read_stream
    monkeypatch.setattr(events, "read_stream", lambda s, path, files_per_batch: read(s, path, files_per_batch=1 if files_per_batch == 100 else files_per_batch))
    if not times_kept:
        found = events.in_order
        monkeypatch.setattr(events, "in_order", lambda *a: (found(*a)[0], False))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        once = sorted(tuple(r) for r in events.QUERIES["st9_dedup_stream"](spark, str(tmp_path)).collect())
        let_through = sorted((r.user_id, r.event_id) for r in events.QUERIES["st12_throttle_stream"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert once == sorted(tuple(r) for r in table.select("event_id", "event_type").collect())
    expected, last = [], {}
    for u, e, t in sorted((tuple(r) for r in table.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp"))).collect()), key=lambda r: (r[2], r[1])):
        if u not in last or t - last[u] >= 3_600_000_000:
            expected.append((u, e))
            last[u] = t
    assert let_through == sorted(expected)


def test_late_events_never_overwrite(spark, tmp_path):
    schema = spark.createDataFrame([], "user_id long, event_id long, ts timestamp, event_type string").schema
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    store = KeyedStore(spark, str(tmp_path / "latest"), schema, ["user_id"])
    handle = events.keep_latest_in(store, "ts", "user_id")
    handle(spark.createDataFrame([(1, 5, t(5), "new"), (1, 3, t(3), "old"), (2, 1, t(1), "a")], schema), 0)
    handle(spark.createDataFrame([(1, 4, t(4), "late"), (2, 9, t(9), "b")], schema), 1)
    assert {r.user_id: r.event_type for r in store.read().collect()} == {1: "new", 2: "b"}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    frame = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"))
    frame(0, 10).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.read_stream(spark, str(tmp_path / "in"), "event_id long")
    for a in (10, 20):
        events.apply_batches(stream(), str(tmp_path / "offsets"), events.append_to(str(tmp_path / "out"))).awaitTermination()
        frame(a, a + 10).write.mode("append").parquet(str(tmp_path / "in"))
    events.apply_batches(stream(), str(tmp_path / "offsets"), events.append_to(str(tmp_path / "out"))).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_dispatch(spark):
    seen = {}
    rows = spark.createDataFrame([(1, "s"), (2, "sdu"), (3, "fp"), (4, "add_organization_member")], "event_id long, event_type string")
    events.dispatch({k: (lambda df, k=k: seen.update({k: [r.event_id for r in df.collect()]})) for k in ("login", "delete_user", "membership")})(rows, 0)
    assert seen == {"login": [1], "delete_user": [2], "membership": [4]}


def test_incremental_run_equals_full_run(spark, tmp_path):
    commits, changes = standins.commits(spark, DATA).cache(), standins.file_changes(spark, DATA)
    as_of, middle = F.to_timestamp(F.lit("1998-06-01")), F.to_timestamp(F.lit("1995-06-01"))
    full = AnalyticsRun(spark, str(tmp_path), "1")
    assert not full.run(commits, changes, as_of).skipped
    parts = AnalyticsRun(spark, str(tmp_path), "2")
    parts.run(commits.where(F.col("committed_at") <= middle), changes, as_of)
    second = parts.run(commits, changes, as_of, incremental=True)
    assert 0 < second.new_commits < commits.select("commit_sha").distinct().count()
    for name in ("repository", "daily", "monthly", "branches", "contributors", "ownership"):
        a, b = full.read(name), parts.read(name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
    assert parts.run(commits, changes, as_of, incremental=True).skipped
    gone = parts.run(commits.where("branch_name <> 'low'"), changes, as_of, incremental=True)
    assert not gone.skipped
    kept = parts.read("branches").where("is_deleted").select("branch_name").distinct().collect()
    assert [r.branch_name for r in kept] == ["low"]
    assert spark.read.json(str(tmp_path / "2" / "marts" / "branch_list")).count() > 0


def test_late_repeated_and_removed_commits(spark, tmp_path):
    commits, changes = standins.commits(spark, DATA).cache(), standins.file_changes(spark, DATA)
    as_of = F.to_timestamp(F.lit("1998-06-01"))

    def same_as_full(run, commits, name):
        full = AnalyticsRun(spark, str(tmp_path), name)
        full.run(commits, changes, as_of)
        for t in ("repository", "daily", "branches", "ownership"):
            a, b = full.read(t), run.read(t)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), (name, t)

    # Commits that are older than those of the last run; branch copies of known commits.
    late = AnalyticsRun(spark, str(tmp_path), "late")
    late.run(commits.where("committed_at > '1996-01-01' AND branch_name = 'main'"), changes, as_of)
    assert late.run(commits, changes, as_of, incremental=True).new_commits > 0
    same_as_full(late, commits, "full-1")
    # What a run that died has left behind counts for nothing.
    for name, rows in (("commits", commits), ("file_changes", changes)):
        rows.write.parquet(str(tmp_path / "late" / name / "run=3"))
    assert late.run(commits, changes, as_of, incremental=True).skipped
    # A branch that has lost commits was rewritten.
    fewer = commits.where("commit_sha NOT LIKE '%7'")
    assert not late.run(fewer, changes, as_of, incremental=True).skipped
    same_as_full(late, fewer, "full-2")


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def links(df):
    return sorted((r.path, r.name, r.unit) for r in df.collect())


def test_import_rules(spark):
    files = lambda *paths: spark.createDataFrame([(p, 1) for p in (*paths, paths[0], None)], "path string, unit int")
    wanted = lambda *rows: spark.createDataFrame([*rows, rows[0], (None, "x"), ("a", None), ("a", "")], "path string, name string")
    c = imports.c_includes(wanted(("r/a/x.c", "y.h"), ("r/a/x.c", "../b/z.h"), ("r/b/w.c", "y.h"), ("r/a/x.c", "none.h"), ("r/b/w.c", "a/y.h")), files("r/a/y.h", "r/a/b/my.h", "r/b/z.h", "q/a/y.h"))
    assert links(c) == [("r/a/x.c", "../b/z.h", "r/b/z.h"), ("r/a/x.c", "y.h", "r/a/y.h"), ("r/b/w.c", "a/y.h", "q/a/y.h"), ("r/b/w.c", "y.h", "q/a/y.h")]
    assert links(imports.c_includes(wanted(("r/c.c", "y.h")), files("r/a/my.h"))) == [("r/c.c", "y.h", "r/a/my.h")]
    java = imports.java_imports(wanted(("r/M.java", "com.a.K"), ("r/M.java", "com.a"), ("r/M.java", "K"), ("r/M.java", "org.x")), files("r/com/a/K.java", "r/com/a/L.java", "r/sub/com/a/N.java"))
    assert links(java) == [("r/M.java", "com.a", "r/com/a"), ("r/M.java", "com.a", "r/sub/com/a"), ("r/M.java", "com.a.K", "r/com/a/K.java")]
    js = imports.js_imports(wanted(("r/a/m.ts", "./x"), ("r/a/m.ts", "../b"), ("r/a/m.ts", "../b/y.js"), ("r/a/m.ts", "./x.css"), ("r/a/m.ts", "x"), ("r/a/m.ts", "../../../r/a/x")), files("r/a/x.js", "r/a/x.ts", "r/b/index.js", "r/b/y.js", "r/a/x.css"))
    assert links(js) == [("r/a/m.ts", "../b", "r/b/index.js"), ("r/a/m.ts", "../b/y.js", "r/b/y.js"), ("r/a/m.ts", "./x", "r/a/x.ts")]
    required = spark.createDataFrame([("r/a.rb", "lib/x", True), ("r/a.rb", "x", False), ("r/a.rb", "y.rb", False), ("r/a.rb", "u", False), ("r/a.rb", "u", None)], "path string, name string, relative boolean")
    assert links(imports.ruby_requires(required, files("r/lib/x.rb", "r/b/y.rb", "r/c/y.rb", "r/mu.rb"))) == [("r/a.rb", "lib/x", "r/lib/x.rb"), ("r/a.rb", "x", "r/lib/x.rb")]


def test_import_packages(spark):
    mods = spark.createDataFrame([("r/go.mod", "// c\nmodule ex.com/r \n"), ("r/sub/go.mod", "module ex.com/s\n"), ("r/x/go.mod", "nothing")], "path string, text string")
    files = spark.createDataFrame([("r/m.go",), ("r/u/a.go",), ("r/u/b.go",), ("r/sub/n.go",), ("r/sub/k/d.go",), ("r/u/t.txt",), ("q/z.go",)], "path string")
    packages = imports.go_packages(files, imports.go_modules(mods))
    assert {(r.path, r.package) for r in packages.collect()} == {("r/m.go", "ex.com/r"), ("r/u/a.go", "ex.com/r/u"), ("r/u/b.go", "ex.com/r/u"), ("r/sub/n.go", "ex.com/s"), ("r/sub/k/d.go", "ex.com/s/k")}
    asked = spark.createDataFrame([("r/m.go", "ex.com/r/u", False), ("r/m.go", "ex.com/s", False), ("r/sub/n.go", "ex.com/s/k", None), ("r/m.go", "ex.com/r", True)], "path string, name string, skipped boolean")
    assert links(imports.go_imports(asked, packages)) == [("r/m.go", "ex.com/r/u", "r/u"), ("r/sub/n.go", "ex.com/s/k", "r/sub/k")]
    rows = [("a", "N.A", "namespace"), ("b", "N.A", "namespace"), ("b", "N.B", "namespace"), ("c", "N.A.Type", "using"), ("c", "N.B", "using"), ("c", "N.A.Type.Deep", "using"), ("d", "N.B.T", "global")]
    own, everywhere = imports.csharp_usings(spark.createDataFrame(rows, "path string, name string, kind string"))
    assert links(own) == [("a", "N.A", "N.A"), ("b", "N.A", "N.A"), ("b", "N.B", "N.B"), ("c", "N.A.Type", "N.A"), ("c", "N.B", "N.B"), ("d", "N.B.T", "N.B")]
    assert [r.unit for r in everywhere.collect()] == ["N.B"]
    held = imports.members(files, spark.createDataFrame([("r/m.go", "N.A")], "path string, name string"))
    uses = spark.createDataFrame([(1, "r/m.go", "f"), (2, "r/m.go", "g"), (3, "r/sub/n.go", "f")], "use_id int, file string, name string")
    defs = spark.createDataFrame([("f", "r/u/a.go", 10), ("g", "r/u/a.go", 11), ("g", "r/u/b.go", 12)], "name string, def_file string, def_id int")
    assert [tuple(r) for r in imports.link_uses_by_unit(uses, defs, imports.go_imports(asked, packages), held).collect()] == [(1, 10)]


def test_tree_sizes_equal_a_fold(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 999]) if i < 2 else rng.choice([i - 1, rng.randrange(i)]), rng.randrange(-30, 25)) for i in range(120)]
    size = {}
    for node, parent, delta in rows:
        size[node] = max(0, size.get(parent, 0) + delta)
    got = graphs.tree_sizes(spark.createDataFrame(rows, "node int, parent int, delta int")).collect()
    assert {r.node: r.size for r in got} == size and len(got) == 120
    assert graphs.tree_sizes(spark.createDataFrame([], "node int, parent int, delta int")).collect() == []
    with pytest.raises(ValueError):
        graphs.tree_sizes(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "node int, parent int, delta int"))


def test_git_log_reads_exports(spark, tmp_path):
    text = "\x1es1\x1fp1 p2\x1fAnn\x1fa@x\x1f2024-05-01T10:00:00+02:00\x1fsub\tject\n\n1\t2\ta/b.py\n-\t-\timg.png\n3\t0\tsrc/{old => new}/f.py\n0\t0\tx.py => y.py\n1\t1\t{a => }/z.py\n\x1es2\x1f\x1fB\x1fb@x\x1fnot a date\x1f\n"
    (tmp_path / "in").mkdir()
    for name in ("one.log", "two.log"):
        (tmp_path / "in" / name).write_text(text)
    found, changes = git_log(spark, str(tmp_path / "in"))
    rows = {r.commit_sha: r for r in found.collect()}
    assert len(rows) == found.count() == 2 and rows["s1"].parents == ["p1", "p2"] and rows["s1"].message == "sub\tject" and rows["s1"].committed_at.hour == 8
    assert rows["s2"].parents == [] and rows["s2"].committed_at is None
    got = sorted((r.file_path, r.additions_lines, r.deletions_lines) for r in changes.collect())
    assert got == [("/z.py", 1, 1), ("a/b.py", 1, 2), ("img.png", None, None), ("src/new/f.py", 3, 0), ("y.py", 0, 0)]


def test_paged_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('[{"log_id": "b", "type": "s"}, {"log_id": "c", "type": "x"}]\nno page\n[]\n[{"log_id": "a", "type": "s"}, {"log_id": "b", "type": "s"}, {"type": "s"}]\n')
    read = lambda **k: paged_log(spark, str(tmp_path / "in"), "log_id string, type string", **k)
    assert sorted(r.log_id for r in read().collect()) == ["a", "b", "c"] and next_cursor(read()) == "c"
    assert [r.log_id for r in read(after="a", kinds=["s"]).collect()] == ["b"] and next_cursor(read(after="c")) is None
    query = read(stream=True).writeStream.format("memory").queryName("paged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    assert sorted(r.log_id for r in spark.table("paged").collect()) == ["a", "b", "c"]


def test_functions_by_batch(spark):
    seen = spark.sparkContext.accumulator(0)

    def upper(texts):
        seen.add(len(texts))
        assert 0 < len(texts) <= 3 and None not in texts
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"t{i}") for i in range(20)], "i int, t string").coalesce(1)
    assert {r.i: r.u for r in df.select("i", symbols.by_batch(upper, "string", 3)("t").alias("u")).collect()} == {i: None if i % 4 == 0 else f"T{i}" for i in range(20)}
    assert seen.value == 15
    half = symbols.by_batch(lambda texts: [t[: len(t) // 2] for t in texts], "string")
    docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "x"), (3, ""), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in symbols.reduced(docs, half, 2).collect()} == {1: "a", 2: ""}
    assert symbols.embedded_chunks(docs.limit(0), symbols._sizes).count() == 0


def _many_principals(spark):
    day = datetime.date
    direct = spark.createDataFrame([(1, "a", "viewer", day(2024, 1, 1)), (2, "a", "asset_admin", day(2024, 1, 2)), (99, "b", "viewer", None), (None, "c", "viewer", day(2024, 1, 1)), (3, None, "owner", day(2024, 1, 3))], "user_id long, asset_id string, role string, created_at date")
    teams = spark.createDataFrame([(7, "a", "asset_admin", day(2024, 1, 3)), (8, "a", "viewer", None), (8, "b", "asset_admin", day(2023, 1, 1)), (5, "d", "viewer", None), (None, "d", "viewer", None)], "team_id long, asset_id string, role string, created_at date")
    members = spark.createDataFrame([(u, t) for u in range(40) for t in (7, 8) if u % (t - 5) == 0] + [(None, 7), (6, 7), (1, None)], "user_id long, team_id long")
    orgs = spark.createDataFrame([("x", "a", "super_admin", day(2024, 1, 1)), ("x", "b", "asset_admin", day(2022, 1, 1)), ("y", "c", "viewer", None), ("y", None, "viewer", None)], "org_id string, asset_id string, role string, created_at date")
    return direct, teams, members, orgs, spark.createDataFrame([(u, "xyz"[u % 3]) for u in range(30)], "user_id long, org_id string")


@pytest.mark.parametrize("cell, bucket", [(1024, 65536), (1, 3)])
def test_users_meet_grants_by_cells(spark, monkeypatch, cell, bucket):
    monkeypatch.setattr(access, "CELL", cell)
    monkeypatch.setattr(access, "BUCKET", bucket)
    parts = _many_principals(spark)
    grants = access.effective_grants(*parts).cache()
    columns = ["user_id", "asset_id", "role", "inherited", "created_at"]
    expected = sorted(map(str, access.effective_role(grants).select(columns).collect()))
    assert sorted(map(str, access.effective_roles(*parts).collect())) == expected
    users = grants.groupBy("asset_id").agg(F.countDistinct("user_id").alias("users"))
    assert sorted(map(str, access.users_by_asset(*parts).collect())) == sorted(map(str, users.collect()))


@pytest.mark.parametrize("found", [access.users_by_asset, access.effective_roles])
def test_no_row_of_a_user_and_asset_is_shuffled(spark, found):
    plan = found(*_many_principals(spark))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x or "Aggregate" in x or "Window" in x]
    # Users are keys of broadcast joins only, while grants and cells are grouped.
    assert lines and not [x for x in lines if "user_id#" in x.split("functions=")[0] and "Broadcast" not in x]


def test_allowed_users_are_found_before_they_are_listed(spark):
    parts = _many_principals(spark)
    actions = spark.createDataFrame([("asset_admin", "edit"), ("viewer", "read"), (None, "edit")], "role string, action string")
    expected = access.allowed(access.effective_role(access.effective_grants(*parts)), actions, "edit")
    found = access.effective_roles(*parts, may=access._allowing(actions, "edit")).select("user_id", "asset_id")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def _in_three_teams(spark):
    teams = [(t, a, ["viewer", "asset_admin"][(t + a) % 2], None) for t in range(3) for a in range(50)]
    teams = spark.createDataFrame(teams, "team_id long, asset_id long, role string, created_at date")
    members = spark.createDataFrame([(u, u % 3) for u in range(90)], "user_id long, team_id long")
    direct = spark.createDataFrame([(7, a, "viewer", None) for a in (3, 5)], "user_id long, asset_id long, role string, created_at date")
    return direct, teams, members, spark.createDataFrame([], "org_id long, asset_id long, role string, created_at date"), spark.createDataFrame([], "user_id long, org_id long")


def _switches(df):
    """How often rows that follow each other in a partition are of users of different teams."""
    parts = df.select("user_id", F.spark_partition_id()).collect()
    return sum(p == q and u % 3 != v % 3 for (u, p), (v, q) in itertools.pairwise(parts))


def test_allowed_users_are_listed_cell_by_cell(spark):
    may = spark.createDataFrame([("asset_admin",)], "role string")
    found = access.effective_roles(*_in_three_teams(spark), may=may).select("user_id", "asset_id")
    assert found.count() == 75 * 30
    assert _switches(found) <= 10


def test_roles_are_listed_cell_by_cell(spark, monkeypatch):
    parts = _in_three_teams(spark)
    found = access.effective_roles(*parts)
    assert _switches(found) <= 20
    expected = sorted(map(str, access.effective_role(access.effective_grants(*parts)).select(found.columns).collect()))
    assert sorted(map(str, found.collect())) == expected
    # Few assets at once, of which some have no grants of teams.
    monkeypatch.setattr(access, "TURNS", 5)
    turns = [access._turns]
    monkeypatch.setattr(access, "_turns", lambda batch: turns.append(batch.num_rows) or turns[0](batch))
    assets = [{"asset_id": a, "bucket": 0, "grants": [{"how": {"role": "viewer", "inherited": True, "created_at": None}, "cells": [1, 2, 3][: a % 4]}] * (a % 3), "direct": []} for a in range(12)]
    schema = pa.schema([("asset_id", pa.int64()), ("bucket", pa.int64()), ("grants", pa.list_(pa.struct([("how", pa.struct([("role", pa.string()), ("inherited", pa.bool_()), ("created_at", pa.date32())])), ("cells", pa.list_(pa.int64()))]))), ("direct", pa.list_(pa.struct([("how", pa.int64()), ("user_id", pa.int64()), ("cell", pa.int64())])))])
    rows = [r for b in access._by_cell([pa.RecordBatch.from_pylist(assets, schema)]) for r in b.to_pylist()]
    assert sum(turns[1:]) == 12 and max(turns[1:]) < 8
    assert sorted((r["cell"], a["asset_id"]) for r in rows for a in r["assets"]) == sorted((c, a) for a in range(12) if a % 3 for c in [1, 2, 3][: a % 4])


def _many_intervals(spark):
    draw = random.Random(5)
    rows = [(n % 2, n, s, s + draw.choice([0, 3, 40, 900, 70_000])) for n in range(300) for s in [draw.randrange(-500, 3_000)]]
    rows += [(0, 1_000, -(2**50), 2**50), (0, 1_001, 7, 9), (0, 1_002, 7, 9), (0, 1_003, 7, 9), (1, 1_004, -(2**50), 2**50)]
    return rows, spark.createDataFrame(rows, "file int, id long, start long, stop long")


def _around(rows):
    return [(f, i, o, e - s, s) for f, i, a, b in rows for g, o, s, e in rows if f == g and i != o and s <= a and b <= e]


def test_intervals_of_any_length(spark):
    rows, df = _many_intervals(spark)
    found = [(r.file, r.inner_id, r.outer_id, r._e - r._s, r._s) for r in access.interval_join(df, df).collect()]
    assert sorted(found) == sorted(_around(rows))


def test_pairs_of_intervals_come_in_like_runs(spark, monkeypatch):
    rows, df = _many_intervals(spark)
    monkeypatch.setattr(access, "BLOCK_INTERVALS", 7)
    found = [(r.file, r.inner_id, r.outer_id, r._e - r._s, r._s) for r in access.interval_join(df, df).collect()]
    assert sorted(found) == sorted(_around(rows))
    monkeypatch.undo()
    # Copies of a few places: the outer ids around one inner interval are those around the next, in the same order.
    places = [(0, s, s + size) for s in range(0, 64, 4) for size in (2, 500)]
    copies = spark.createDataFrame([(f, n * len(places) + m, s, e) for n in range(12) for m, (f, s, e) in enumerate(places)], "file int, id long, start long, stop long")
    runs = [[r.outer_id for r in g] for _, g in itertools.groupby(access.interval_join(copies.orderBy(F.xxhash64("id")), copies.orderBy(F.xxhash64("id"))).collect(), lambda r: (r.inner_id, r._e - r._s))]
    steps = [abs(len(a) - len(b)) <= 1 and len({*a} ^ {*b}) <= 2 for a, b in itertools.pairwise(runs)]
    assert sum(steps) > 0.8 * len(steps)


def test_innermost_of_any_length_and_of_one_place(spark):
    rows, df = _many_intervals(spark)
    best = {}
    for f, i, o, size, start in _around(rows):
        best[f, i] = min(best.get((f, i), (size, start, o)), (size, start, o))
    assert {(r.file, r.inner_id): r.outer_id for r in access.innermost(df, df).collect()} == {k: v[2] for k, v in best.items()}


def test_pairs_of_a_group_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(access, "PAIR_ROWS", 5)
    left = spark.createDataFrame([(n, n % 2 if n < 30 else None) for n in range(32)], "a int, k int")
    right = spark.createDataFrame([(n, n % 3) for n in range(60)], "b int, k int")
    got = access.all_pairs(left, right, "k").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for a in range(30) for b in range(60) if a % 2 == b % 3)
    assert all(len({r.task for r in got if r.k == k}) > 3 for k in (0, 1))


def test_closure_writes_each_pair_once(spark, monkeypatch):
    written = []
    plain = graphs.cut

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(graphs, "cut", counted)
    draw = random.Random(3)
    pairs = {(n, n + 1) for n in range(40)} | {(draw.randrange(30), draw.randrange(40)) for _ in range(5)} | {(50, 50)}
    known = set(pairs)
    while more := {(a, d) for a, b in known for c, d in pairs if b == c} - known:
        known |= more
    got = [tuple(r) for r in graphs.closure(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()]
    assert len(got) == len(known) and set(got) == known and sum(written) == len(known)


def test_import_lines_are_compared_by_numbers(spark):
    made, files = imports._imports(spark, "/root/testdata/sf0.001", ".h", imports._of("{folder}/{base}.h"), imports._of("{base}.h"))
    rows = [tuple(r) for r in made.select("path", "name", "rule").collect()]
    assert len(rows) == len(set(rows)) > 0 and {r[0] for r in rows} <= {r.path for r in files.collect()}
    assert "Aggregate [path" not in made._jdf.queryExecution().optimizedPlan().toString()
