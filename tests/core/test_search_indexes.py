"""The vector index, the keyword index and line diffs, held against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelark.functions.stems import STOP_WORDS, stem
from tidelark.operators import diffs, keywords, vectors

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Vectors


def clustered(seed, n, width=12, groups=9):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 4, (groups, width))
    return [(i, [float(v) for v in np.round(middle[r.integers(groups)] + r.normal(0, 1, width), 3)]) for i in range(n)]


def nearest_by_hand(rows, queries, k):
    keys, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
        out[q] = [(int(keys[i]), round(float(d[i]), 9)) for i in np.lexsort((keys, d))[:k]]
    return out


def found_by(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        assert r["rank"] == len(out[r.query]) + 1
        out[r.query].append((r.key, round(r.distance, 9)))
    return dict(out)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered(1, 900)
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    out = vectors.VectorIndex(spark, str(tmp_path_factory.mktemp("index")))
    out.build(spark.createDataFrame([*rows, (5000, None)], SCHEMA))
    return out, rows


def test_search_has_its_recall_and_exact_search_is_exact(spark, index):
    found, rows = index
    queries = [(i, v) for i, v in rows if i % 50 == 0] + [(2000, rows[7][1]), (2001, [100.0] * 12)]
    df = spark.createDataFrame(queries, "query long, embedding array<double>")
    expected = nearest_by_hand(rows, queries, 10)
    assert len(found.centres()) == math.isqrt(930)
    assert found_by(found.search(df, 10, exact=True)) == expected
    got = found_by(found.search(df, 10))
    hits = sum(len({k for k, _ in got[q]} & {k for k, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected) and found.probes() < len(found.centres()) / 2


def test_one_list_cannot_fill_a_result_so_others_are_read(spark, index):
    found, rows = index
    queries = [(1, rows[3][1])]
    got = found_by(found.search(spark.createDataFrame(queries, "query long, embedding array<double>"), 400, probes=1))
    assert got == nearest_by_hand(rows, queries, 400)


def test_large_lists_and_many_queries_are_dealt_out(spark, index, monkeypatch):
    found, rows = index
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    queries = [(i, rows[i][1]) for i in range(25)]
    df = spark.createDataFrame(queries, "query long, embedding array<double>")
    assert found_by(found.search(df, 5, exact=True)) == nearest_by_hand(rows, queries, 5)


def test_lists_are_partitions_that_a_scan_picks(index):
    found, _ = index
    read = found.vectors().where("list IN (2, 5)")
    assert "list" in plan_of(read).split("PartitionFilters: [")[1].split("]")[0]


def test_insert_goes_to_lists_and_rebuilds_when_they_are_too_few(spark, tmp_path):
    rows = clustered(2, 100)
    index = vectors.VectorIndex(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame(rows, SCHEMA))
    first, place = len(index.centres()), index.place
    more = [(100 + i, v) for i, v in clustered(3, 20)]
    assert not index.insert(spark.createDataFrame(more, SCHEMA)) and index.place == place
    many = [(200 + i, v) for i, v in clustered(4, 200)]
    assert index.insert(spark.createDataFrame(many, SCHEMA))
    assert index.place != place and (first, len(index.centres())) == (10, math.isqrt(320))
    queries = [(i, v) for i, v in [*more, *many] if i % 9 == 0]
    df = spark.createDataFrame(queries, "query long, embedding array<double>")
    assert found_by(index.search(df, 4, exact=True)) == nearest_by_hand([*rows, *more, *many], queries, 4)
    with pytest.raises(ValueError, match="no vectors"):
        vectors.VectorIndex(spark, str(tmp_path / "j")).build(spark.createDataFrame([], SCHEMA))


def test_recall_on_the_embeddings(spark):
    true = {(r["query"], r.vec_id) for r in vectors.QUERIES["t10_index_exact"](spark, DATA).collect()}
    got = {(r["query"], r.vec_id) for r in vectors.QUERIES["t10_index"](spark, DATA).collect()}
    assert len(true & got) >= 0.9 * len(true)


def test_rows_repeated_for_lists_come_in_bounded_batches():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([7, 8]), pa.array([[1.0] * 64, [2.0] * 64])], names=["query", "embedding"])
    rows, lists = np.repeat([0, 1], 30_000), np.tile(np.arange(30_000), 2)
    got = list(vectors._repeated(batch, rows, lists, 64))
    assert max(b.num_rows * 64 for b in got) <= vectors.BATCH_COMPONENTS and len(got) > 1
    assert pa.Table.from_batches(got).column("list").to_numpy().tolist() == lists.tolist()
    assert np.concatenate([b.column(0).to_numpy() for b in got]).tolist() == [7] * 30_000 + [8] * 30_000


def test_hybrid_reads_texts_of_chosen_ids_only(spark, monkeypatch):
    from tidelark.operators import search

    made = {}
    monkeypatch.setattr(search, "cut", lambda df, name, cut=search.cut: made.setdefault(name, cut(df, name)))
    rows = [(i, "the and" if i % 2 else f"the {i}", [float(i % 5), float(i)]) for i in range(200)]
    chunks = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    got = [r.id for r in search.hybrid(chunks, "the and", [0.0, 0.0], 3).collect()]
    assert len(got) == 3
    assert made["hybrid-ids"].columns == ["id"] and {r.id for r in made["hybrid"].collect()} == {0, 1, 2, 3, 4, 5, 7, 9, 11}


# Keywords


def test_stems():
    pairs = "consigned:consign consistency:consist consolatory:consolatori conspiracies:conspiraci knackeries:knackeri knightly:knight knitting:knit generates:generat happy:happi say:say dying:die ties:tie cries:cri gas:gas relational:relat hoping:hope hopping:hop agreed:agre feed:feed controlled:control rationalization:ration it's:it naïvely:naïvely"
    assert [p for p in pairs.split() if stem(p.split(":")[0]) != p.split(":")[1]] == []


def bm25_by_hand(docs, queries, every):
    """query: [(id, score)] of all documents with a word of the query, the best first."""
    import regex

    words = lambda t: [stem(w) for w in regex.findall(r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?", t.lower()) if w not in STOP_WORDS]
    bags = {i: Counter(words(f"{t or ''} {p or ''}")) for i, t, p in docs}
    n, df = len(docs), Counter(t for b in bags.values() for t in b)
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean, length = sum(raw.values()) / len(raw), sum(sum(b.values()) for b in bags.values()) / n
    out = {}
    for q, text in queries:
        asked, scores = Counter(words(text)), {}
        for i, b in bags.items():
            if (all if every else any)(t in b for t in asked) and asked:
                parts = [c * max(0.0, raw[t] if raw[t] >= 0 else 0.25 * mean) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / length)) for t, c in asked.items() if t in b]
                scores[i] = sum(parts)
        out[q] = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))
    return out


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    r = random.Random(6)
    vocabulary = ["running", "runs", "run", "houses", "the", "and", "nation", "national", "cats", "über", *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(r.choice(vocabulary[: r.choice([12, 50])]) for _ in range(r.randint(0, 60))), r.choice(["src/runner.py", "house/cat", None])) for i in range(300)]
    docs += [(900, None, None), (901, "", "w1"), (902, "the and", None)]
    index = keywords.KeywordIndex(spark, str(tmp_path_factory.mktemp("library") / "k"))
    index.build(spark.createDataFrame([(*d, "clash") for d in docs], "id long, text string, path string, term string"))
    queries = [(1, "Running houses"), (2, "the nation w3 w3 w17"), (3, "the and"), (4, "unknown words"), (5, "cat runner w5 w6 w7 w8 w9"), (6, "")]
    return index, docs, queries


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("k", [3, 1000])
def test_keyword_search_equals_bm25_over_stems(spark, library, every, k):
    index, docs, queries = library
    got = defaultdict(list)
    for r in sorted(index.search(spark.createDataFrame(queries, "query long, text string"), k, every).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r.id, round(r.score, 6)))
    for q, rows in bm25_by_hand(docs, queries, every).items():
        assert [s for _, s in got.get(q, [])] == [s for _, s in rows[:k]]
        assert {x for x in got.get(q, []) if x[1] > (rows[:k] or [(0, 0)])[-1][1]} == {x for x in rows[:k] if x[1] > rows[:k][-1][1]}


def test_few_of_the_postings_are_read(spark, library):
    index, _, _ = library
    asked = spark.createDataFrame([(1, "w3"), (2, "w3 w3 w3 running")], "query long, text string")
    levels, every = index.plan(asked, 3)[1], index.plan(asked, 3, every=True)[1]
    read, there = (Counter({r["query"]: r.n for r in x.groupBy("query").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}) for x in (levels, every))
    assert 0 < read[1] < 0.5 * there[1] and 0 < read[2] < there[2]
    text = plan_of(index._of_terms("postings", ["w3"], levels.where("term = 'w3'")))
    assert "bucket" in text.split("PartitionFilters: [")[1].split("]")[0] and "term" in text.split("PushedFilters: [")[1]


def test_words_are_counted_within_rows(spark, monkeypatch):
    monkeypatch.setattr(keywords, "KNOWN_STEMS", 2)
    docs = spark.createDataFrame([(1, "Running runs, the cats run"), (2, None), (3, "the"), (None, "naïve cat naïve")], "id long, text string")
    counts = keywords.term_counts(docs.repartition(3), "id", keywords.F.col("text"))
    assert "hashpartitioning" not in plan_of(counts) and "Aggregate" not in plan_of(counts)
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(map(str, [(1, "run", 3, 4), (1, "cat", 1, 4), (None, "cat", 1, 3), (None, stem("naïve"), 2, 3)]))


@pytest.mark.parametrize("every", [False, True])
def test_equal_questions_are_asked_once(spark, library, monkeypatch, every):
    made = {}
    monkeypatch.setattr(keywords, "cut", lambda df, name, cut=keywords.cut: made.setdefault(name, cut(df, name)))
    index, docs, queries = library
    asked = [(10 * n + q, text) for n in range(3) for q, text in queries]
    # A question in two rows is one text; one without an id has no rows.
    rows = [*asked[1:], (1, "Running"), (1, "houses"), (None, "cat"), (7, None)]
    got = defaultdict(list)
    for r in sorted(index.search(spark.createDataFrame(rows, "query long, text string"), 5, every).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r.id, round(r.score, 6)))
    by_hand = bm25_by_hand(docs, asked, every)
    assert {q: [s for _, s in x] for q, x in got.items()} == {q: [s for _, s in x[:5]] for q, x in by_hand.items() if x}
    assert all(got[q] == got[q + 10] == got[q + 20] for q in (1, 2, 5) if q in got)
    parts = made["parts"].collect()
    assert len(parts) == len({r["query"] for r in parts}) <= 4


# Line diffs


def test_diff_sizes_follow_the_rule(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    old = [("edit", "a\nb\nc\n"), ("grow", "x\n"), ("move", "1\n2\n3\n4\n"), ("same", "é\n"), ("gone", "éé\n"), ("head", "a\n"), ("null", None), ("end", "a")]
    new = [("edit", "a\nB!\nc\n"), ("grow", "x\nd\ne\n"), ("move", "2\n3\n4\n1\n"), ("same", "é\n"), ("new", "abcd"), ("head", "a\n++x\ny\n"), ("null", None), ("end", "a\n")]
    got = {r.path: tuple(r)[1:] for r in diffs.line_diffs(frame(*old), frame(*new)).collect()}
    assert got == {
        "edit": ("modified", 1, 1, 3, 2, 1),
        "grow": ("modified", 2, 0, 4, 0, 4),
        "move": ("modified", 1, 1, 2, 2, 0),
        "same": ("same", 0, 0, 0, 0, 0),
        "gone": ("deleted", 0, 1, 0, 5, 5),
        "new": ("added", 1, 0, 4, 0, 4),
        "head": ("modified", 2, 0, 2, 0, 2),
        "null": ("same", 0, 0, 0, 0, 0),
        "end": ("same", 0, 0, 0, 0, 0),
    }


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_what_a_diff_keeps_is_common_and_in_order(a, b):
    gone, new = diffs.diff(a, b)
    assert [x for i, x in enumerate(a) if i not in gone] == [x for i, x in enumerate(b) if i not in new]
    assert gone == sorted(set(gone)) and new == sorted(set(new))
    # Lines that occur once on each side and in the same order everywhere are all kept.
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    if once == [x for x in b if x in once]:
        assert not {a[i] for i in gone} & set(once)


def test_diff_of_long_files_ends_soon():
    a = [f"line {i}" for i in range(40_000)]
    b = [x for i, x in enumerate(a) if i % 97] + ["tail"] * 5
    gone, new = diffs.diff(a, b)
    assert len(gone) == len(range(0, 40_000, 97)) and len(new) == 5


def test_hits_of_queries_are_not_shuffled(spark, tmp_path, monkeypatch):
    docs = [(n, " ".join(w for m, w in enumerate(["lantern", "harbour", "violet", "quarry"]) if n % (m + 2) == 0), None) for n in range(60)]
    queries = spark.createDataFrame([(q, t) for q, t in enumerate(["lantern violet", "harbour", "quarry lantern lantern", "nothing", "violet harbour"])], "query long, text string")
    index = keywords.KeywordIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(docs, "id long, text string, path string"))
    for every in (False, True):
        df = index.search(queries, 4, every)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Aggregate" in x and "query#" in x and "id#" in x]
        one_block = sorted(map(tuple, df.collect()))
        monkeypatch.setattr(keywords, "BLOCK_POSTINGS", 7)
        monkeypatch.setattr(keywords, "BLOCK_QUERIES", 2)
        assert sorted(map(tuple, index.search(queries, 4, every).collect())) == one_block
        monkeypatch.undo()
        assert {q for q, *_ in one_block} == {0, 1, 2, 4} and len(one_block) == 16


def test_diffs_get_small_batches_of_long_files(spark, monkeypatch):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    monkeypatch.setattr(diffs, "BATCH_BYTES", 100_000)
    files = spark.createDataFrame([(n, "word\n" * 10_000) for n in range(12)], "path long, text string").coalesce(1)
    found = diffs.line_diffs(files, files.withColumn("text", diffs.F.concat("text", diffs.F.lit("end"))))
    assert {(r.status, r.added_lines) for r in found.collect()} == {("modified", 1)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "100000"
