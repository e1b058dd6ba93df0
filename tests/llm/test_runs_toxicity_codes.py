"""Periodic runs, toxicity and vector codes, held against brute force, planted cases and SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelark.llm import op11_runs, op12_toxicity, op13_vector_codes

DATA = "/root/testdata/sf0.001"


# Runs


def runs_by_hand(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@st.composite
def sequences(draw):
    letters = st.integers(0, draw(st.integers(0, 3)))
    words = draw(st.lists(letters, max_size=40))
    if words and draw(st.booleans()):
        a, k = draw(st.integers(0, len(words) - 1)), draw(st.integers(2, 9))
        p = 1 + (len(words) - a) // k
        words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
    return words + words[: draw(st.integers(0, 40))] + draw(st.sampled_from([[], [7], [7, *words]]))


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences(), max_size=4), st.sampled_from([2, 4, 5, 12]))
def test_runs_equal_brute_force(groups, least):
    numbers, sizes = np.array([w for g in groups for w in g], dtype=np.int64), np.array([len(g) for g in groups], dtype=np.int64)
    found = op11_runs.find_runs(numbers, sizes, least)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [runs_by_hand(g, least) for g in groups]


def op11_by_hand(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_hand(words, 12)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


class Tables:
    """Stands for a session whose reader gives rows of one's own."""

    def __init__(self, spark, **tables):
        self._spark, self._tables = spark, tables
        self.read, self.sparkContext = self, spark.sparkContext

    def parquet(self, path):
        return self._tables[path.rsplit("/", 1)[1].removesuffix(".parquet")]


def test_op11_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (None, "x y " * 20), (None, "x y " * 20), (7, "x y " * 20), (504, "a b c\x0bd " * 30), (505, "w " * 20_000 + "end"), (506, " ".join(f"w{i % 7000}" for i in range(30_000)))]
    loops = [i for i in range(600, 900) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 60)))) for i in loops]
    docs = spark.createDataFrame([(i, t, 1.0, "clash") for i, t in rows], "doc_id long, text string, n_words double, runs string")
    got = op11_runs.op11_runs(Tables(spark, documents=docs), "")
    by_hand = [op11_by_hand(i, t) if i != 506 and i != 505 else None for i, t in rows]
    long_ = {r.doc_id: r for r in got.where("doc_id IN (505, 506)").collect()}
    assert (long_[505].n_runs, long_[505].length, long_[505].period) == (1, 20_000, 1)
    assert (long_[506].start, long_[506].length, long_[506].period) == (0, 30_000, 7_000)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.where("doc_id IS NULL OR doc_id NOT IN (505, 506)").collect()), key=key) == sorted(filter(None, by_hand), key=key)
    assert op11_runs.op11_runs(Tables(spark, documents=docs.limit(0)), "").count() == 0


def test_op11_on_the_documents(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in texts if len((r.text or "").split()) < 500]
    got = {r.doc_id: tuple(r) for r in op11_runs.op11_runs(spark, DATA).collect()}
    assert len(got) == len(texts) and len(some) > 50
    for r in some:
        assert got[r.doc_id] == op11_by_hand(r.doc_id, r.text)


def test_groups_do_not_change_runs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    a = op11_runs.collapse_runs(docs, group_bytes=1 << 12).selectExpr("doc_id", "n_words", "to_json(runs) r", "collapsed").collect()
    b = op11_runs.collapse_runs(docs).selectExpr("doc_id", "n_words", "to_json(runs) r", "collapsed").collect()
    assert sorted(a) == sorted(b)


# Toxicity


def planted(n, seed):
    """Documents of harmless sentences; a toxic one has one or two sentences with a bad word or a bad beginning."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(r.choice(["the", "and", "pine", "Rain", "été", "on", f"w{r.randint(0, 400)}"]) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 30))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 2)):
                sentences.insert(r.randint(0, len(sentences)), f"pine {r.choice(['vilely', 'Gruk' + r.choice('abcdefgh') * 3])} rain")
        rows.append((i, ". ".join(sentences) + ".", int(toxic)))
    return rows


def test_toxic_documents_and_their_sentences(spark):
    rows = planted(1200, 1)
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.createDataFrame([(i, t, "de", 0.5, 0) for i, t, _ in rows], "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, y, 0.1) for i, _, y in rows] + [(None, 1, 0.0), (5, None, 0.0)], "doc_id long, toxic int, score double")
    got = op12_toxicity.op12_toxicity(Tables(spark, documents=docs, labels=labels), "").collect()
    assert {r.doc_id for r in got if r.held_out} == held
    unseen = [r for r in got if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in unseen) >= 0.97 * len(unseen)
    model = op12_toxicity.fit(op12_toxicity.sample(docs, labels))
    spans = {r.doc_id: r.offending for r in op12_toxicity.score_sentences(docs, model).collect() if r.held_out}
    hit = 0
    for i in held:
        text = rows[i][1]
        assert all(text[s.start : s.end] == s.text for s in spans[i])
        if rows[i][2]:
            hit += any("vilely" in s.text or "Gruk" in s.text for s in spans[i])
    assert hit >= 0.95 * sum(rows[i][2] for i in held)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = planted(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    at = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    true = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - y if at(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert op12_toxicity.sample(docs, true) == op12_toxicity.sample(docs, wrong)


def test_the_noisy_or_is_that_of_the_sentences(spark):
    docs = spark.createDataFrame([(1, "bad word. fine here! bad bad"), (2, "fine")], "doc_id long, text string")
    weights = np.zeros(op12_toxicity.BUCKETS, dtype=np.float32)
    hasher = op12_toxicity.SentenceHasher()
    weights[hasher.features([b"bad"])[0][0, -1]] = 3.0
    got = {r.doc_id: r for r in op12_toxicity.score_sentences(docs, (weights, -2.0)).collect()}
    p = lambda z: 1 / (1 + math.exp(-z))
    assert got[1].score == pytest.approx(1 - (1 - p(1)) ** 2 * (1 - p(-2))) and got[2].score == pytest.approx(p(-2))
    assert [(s.start, s.end) for s in got[1].offending] == [(0, 8), (21, 28)] and got[1].n_sentences == 3


def test_odd_texts_have_a_score(spark):
    schema = "doc_id long, text string, held_out string, offending int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, " .!\n", "x", 1), (None, "bad", "x", 1), (None, "bad", "x", 1), (4, "word " * 200_000, "x", 1), (4, "other", "x", 1)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = op12_toxicity.op12_toxicity(Tables(spark, documents=docs, labels=none), "").collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 7
    rows = planted(200, 3)
    model = op12_toxicity.fit([(t.encode(), y) for _, t, y in rows])
    got = op12_toxicity.score_sentences(docs, model).collect()
    assert all(r.score == 0.0 for r in got if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 for r in got)
    assert op12_toxicity.score_sentences(docs.limit(0), model).count() == 0


# Vector codes


def books_by_hand(rows, rounds=6):
    kept = sorted([(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * np.float64(x)) for x in v] for _, v in kept]
    if not ints:
        return []
    width = len(ints[0]) // 8
    part = lambda v, j: v[j * width : (j + 1) * width]
    books = [[part(v, j) for v in ints[:16]] for j in range(8)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))
    for _ in range(rounds):
        for j in range(8):
            of = {}
            for v in ints:
                of.setdefault(near(part(v, j), books[j]), []).append(part(v, j))
            books[j] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else books[j][e] for e in range(len(books[j]))]
    return books


def vectors(seed, n, width=16):
    r = random.Random(seed)
    spread = r.choice([0.001, 0.5, 3.0])
    rows = [(i, [round(r.gauss(0, spread), 3) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]
    rows += [(r.choice(rows)[0], r.choice(rows)[1], 1) for _ in range(n // 3)]  # repeated ids and vectors
    return [*rows, (None, rows[0][1], 3), (n + 1, None, 1), (n + 2, [None] * width, 1), (n + 3, [math.nan] * width, 1), (n + 4, [math.inf, *[0.0] * (width - 1)], 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_codebooks_equal_brute_force(spark, seed):
    rows = vectors(seed, 60)
    df = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, code string, error int")
    books = op13_vector_codes.fit_codebooks(df)
    assert [b.tolist() for b in books] == books_by_hand(rows)
    coded = op13_vector_codes.encode(df, books).collect()
    totals = Counter()
    for r in coded:
        totals[r.label] += r.error
    got = op13_vector_codes.op13_vector_codes(Tables(spark, embeddings=df), "").collect()
    by_hand = [(r.vec_id, r.code, r.error, totals[r.label]) for r in coded]
    assert len(got) == 81 and Counter(tuple(r)[:4] for r in got) == Counter(by_hand)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 16), st.integers(1, 4), st.randoms(use_true_random=False))
def test_tree_finds_the_lowest_of_the_nearest(k, width, r):
    entries = np.array([[r.randint(-2, 2) for _ in range(width)] for _ in range(k)], dtype=np.int64)
    x = np.array([[r.randint(-3, 3) for _ in range(width)] for _ in range(50)], dtype=np.int64)
    index, distance = op13_vector_codes.KdTree(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_few_large_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(2, [1.0] * 8, 1), (1, [-1.5] * 8, 1)], schema)
    assert [b.tolist() for b in op13_vector_codes.fit_codebooks(few)] == [[[-6144], [4096]]] * 8
    got = op13_vector_codes.op13_vector_codes(Tables(spark, embeddings=few), "").collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == [(1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)]
    assert op13_vector_codes.decode("00" * 8, op13_vector_codes.fit_codebooks(few)) == [-1.5] * 8
    assert op13_vector_codes.op13_vector_codes(Tables(spark, embeddings=few.limit(0)), "").count() == 0
    large = spark.createDataFrame([(i, [float(i % 5) * 2.0**20] * 8, 1) for i in range(40)], schema)
    assert all(r.error == 0 for r in op13_vector_codes.op13_vector_codes(Tables(spark, embeddings=large), "").collect())
    with pytest.raises(Exception, match="one length"):
        op13_vector_codes.op13_vector_codes(Tables(spark, embeddings=spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 9, 1)], schema)), "").collect()


def test_codes_equal_the_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df = op13_vector_codes.op13_vector_codes(spark, DATA)
    found = c.execute(op13_vector_codes.SQL["op13_vector_codes"])
    assert df.columns == [d[0] for d in found.description]
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
