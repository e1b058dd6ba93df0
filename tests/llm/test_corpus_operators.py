"""Operators on whole collections, held against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from tidelark.llm import op01_line_dedup, op07_mixing, op08_minmax_dedup, op09_topk, op10_spotsigs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, h string, digest string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None, "clash", "clash", "clash", "clash") for i, t, lang, source in rows], DOCS)


# Line dedup


def clean_by_hand(rows, max_ratio, min_count):
    pages, counts = Counter(), defaultdict(Counter)
    for _, t, _, s in rows:
        pages[s or ""] += 1
        counts[s or ""].update({x.strip(" \t\r") for x in (t or "").split("\n")} - {""})
    drop = {s: {x for x, c in counts[s].items() if c >= min_count and c / pages[s] > max_ratio} for s in pages}
    return sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in drop[s or ""])) for i, t, _, s in rows)


@pytest.mark.parametrize("broadcast_lines", [10_000, 0])
def test_line_dedup(spark, broadcast_lines):
    r = random.Random(1)
    rows = [(i, "\n".join(r.choice(["footer", " footer ", "nav\t", "", f"own {i}", f"line {r.randint(0, 30)}"]) for _ in range(r.randint(0, 8))), "en", r.choice(["a", "a", "b", None])) for i in range(150)]
    rows += [(200, None, None, "a"), (201, "", "en", "b"), (202, "footer", "en", "tiny"), (203, "x" * 50_000 + "\nfooter", "en", "a")]
    pages = frame(spark, rows).drop("host").selectExpr("*", "coalesce(source, '') AS host")
    got = op01_line_dedup.clean_lines(pages, 0.3, 3, broadcast_lines)
    assert sorted(((x.doc_id, x.text) for x in got.collect())) == clean_by_hand(rows, 0.3, 3)
    x = {x.doc_id: x for x in got.collect()}
    assert (x[200].n_lines, x[200].n_dropped, x[201].n_lines, x[202].text) == (0, 0, 1, "footer")


@pytest.mark.parametrize("broadcast_lines", [10_000, 0])
def test_line_dedup_of_pages_without_doc_id(spark, broadcast_lines):
    # A join by doc_id alone found no drops for them.
    rows = [(None if i % 3 == 0 else i // 2, f"footer\nown {i}", "en", "ab"[i % 2]) for i in range(60)] + [(None, "footer\nown 0", "en", "tiny")]
    pages = frame(spark, rows).drop("host").selectExpr("*", "coalesce(source, '') AS host")
    got = op01_line_dedup.clean_lines(pages, 0.3, 3, broadcast_lines).collect()
    assert sorted(x.text for x in got) == sorted([f"own {i}" for i in range(60)] + ["footer\nown 0"])


def test_small_hosts_lose_their_boilerplate_too(spark):
    rows = [(i, f"footer\nown {i}", "en", "small") for i in range(19)] + [(50, "footer\nown", "en", "two"), (51, "footer\nown", "en", "two")]
    pages = frame(spark, rows).drop("host").selectExpr("*", "source AS host")
    got = {x.doc_id: x.text for x in op01_line_dedup.clean_lines(pages).collect()}
    assert got == {i: f"own {i}" for i in range(19)} | {50: "footer\nown", 51: "footer\nown"}


def test_line_stage_keeps_other_columns(spark):
    docs = frame(spark, [(i, f"footer\nown {i}", "en", "a") for i in range(40)])
    out = op01_line_dedup.lines_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r.text, r.n_chars, r.host, r.digest) for r in out.collect()} == {(f"own {i}", len(f"own {i}"), "clash", "clash") for i in range(40)}


# Mixing


def split_by_hand(children, budget):
    """Water filling: (name, weight, capacity) to shares."""
    open_, out = dict((c[0], c) for c in children), {}
    while open_:
        weights = sum(c[1] for c in open_.values())
        full = [c for c in open_.values() if c[2] * weights <= budget * c[1]]
        if not full:
            return out | {n: budget * c[1] // weights for n, c in open_.items()}
        for n, _, cap in full:
            out[n] = cap
            budget -= cap
            del open_[n]
    return out


def test_split_budget(spark):
    r = random.Random(2)
    for _ in range(4):
        children = [(f"c{i}", r.randint(1, 5), r.randint(1, 100)) for i in range(8)]
        for budget in (0, 17, 150, 10_000):
            df = spark.createDataFrame([("p", *c, budget) for c in children], "parent string, name string, weight long, capacity long, budget long")
            got = {x.name: x.share for x in op07_mixing.split_budget(df, ["parent"], "name").collect()}
            assert got == split_by_hand(children, budget)


def test_weight_zero_gets_nothing(spark):
    df = spark.createDataFrame([("p", "a", 0, 50, 60), ("p", "b", 2, 100, 60), ("p", "c", 1, 5, 60), ("q", "d", 0, 9, 7)], "parent string, name string, weight long, capacity long, budget long")
    assert {x.name: x.share for x in op07_mixing.split_budget(df, ["parent"], "name").collect()} == {"a": 0, "b": 55, "c": 5, "d": 0}


def test_mix_meets_budgets_and_redistributes(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["web", "web", "news", None]), r.choice(["en", "de"]), f"src{r.randint(0, 4)}", r.randint(0, 50)) for i in range(600)]
    rows += [(1000 + i, "books", "en", "small", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, tokens long")
    total = sum(x[4] for x in rows)
    got = op07_mixing.mix(docs, percent=60, max_epochs=2).collect()
    taken = Counter((x.doc_id, x.epoch) for x in got)
    assert max(taken.values()) == 1 and all(e < 2 for _, e in taken)
    leaves = defaultdict(list)
    for x in rows:
        leaves[x[1] or "unknown", x[2], x[3]].append(x)
    chosen = Counter()
    for x in got:
        chosen[x.domain, x.lang, x.source] += x.tokens
    assert 0 <= sum(chosen.values()) - total * 60 // 100 + 3 * len(leaves) <= 53 * len(leaves)
    # The small domain can't use its share: it gives all it has, twice.
    assert chosen["books", "en", "small"] == 10
    # A part of an epoch is a prefix in the order of the seeded digest.
    import hashlib

    for leaf, members in leaves.items():
        last = max((x.epoch for x in got if (x.domain, x.lang, x.source) == leaf), default=None)
        if last is not None:
            order = sorted((x for x in members), key=lambda x: (hashlib.md5(f"mix:{last}:{x[0]}".encode()).hexdigest(), x[0]))
            ids = {x.doc_id for x in got if (x.domain, x.lang, x.source) == leaf and x.epoch == last}
            assert {x[0] for x in order[: len(ids)]} == ids
    again = op07_mixing.mix(docs.repartition(3), percent=60, max_epochs=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def mix_by_hand(rows, percent, max_epochs):
    """(doc_id, epoch) of rows (doc_id, domain, lang, source, tokens)."""
    import hashlib

    leaves = defaultdict(list)
    for x in rows:
        leaves[tuple(v or "unknown" for v in x[1:4])].append(x)
    tokens = {k: sum(x[4] for x in v) for k, v in leaves.items() if sum(x[4] for x in v)}
    capacity = lambda *prefix: sum(n * max_epochs for k, n in tokens.items() if k[: len(prefix)] == prefix)
    weight = lambda weights, name: weights.get((name,), 1)
    top = split_by_hand([(d, weight(op07_mixing.DOMAIN_WEIGHTS, d), capacity(d)) for d in sorted({k[0] for k in tokens})], sum(tokens.values()) * percent // 100)
    chosen = set()
    for d, share in top.items():
        langs = sorted({k[1] for k in tokens if k[0] == d})
        for g, part in split_by_hand([(g, weight(op07_mixing.LANGUAGE_WEIGHTS, g), capacity(d, g)) for g in langs], share).items():
            sources = sorted({k[2] for k in tokens if k[:2] == (d, g)})
            for s, budget in split_by_hand([(s, 1, capacity(d, g, s)) for s in sources], part).items():
                whole, rest = divmod(budget, tokens[d, g, s])
                members = leaves[d, g, s]
                chosen |= {(x[0], e) for x in members for e in range(whole)}
                before = 0
                for x in sorted(members, key=lambda x: (hashlib.md5(f"mix:{whole}:{x[0]}".encode()).hexdigest(), x[0])):
                    if before >= rest:
                        break
                    chosen.add((x[0], whole))
                    before += x[4]
    return chosen


def test_mix_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(i, r.choice(["web", "web", "news", "books", None]), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None]), r.randint(0, 40)) for i in range(400)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, domain string, lang string, source string, tokens long, share string")
    got = op07_mixing.mix(docs, percent=70, max_epochs=2).collect()
    assert Counter((x.doc_id, x.epoch) for x in got) == Counter(mix_by_hand(rows, 70, 2))


def test_stages_take_columns_with_clashing_names(spark):
    t = " ".join(f"w{i}" for i in range(40))
    names = ["_id", "_x", "_h", "_key", "component_id", "kept", "x"]
    docs = frame(spark, [(1, t, "en", "src1"), (2, t, "en", "src1"), (2, t, "en", "src1"), (3, "other", "de", "src2")])
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"'clash' AS {n}" for n in names))
    assert op07_mixing.mixing_stage(spark, docs, "").columns == docs.columns
    out = op08_minmax_dedup.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == [1, 3]


def test_mixing_stage_defined_cases(spark):
    docs = frame(spark, [(1, "some text here", "en", "src1"), (2, None, None, None), (None, "other text", "de", "src2"), (3, "", "en", "src1"), (3, "", "en", "src1")])
    assert op07_mixing.mixing_stage(spark, docs, "").columns == docs.columns
    assert op07_mixing.mixing_stage(spark, docs.limit(0), "").count() == 0


# Near-dedup


def words_of(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_by_hand(sets, percent):
    ids, label = sorted(sets), {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def near_copies(r, base, edits):
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randint(0, 9)}"
    return " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    r = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 90))) for _ in range(8)]
    texts = [near_copies(r, bases[min(7, r.randint(0, 20))], r.randint(0, 5)) for _ in range(170)]
    texts += ["", None, "  \n ", "one", "One", "one two", "ONE two", "é è ê", "a\tb\nc", "x " * 5000]
    got = {x.doc_id: x for x in op08_minmax_dedup.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), size, percent).collect()}
    sets = {i: shingles_of(t, size) for i, t in enumerate(texts)}
    expected = components_by_hand(sets, percent)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), expected[i], expected[i] == i)


def test_crowded_buckets_lose_no_link(spark):
    """Many texts around one base, of which few are linked: they share buckets, and leaders alone would miss links."""
    r = random.Random(8)
    base = " ".join(f"b{i}" for i in range(120))
    texts = [near_copies(r, base, r.randint(2, 9)) for _ in range(150)]
    texts = [" ".join(w if not w.startswith("edit") else f"{w}x{i % 75}" for w in t.split()) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in op08_minmax_dedup.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 85).collect()}
    assert got == components_by_hand({i: shingles_of(t, 3) for i, t in enumerate(texts)}, 85)


def test_texts_of_one_doc_id_are_texts_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near_b = b.replace("b7 ", "b8 ")
    rows = [(5, a), (5, b), (7, b), (8, near_b), (None, c), (None, c), (None, "c"), (9, c), (3, ""), (3, ""), (3, a + " z")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in op08_minmax_dedup.near_duplicates(docs).collect())
    assert got == Counter({(5, 56, 3, False): 1, (5, 56, 5, True): 1, (7, 56, 5, False): 1, (8, 56, 5, False): 1, (None, 56, 9, True): 2, (None, 1, None, True): 1, (9, 56, 9, True): 1, (3, 0, 3, True): 2, (3, 57, 3, True): 1})
    out = op08_minmax_dedup.dedup_stage(spark, docs, "").collect()
    assert Counter((x.doc_id, x.text) for x in out) == Counter([(5, b), (9, c), (3, ""), (3, a + " z"), (None, c), (None, c), (None, "c")])


def test_rows_at_the_prefix_join_grow_with_the_copies(spark, monkeypatch):
    """One component of n near copies and one foreign text in their buckets."""
    met = {}
    cut = op08_minmax_dedup.cut

    def counted(df, name):
        out = cut(df, name)
        if name in ("mixed-components", "prefixes"):
            met[name] = out
        return out

    monkeypatch.setattr(op08_minmax_dedup, "cut", counted)
    base = [f"b{i}" for i in range(80)]
    found = {}
    for n in (60, 120, 240):
        r = random.Random(n)
        sets = []
        for i in range(n):
            w = list(base)
            w[r.randrange(80)] = f"e{i}"
            sets.append((i, w))
        sets.append((n, base[:45] + [f"f{i}" for i in range(35)]))
        hashed = [(i, np.unique(np.array([hash(tuple(w[j : j + 3])) for j in range(len(w) - 2)], dtype=np.int64)).tobytes()) for i, w in sets]
        members = spark.createDataFrame([(i, len(h) // 8, 0 if i < n else 1) for i, h in hashed], "x long, n long, comp long")
        pairs = op08_minmax_dedup.prefix_pairs(members, spark.createDataFrame(hashed, "x long, hashes binary"), 40)
        assert all(x.u == n for x in pairs.collect())
        mixed, prefix = met["mixed-components"], met["prefixes"]
        found[n] = prefix.join(mixed.where("comp = 0").select("h", "comp"), ["h", "comp"]).count()
    assert 0 < found[240] <= 5 * found[60]


def test_min_max_agreement_estimates_jaccard():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    s = op08_minmax_dedup.MinMax(400).signatures([np.unique(a), np.unique(b)])
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.06


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    adjacent = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    expected = {}
    for n in sorted(adjacent):
        if n not in expected:
            queue = [n]
            while queue:
                v = queue.pop()
                if v not in expected:
                    expected[v] = n
                    queue += adjacent[v]
    got = {x.node: x.component for x in op08_minmax_dedup.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == expected


def test_dedup_stage_defined_cases(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(5, t, "en", "s"), (2, t, "en", "s"), (2, t, "en", "s"), (9, None, None, None), (None, t, "en", "s"), (11, "", "en", "s")])
    out = op08_minmax_dedup.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted((x.doc_id or -1) for x in out.collect()) == [-1, 2, 9, 11]
    assert op08_minmax_dedup.near_duplicates(docs.limit(0)).count() == 0


# Top-k search


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 64))
    vectors = np.concatenate([centres[r.integers(0, 5, 250)] + r.normal(size=(250, 64)) * 0.5, np.repeat(r.normal(size=(1, 64)), 60, axis=0)])
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(vectors)] + [(1000, None, 1), (1001, [1.0], 1), (1002, [None] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")
    bits = vectors.astype(np.float32) >= 0
    for k in (1, 7):
        got = defaultdict(list)
        for x in op09_topk.search(df, df.where("vec_id % 25 = 0"), k=k).orderBy("query_id", "rank").collect():
            got[x.query_id].append((x.distance, x.vec_id))
        assert got == {q: sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits))[:k] for q in range(0, len(bits), 25)}
    # Repeated rows count once, a second code of an id is a vector of its own.
    pair = df.where("vec_id IN (1, 2)").withColumn("vec_id", df.vec_id * 0 + 2)
    again = op09_topk.search(df.unionByName(df.where("vec_id < 9")).unionByName(pair), pair, k=4).collect()
    want = [(i, b) for i, b in enumerate(bits)] + [(2, bits[1])]
    assert sorted((x.distance, x.vec_id) for x in again) == sorted(y for q in (1, 2) for y in sorted((int((bits[q] != b).sum()), i) for i, b in want)[:4])
    few = df.where("vec_id < 3")
    assert op09_topk.search(few, few, k=7).count() == 9 and op09_topk.search(df.limit(0), df.limit(0)).count() == 0


def test_segments_cost_least():
    assert op09_topk.widths(64, 5) == [13, 13, 13, 13, 12]
    # Looking up more segments is worth while for far neighbours among few codes, fewer for close ones among many.
    counts = [op09_topk.segment_count(n, [d], 64) for n, d in ((1_000, 20), (50_000, 18), (10**7, 10), (10**9, 3))]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


# Fingerprints


def spots_by_hand(text):
    anchors, starts, content = set(op10_spotsigs.ANCHORS), {0}, []
    for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()) or [""]:
        if w in anchors:
            starts.add(len(content))
            continue
        content.append(w)
        if xxhash.xxh64_intdigest(w.encode(), seed=42) % 2**64 % 16 == 0:
            starts.add(len(content))
    out = set()
    for start in starts:
        h = 42
        for w in content[start : start + op10_spotsigs.CHAIN]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h & 0xFFFFFFFF)
    return out


def test_spot_signatures_and_neighbours(spark):
    r = random.Random(6)
    words = [*op10_spotsigs.ANCHORS[:12], *(f"word{i}" for i in range(60)), "Über", "naïve", "日本"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ",", ".\n"]) for _ in range(r.randint(1, 80))) for _ in range(60)]
    texts += ["", None, "the", "Caps LOCK", "x", " ".join(f"n{i}" for i in range(3000))]
    ids = sorted([*r.sample(range(-500, 5000), len(texts) - 8), -(2**63) + 1, -(2**62), 2**61, 2**61 + 1, 2**62, 2**63 - 300, 2**63 - 2, 2**63 - 1])
    rows = list(zip(ids, texts, strict=True))
    got = {x.doc_id: x for x in op10_spotsigs.compared(frame(spark, [(i, t, "en", "s") for i, t in rows][::-1])).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        a, b, c = spots_by_hand(t), spots_by_hand(e), spots_by_hand(n)
        assert got[i].n_chars == len(t)
        assert got[i].fingerprint == "".join(f"{x:08X}" for x in sorted(a)) and got[i].edited_fingerprint == "".join(f"{x:08X}" for x in sorted(b))
        assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 1e-12 and abs(got[i].near_next - len(a & c) / len(a | c)) < 1e-12


def test_spot_neighbours_of_null_and_repeated_ids(spark):
    docs = frame(spark, [(None, "b", "en", "s"), (None, "a", "en", "s"), (4, "d", "en", "s"), (4, "c", "en", "s"), (900, None, "en", "s")])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.next_text) for r in op10_spotsigs.with_next(docs).collect())
    assert got == [(-1, "a", "b"), (-1, "b", "c"), (4, "c", "d"), (4, "d", ""), (900, "", "a")]
    assert op10_spotsigs.compared(docs.limit(0)).count() == 0 and op10_spotsigs.linked(docs.limit(0)).count() == 0


def test_spot_pairs_equal_brute_force(spark):
    r = random.Random(7)
    base = " ".join(r.choice(["the", "of", f"w{r.randint(0, 200)}"]) for _ in range(120))
    texts = [near_copies(r, base, r.randint(0, 12)) for _ in range(60)] + [base, base, "", ""]
    pairs, members = op10_spotsigs.similar_pairs(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 0.7)
    sets = {i: frozenset(spots_by_hand(t)) for i, t in enumerate(texts)}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {x.doc_id: x.class_id for x in members.collect()} == {i: first[s] for i, s in sets.items()}
    reps = [(i, s) for s, i in first.items()]
    wanted = {(a, b) for k, (a, s) in enumerate(reps) for b, u in reps[k + 1 :] if len(s & u) >= 0.7 * len(s | u)}
    assert {(x.u, x.v) for x in pairs.collect()} == wanted
    links = Counter(x for p in wanted for x in p)
    rows = op10_spotsigs.linked(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), 0.7).collect()
    assert {x.doc_id: (x.class_id, x.n_links) for x in rows} == {i: (first[s], links[first[s]]) for i, s in sets.items()}


# The pipeline


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline
    from tidelark.llm import op02_pieces, op03_language

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    classifier = op03_language.Classifier(op03_language.fit(docs))
    predicted = {i: classifier.predict(t) for i, t, _, _ in rows}
    rows = [(i, t, predicted[i][0], s) for i, t, _, s in rows if predicted[i][2] >= op03_language.MIN_MARGIN]
    cleaned = dict(clean_by_hand(rows, op01_line_dedup.MAX_RATIO, op01_line_dedup.MIN_COUNT))
    kept = components_by_hand({i: shingles_of(cleaned[i], 5) for i in cleaned}, 80)
    source = {i: x for i, _, _, x in rows}
    lang = {i: x for i, _, x, _ in rows}
    domain = lambda x: (lambda n: ["web", "news", "books"][int(n[0][-9:]) % 3] if n else "unknown")(regex.findall("[0-9]+$", x or ""))
    survivors = [(i, domain(source[i]), lang[i], source[i], -(-len(cleaned[i].encode()) // 4)) for i in cleaned if kept[i] == i]
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in mix_by_hand(survivors, 80, 1))
    encoder = op02_pieces.PrefixTableEncoder(op02_pieces.model_path())
    assert all(r.ids == [*encoder.library.encode(cleaned[r.doc_id]), 2] for r in out)
