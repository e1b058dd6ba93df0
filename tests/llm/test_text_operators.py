"""Operators on single texts, held against the libraries or plain definitions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelark.llm import op02_pieces, op03_language, op04_packed, op05_pii, op06_token_counts
from tidelark.llm.chunks import byte_bpe, word_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, ids string"
ODD = ["", " ", "  a  b ", "\n\n", "a\nb\n", "x" * 20_000, "tab\tand\r\nfeed", "é́ 日本 👍🏽", "▁▁ a", "<|endoftext|> a", "I'll go 's 12,5", "a b　c", None]


def rows_of(texts):
    return [(i, t, "en", "src0", 1, "clash", "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["the", "Zürich", "naïve", "über", "data-set", "3.14", "foo_bar", "日本語", "ha.", "x"]
    return ODD + ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", ", "]) for _ in range(r.randint(1, 60))) for _ in range(150)]


def test_pieces_equal_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=op02_pieces.model_path())
    got = op02_pieces.encode_documents(spark.createDataFrame(rows_of([*texts, texts[-1]]), DOCS), op02_pieces.model_path(), keep_ids=True, keep_text=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = [*texts, texts[-1]][r.doc_id] or ""
        ids = [*library.encode(text), 2]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


_PIECES = op02_pieces.PrefixTableEncoder(op02_pieces.model_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdehilnorst é▁\n\t日0.,'")), max_size=40))
def test_prefix_table_equals_merging(text):
    assert _PIECES.encode_whole(text).tolist() == _PIECES.library.encode(text)
    assert _PIECES.splitter().encode_all(pa.array([text]))[0].tolist() == _PIECES.library.encode(text)


_WORDS = word_bpe(public_tokenizers.path("word_bpe_49k.json"))
_LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a", *"JTHaeiK\u030c\u0308\u0331\u030a .,\n3'É"]), max_size=30))
def test_marks_after_capitals_equal_the_library(parts):
    text = "".join(parts)
    assert _WORDS.encode_all(pa.array([text]))[0].tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "make"), [("word_bpe_49k.json", word_bpe), ("byte_bpe_50k.json", byte_bpe)])
def test_split_encoders_equal_the_library(name, make, texts):
    path = public_tokenizers.path(name)
    known = [t or "" for t in texts]
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(known, add_special_tokens=False)]
    assert [x.tolist() for x in make(path).encode_all(pa.array(known))] == expected


@given(st.integers(1, 32), st.integers(0, 200), st.integers(0, 200), st.integers(0, 2**32))
@settings(max_examples=100, deadline=None)
def test_packing_round_trip(width, a, b, seed):
    ids = np.random.default_rng(seed).integers(0, 2**width, 200).astype("<u4")
    payload = op04_packed.pack(ids, width)
    assert len(payload) == -(-200 * width // 8)
    a, b = min(a, b), max(a, b)
    assert (op04_packed.unpack(payload, width, a, b) == ids[a:b]).all()


def test_packed_files_hold_all_ids_in_order(spark, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(3 * i - 7, *r[1:]) for i, r in enumerate(rows_of(texts))][::-1], DOCS)
    op04_packed.write_packed(docs, str(tmp_path / "ids"), path, end_id=2, shards=3, block_ids=100)
    got = {r.doc_id: r for r in op04_packed.read_packed(spark, str(tmp_path / "ids"), keep_ids=True).collect()}
    library, start, flat = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[3 * i - 7]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start, flat = start + len(ids), flat + ids
    assert op04_packed.ids_between(spark, str(tmp_path / "ids"), 90, 455).tolist() == flat[90:455]
    assert op04_packed.width_of(49408) == 16 and op04_packed.width_of(1) == 1


def test_token_counts_use_the_cache(spark, texts, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    half = spark.createDataFrame(rows_of(texts)[::2], DOCS)
    whole = spark.createDataFrame(rows_of([*texts, *texts[:20]]), DOCS)
    for docs in (half, whole):
        for r in op06_token_counts.count_tokens(docs, cache, path, limit=20).collect():
            t = texts[r.doc_id % len(texts)] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 20)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts}) == stored.select("digest").distinct().count()
    before = stored.agg({"n_tokens": "sum"}).first()[0]
    spark.createDataFrame([("other", b"x", 5)], op06_token_counts.CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    op06_token_counts.count_tokens(whole, cache, path).count()
    assert spark.read.parquet(cache).where("tokenizer <> 'other'").agg({"n_tokens": "sum"}).first()[0] == before


def test_entries_appended_twice_count_once(spark, texts, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame(rows_of(texts[:30]), DOCS)
    once = sorted(map(tuple, op06_token_counts.count_tokens(docs, cache, path).collect()))
    entries = spark.createDataFrame(spark.read.parquet(cache).collect(), "digest binary, n_tokens long, tokenizer string")
    entries.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(map(tuple, op06_token_counts.count_tokens(docs, cache, path).collect())) == once


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("019 -.")), min_size=10, max_size=60))
def test_cards_and_addresses_equal_the_patterns(text):
    got = op05_pii.base_spans(text)

    def valid(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return 13 <= len(d) <= 19 and sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10

    assert [s[1:] for s in got if s[0] == "card"] == [m.span() for m in _CARD.finditer(text) if valid(m[0])]
    assert [s[1:] for s in got if s[0] == "ip"] == [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]


def test_long_runs_and_many_spans():
    assert op05_pii.base_spans("0" * 5000 + "1.1.1.1 and " + "7" * 50_000) == [("ip", 0, 5007)]
    text = "\n".join(f"write to user{i}@mail.example.org or call (555) 123-{i % 10_000:04d}" for i in range(5_000))
    base = op05_pii.base_spans(text)
    assert len(base) == 5_000 and len(op05_pii.trained().added_spans(text, base)) == 5_000


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@.+-% 019()é")), max_size=30))
def test_base_spans_equal_the_patterns(text):
    got = op05_pii.base_spans(text)
    assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in _EMAIL.finditer(text)]
    assert [s[1:] for s in got if s[0] == "ip"] == [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [s[1:] for s in got if s[0] == "phone"] == [m.span() for m in op05_pii.PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def segmentations(found, n, i=0):
    """Every choice of candidates that don't overlap, from token i on."""
    if i >= n:
        yield []
        return
    yield from segmentations(found, n, i + 1)
    for c in found:
        if c[0] == i:
            for rest in segmentations(found, n, c[1]):
                yield [c, *rest]


def score_of(model, chosen):
    pairs = sum(model.pair(a[2], b[2]) for a, b in zip(chosen, chosen[1:], strict=False) if b[0] - a[1] <= op05_pii.NEAR_TOKENS)
    return sum(model.score(c[5]) for c in chosen) + pairs


def test_semi_markov_decoding_and_likelihood_equal_every_segmentation():
    r = random.Random(5)
    model = op05_pii.SemiMarkov(dict(op05_pii.trained().weights))
    for a in op05_pii.KINDS:
        for b in op05_pii.KINDS:
            model.weights[f"pair:{a}>{b}"] = r.uniform(-2, 2)
    tried = 0
    for text, _ in op05_pii.examples(60, seed=11):
        tokens = [m.span() for m in re.finditer(r"\S+", text)][:13]
        found = model.candidates(text, tokens, [])
        if not 0 < len(found) <= 12:
            continue
        tried += 1
        every = [(score_of(model, c), c) for c in segmentations(found, len(tokens))]
        best = model.best(len(tokens), found)
        chosen = [next(c for c in found if c[2:5] == b) for b in best]
        assert abs(score_of(model, chosen) - max(s for s, _ in every)) < 1e-9
        z, each, pairs = model.expected(len(tokens), found)
        total = sum(math.exp(s) for s, _ in every)
        assert abs(z - math.log(total)) < 1e-6
        for i, c in enumerate(found):
            assert abs(each[i] - sum(math.exp(s) for s, x in every if c in x) / total) < 1e-6
        for (i, j), p in pairs.items():
            near = sum(math.exp(s) for s, x in every if any(a is found[i] and b is found[j] for a, b in zip(x, x[1:], strict=False)))
            assert abs(p - near / total) < 1e-6
    assert tried > 10


def test_stretches_give_the_result_of_the_whole_text():
    model = op05_pii.trained()
    for text, _ in op05_pii.examples(60, seed=12):
        text = " ".join(["word"] * 30) + " " + text + " " + " ".join(["more"] * 30)
        base = op05_pii.base_spans(text)
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        assert model.added_spans(text, base) == sorted(model.best(len(tokens), model.candidates(text, tokens, [s[1:] for s in base])))


def other_writer(seed):
    """Sentences of another form than those the model learns from: words of the four languages, one entity in each, numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    names = "anna.meier jdoe marie_curie luis99 k.o.brien peter sofia".split()
    hosts = ["mail", "example", "uni-koeln", "correo", "posteo"]
    tops = ["com", "de", "fr", "es", "org"]
    before = {"en": "Please call me under", "de": "Sie erreichen uns unter", "fr": "Vous pouvez appeler le", "es": "Puede llamar al", "x": "on the list stands"}
    after = ["until Friday.", "heute noch, bitte.", "avant midi", "por la tarde", "and so on"]
    for kind in op05_pii.KINDS * 60:
        if kind == "phone":
            entity = r.choice([f"0171 {d(7)}", f"030 / {d(3)} {d(2)} {d(2)} {d(2)}", f"(212) {d(3)}-{d(4)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"612 {d(3)} {d(3)}", f"0221-{d(8)}"])
        elif kind == "email":
            name, host, top = r.choice(names), r.choice(hosts), r.choice(tops)
            entity = r.choice([f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}.{top}", f"{name} @ {host}.{top}", f"{name.replace('.', ' dot ').replace('_', ' dot ')} at {host} dot {top}"])
        elif kind == "card":
            digits = r.choice("45") + d(14)
            digits += next(x for x in "0123456789" if op05_pii.luhn(digits + x))
            entity = r.choice([" . ", ".", " ."]).join(digits[i : i + 4] for i in range(0, 16, 4))
        else:
            entity = " . ".join(str(r.randint(1, 254)) for _ in range(4))
        noise = r.choice(["", "", f"am {d(2)}.{d(2)}.{d(4)}", f"version {d(1)}.{d(2)}.{d(1)}", f"order {d(6)}", f"{d(2)}:{d(2)} Uhr", f"{d(3)},{d(2)} EUR", f"at the dot of {d(1)}"])
        text = f"{noise} {r.choice(list(before.values()))} ".lstrip()
        yield kind, f"{text}{entity} {r.choice(after)}", (kind, len(text), len(text) + len(entity))


def test_each_kind_on_sentences_of_another_writer(spark):
    model = op05_pii.trained()
    right, found, wanted = ({k: 0 for k in op05_pii.KINDS} for _ in range(3))
    for kind, text, gold in other_writer(3):
        base = op05_pii.base_spans(text)
        spans = set(base) | set(model.added_spans(text, base))
        wanted[kind] += 1
        right[kind] += gold in spans
        for s in spans:
            found[s[0]] += 1
    figures = {k: (round(right[k] / found[k], 2), round(right[k] / wanted[k], 2)) for k in op05_pii.KINDS}
    print(figures)
    assert all(p >= 0.9 and x >= 0.9 for p, x in figures.values()), figures


def test_semi_markov_model_on_unseen_sentences(spark):
    model = op05_pii.trained()
    right, wrong, missed = ({k: 0 for k in op05_pii.KINDS} for _ in range(3))
    for text, gold in op05_pii.examples(300, seed=99):
        base = op05_pii.base_spans(text)
        added, wanted = set(model.added_spans(text, base)), {g for g in gold if g not in base}
        for s in added | wanted:
            (right if s in added & wanted else wrong if s in added else missed)[s[0]] += 1
    assert all(right[k] >= 0.85 * (right[k] + wrong[k]) and right[k] >= 0.85 * (right[k] + missed[k]) for k in op05_pii.KINDS), (right, wrong, missed)
    docs = spark.createDataFrame(rows_of(["mail a.b@c.org and +1 (555) 123-4567, 10.0.0.1 or 999.1.1.1", None, "", "call (555) 123-4567 now", "plain"]), DOCS)
    got = {r.doc_id: r for r in op05_pii.find_personal_data(docs).collect()}
    assert (got[0].n_email, got[0].n_phone, got[0].n_ip, got[0].n_card) == (1, 1, 1, 0)
    assert got[1].spans == got[2].spans == got[4].spans == "" and got[3].spans == "phone:5:19"
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in op03_language.identify(docs, op03_language.fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) < 0.02 * len(got)


def test_language_defined_cases(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 9, "en", "s", 1, "", ""), (2, "el gato y el perro " * 9, "es", "s", 1, "", ""), (3, None, "en", None, None, None, None), (4, "12 34 !!", None, "s", 1, "", ""), (None, "el perro", None, None, None, None, None)], DOCS)
    got = op03_language.identify(docs, op03_language.fit(docs)).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert (by[3].lang_pred, by[3].score, by[4].lang_pred) == ("und", 0.0, "und") and by[1].lang_pred == "en"
    stage = op03_language.language_stage(spark, docs, "")
    assert stage.columns == docs.columns and {r.doc_id for r in stage.collect()} <= {1, 2, None}
    nothing = op03_language.identify(docs, {}).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert op03_language.Classifier({"en": b"abc"}).predict("½ ² ³ 1") == ("und", 0.0, 0.0)
    same = op03_language.Classifier({"b": b"the cat and the dog", "a": b"the cat and the dog"}).predict("the cat")
    assert same[0] == "b" and same[2] == 0.0
    with pytest.raises(ValueError, match="languages"):
        op03_language.fit(docs, max_languages=0)


def test_language_equals_brute_force(spark):
    """Each text is compressed with compressors of its own, by the definition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = op03_language.fit(docs.unionByName(docs.limit(5)))
    classifier = op03_language.Classifier(dictionaries)
    for t in [r.text for r in docs.collect()][:60] + ["la", "the", "x" * 3000, "der und 12"]:
        data = op03_language.plain(t)
        sizes = {k: len(op03_language.narrow(v).compress(data)) for k, v in dictionaries.items()}
        if list(sizes.values()).count(min(sizes.values())) > 1:
            sizes = {k: len(op03_language.wide(v).compress(data.decode().encode("utf-32-le"))) for k, v in dictionaries.items()}
        assert classifier.predict(t)[0] == min(sizes, key=sizes.get)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert op02_pieces.encode_documents(empty, op02_pieces.model_path()).count() == 0
    assert op03_language.identify(empty, op03_language.fit(empty)).count() == 0
    op04_packed.write_packed(empty, str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert op04_packed.read_packed(spark, str(tmp_path / "none")).count() == 0
    assert op05_pii.find_personal_data(empty).count() == 0
    assert op06_token_counts.count_tokens(empty, str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
