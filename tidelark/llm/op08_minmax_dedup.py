"""MinHash near-dedup by min-max hashing.

Every document becomes the set of its distinct word shingles (64-bit hashes).  Under each permutation both the minimum and
the maximum are kept, so a signature of 2p values costs p hash evaluations, and the share of agreeing values is an unbiased
estimate of the Jaccard similarity with a lower variance than 2p separate minima have.  The signature is cut into bands; the
number of bands follows from the miss probability asked for at the threshold.

Work per step, for n documents:

* equal sets are collapsed first (a group of copies is one class from here on);
* a band bucket is never expanded into all its pairs.  Members are held against the bucket's leader, links are confirmed on
  the full sets, and components are taken; only buckets that still hold several components go on.  After ``star_rounds``
  leaders, members of such crowded buckets are paired by prefix filtering, which is exact: two linked sets share one of
  their rarest shingles.  Pairs that already share a component can't change the result, so no link between different
  components is lost;
* components come from alternating large-star and small-star steps, each written to the shared folder.

Classes are known by their sets' digests, not by doc_id: rows that share a doc_id but differ in text are texts of their own, each
with its own links, and the component of each is the smallest doc_id that its text reaches.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and keep themselves; a text with fewer
words than a shingle has one shingle, the whole sequence; repeated rows of a doc_id are equal sets and share its component;
rows with a null doc_id link like others, but can't stand for others and are kept; the stage keeps one row for each doc_id and
set that is kept, and all rows with a null doc_id;
other columns of the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.shared import BROADCAST_IDS, cut, documents, forget, small_batches, tidy, unused

#: Text bytes hashed at a time; a longer word makes a longer piece.
PIECE_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class WordHasher:
    """64-bit hashes of the words of byte strings, with A-Z lower-cased, by a rolling polynomial over whole arrays."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = int(_ODD)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            k = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(self.base, k, 1 << 64))])
            self.inverses = np.concatenate([self.inverses, self.inverses * np.uint64(pow(self.inverse, k, 1 << 64))])

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start offset, hash) of each word in data."""
        blank = self.space[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        out, k = np.empty(len(starts), dtype=np.uint64), 0
        while k < len(starts):
            a = starts[k]
            last = max(int(np.searchsorted(ends, a + PIECE_BYTES, "right")), k + 1)
            piece = data[a : ends[last - 1]]
            self._grow(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(self.table[piece] * self.powers[: len(piece)], out=sums[1:])
            s, e = starts[k:last] - a, ends[k:last] - a
            out[k:last] = _mix((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64) * _ODD)
            k = last
        return starts, out


def shingle_sets(texts: pa.Array, size: int, hasher: WordHasher) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8) if len(texts) else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for i in range(len(texts)):
        if not valid[i]:
            out.append(np.zeros(0, np.uint64))
            continue
        _, words = hasher.words(data[offsets[i] : offsets[i + 1]])
        n = len(words)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(size, n)
        h = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for j in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : n - width + 1 + j]
            h ^= h >> np.uint64(27)
        out.append(np.unique(_mix(h)))
    return out


class MinMax:
    """Signatures of the minima and maxima of sets under `permutations` hash functions."""

    def __init__(self, permutations: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, permutations, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of 2p values for each set, which must not be empty."""
        sizes = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x, out = np.concatenate(sets), np.empty((len(sets), 2 * len(self.a)), dtype=np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            h = ((x * a + b) >> np.uint64(32)).astype(np.uint32)
            out[:, 2 * i] = np.minimum.reduceat(h, at)
            out[:, 2 * i + 1] = np.maximum.reduceat(h, at)
        return out


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands with which a pair at the threshold shares no bucket with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _sketch(shingle: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, minmax = WordHasher(), MinMax(math.ceil(rows * bands / 2))
        mult = np.random.default_rng(3).integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sets = shingle_sets(batch.column(2), shingle, hasher)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            digests: list = [None] * len(sets)
            if full:
                values = minmax.signatures([sets[i] for i in full])[:, : rows * bands].astype(np.uint64)
                banded = _mix((values.reshape(len(full), bands, rows) * mult).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                for i, k in zip(full, banded, strict=True):
                    keys[i] = k
                    s = sets[i]
                    digests[i] = (int(_mix(s).sum(dtype=np.uint64)).to_bytes(8, "little") + int(_mix(s * _ODD).sum(dtype=np.uint64)).to_bytes(8, "little") + len(s).to_bytes(4, "little"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "digest", "keys"])

    return run


def _sets_of(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle, hasher)
            yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["x", "hashes"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected edges (u, v), the component being its smallest node.

    Alternating large-star and small-star steps until the edges are stars; both keep the number of edges.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small, before = large.join(low, "u"), edges
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        forget(before, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, h) of every hash in the sets of a batch (x, hashes)."""
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
        if sets:
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets))], names=["x", "h"])


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of members (x, n, comp) of different components that may be linked, by prefix filtering.

    A linked pair shares at least percent * n of the n shingles of either side, so it shares one of the n - that + 1 rarest
    of each, in any order that all sets agree on.  The rarest first: shingles that only one member has need no row at all.
    """
    members = cut(members, "open-sets")
    tokens = sets.join(members.select("x"), "x", "left_semi").select("x", "hashes").mapInArrow(tidy(_tokens), "x long, h long")
    tokens = cut(tokens, "tokens")
    shared = cut(tokens.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared-tokens")
    placed = tokens.join(shared, "h").withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("c", "h"))).withColumn("k", F.count("*").over(Window.partitionBy("x")))
    prefix = placed.join(members, "x").where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("k")))
    prefix = cut(prefix.select("h", "x", "n", "comp", (F.col("k") - F.col("i") + 1).alias("rest")), "prefixes")
    # Components of a shingle are paired first, then their members: those of one component never meet.
    sizes = cut(prefix.groupBy("h", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most")), "shingle-components")
    mixed = sizes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    sizes = cut(sizes.join(mixed, "h", "left_semi"), "mixed-components")
    met = sizes.join(sizes.select("h", F.col("comp").alias("yc"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), F.col("most").alias("ymost")), "h")
    fits = (F.col("hi") * 100 >= F.col("ylo") * percent) & (F.col("yhi") * 100 >= F.col("lo") * percent)
    # The bound on what is left, as below, for the best that two components have.
    may = F.least("most", "ymost") * (100 + percent) >= (F.col("lo") + F.col("ylo")) * percent
    met = met.where((F.col("comp") > F.col("yc")) & fits & may).select("h", "comp", "yc")
    other = prefix.select("h", F.col("x").alias("y"), F.col("n").alias("yn"), F.col("comp").alias("yc"), F.col("rest").alias("yrest"))
    close = F.least("n", "yn") * 100 >= F.greatest("n", "yn") * percent
    # From the first shared shingle on, what is left of both must suffice for the overlap that the similarity takes.
    enough = F.least("rest", "yrest") * (100 + percent) >= (F.col("n") + F.col("yn")) * percent
    pairs = prefix.join(met, ["h", "comp"]).join(other, ["h", "yc"]).where(close & enough)
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """x, text of the classes (x, doc_id, h) that rows (doc_id, h, text) stand for; a row that is repeated comes once."""
    name = [unused("_id", texts), unused("_h", texts)]
    ids = wanted.select("x", F.col("doc_id").alias(name[0]), F.col("h").alias(name[1]))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS // 3 else ids
    same = F.col("doc_id").eqNullSafe(F.col(name[0])) & (F.col("h") == F.col(name[1]))
    again = cut(texts.join(ids, same).groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x"), "repeated")
    found = texts.join(ids, same).select("x", "text")
    if again.isEmpty():
        return found
    return found.join(again, "x", "left_anti").unionByName(found.join(again, "x", "left_semi").dropDuplicates(["x"]))


def labelled(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-6, star_rounds: int = 1) -> DataFrame:
    """doc_id, h, n_shingles, digest, component_id, kept of documents (doc_id, text); h is a hash of the text, and digest that of its
    set (empty for no set)."""
    spark = docs.sparkSession
    small_batches(spark)
    bands = bands_for(percent / 100, rows, miss)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    base = cut(texts.mapInArrow(tidy(_sketch(shingle, rows, bands)), "doc_id long, h long, n_shingles long, digest binary, keys array<long>"), "sketch")

    # Equal sets form a class with a number of its own, which its row of the smallest doc_id stands for.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    classes = base.where("digest is not null").groupBy("digest").agg(F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"), first)
    classes = cut(classes.select(F.monotonically_increasing_id().alias("x"), "digest", "n", "keys", "first.doc_id", "first.h"), "classes")
    members = cut(classes.select("x", "n", "doc_id", F.posexplode("keys").alias("band", "bucket")), "members")
    counts = cut(members.groupBy("band", "bucket").agg(F.count("*").alias("c")).where("c > 1").select("band", "bucket"), "buckets")
    members = cut(members.join(counts, ["band", "bucket"]), "shared-buckets")

    # Sets are needed for classes that share a bucket only.
    wanted = cut(classes.join(members.select("x").distinct(), "x", "left_semi").select("x", "doc_id", "h"), "wanted")
    sets = cut(_texts_of(texts, wanted).mapInArrow(tidy(_sets_of(shingle)), "x long, hashes binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("x").alias("u"), F.col("hashes").alias("hu"))
        right = sets.select(F.col("x").alias("v"), F.col("hashes").alias("hv"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "hu", "hv").mapInArrow(tidy(_confirm(percent)), "u long, v long")

    def sizes_fit(a: str, b: str):
        return F.least(a, b) * 100 >= F.greatest(a, b) * percent

    edges, done, open_members = [], [], members
    labels = None
    for turn in range(star_rounds + 1):
        if turn < star_rounds:
            order = F.struct(F.col("doc_id").isNull(), "doc_id", "x") if turn == 0 else F.xxhash64(F.lit(turn), "x")
            leads = cut(open_members.groupBy("band", "bucket").agg(F.min_by(F.struct("x", "n"), order).alias("lead")).select("band", "bucket", F.col("lead.x").alias("lx"), F.col("lead.n").alias("ln")), "leads")
            pairs = open_members.join(leads, ["band", "bucket"]).where((F.col("x") != F.col("lx")) & sizes_fit("n", "ln"))
            if turn:
                pairs = pairs.join(labels.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").join(labels.select(F.col("node").alias("lx"), F.col("component").alias("cl")), "lx", "left").where("coalesce(cx, x) <> coalesce(cl, lx)")
            pairs = pairs.select(F.greatest("x", "lx").alias("u"), F.least("x", "lx").alias("v")).distinct()
        else:
            pairs = prefix_pairs(open_members.select("x", "n").distinct().join(labels.select(F.col("node").alias("x"), "component"), "x", "left").select("x", "n", F.coalesce("component", "x").alias("comp")), sets, percent)
        if done:
            pairs = pairs.join(reduce(DataFrame.unionByName, done), ["u", "v"], "left_anti")
        pairs = cut(pairs, "pairs")
        done.append(pairs)
        edges.append(cut(confirmed(pairs), "links"))
        labels = components(reduce(DataFrame.unionByName, edges))
        if turn == star_rounds:
            break
        named = members.join(labels.withColumnRenamed("node", "x"), "x", "left").select("band", "bucket", "x", "n", F.coalesce("component", "x").alias("comp"))
        mixed = named.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "bucket")
        open_members = cut(members.join(cut(mixed, "mixed"), ["band", "bucket"]), "open")
        if open_members.isEmpty():
            break

    named = classes.join(labels.select(F.col("node").alias("x"), "component"), "x", "left").select("digest", "doc_id", F.coalesce("component", "x").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = cut(named.join(smallest, "component").select("digest", "component_id"), "class-components")
    forget(classes, members, sets, *done, *edges)
    nothing = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
    out = base.select("doc_id", "h", "n_shingles", F.coalesce("digest", nothing).alias("_key"), F.coalesce("digest", F.lit(b"")).alias("digest"))
    out = out.join(by_class.withColumnRenamed("digest", "_key"), "_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "h", "n_shingles", "digest", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents (doc_id, text); linked at `percent` Jaccard similarity of word shingles."""
    return labelled(docs, shingle, percent, **settings).select("doc_id", "n_shingles", "component_id", "kept")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest doc_id stays; a doc_id with several texts keeps
    each of those that no smaller doc_id stands for."""
    kept = labelled(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.min("h").alias("h"))
    x, doc_id, h = (unused(n, docs) for n in ("_x", "_id", "_h"))
    kept = cut(kept.select(F.monotonically_increasing_id().alias(x), F.col("doc_id").alias(doc_id), F.col("h").alias(h)), "kept")
    ids = F.broadcast(kept) if kept.count() <= BROADCAST_IDS // 3 else kept
    found = docs.join(ids, (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(h)))
    again = cut(found.groupBy(x).agg(F.count("*").alias("c")).where("c > 1").select(x), "repeated")
    if not again.isEmpty():
        found = found.join(again, x, "left_anti").unionByName(found.join(again, x, "left_semi").dropDuplicates([x]))
    return found.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


QUERIES = {"op8_minmax_dedup": op8_minmax_dedup}
SQL = {
    "op8_minmax_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT n.doc_id, n.n_shingles, min(r.v) AS component_id, n.doc_id = min(r.v) AS kept FROM n JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
}
