"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence has a logit: a bias and the weights of its features, which are its distinct words and their beginnings (hashed into
`BUCKETS`); its score is the logit's sigmoid.  A document is toxic unless every sentence is harmless: its score is the noisy-or
of those of its sentences.  The weights are fitted to the labels of documents through that noisy-or, so it is learned which
sentences make a document toxic although none is labelled: each round takes the features that part the gradients of toxic
documents' sentences from those of the others best, and adds to their weights, and to the bias, half the log of the ratio.  Few
features have a weight at the end, and the bias falls until long harmless documents are harmless.

Fitting reads a bounded sample of the labelled rows that aren't held out: of each label the `fit_docs` documents with the
smallest hashed id, among those of at most `fit_bytes` bytes, twice as many of those that aren't toxic.  Scoring reads every
text whole; what a task holds at a time is a few MB or one text's worth.

Defined cases: a null, empty or blank text has no sentence and scores 0; several label rows of a document count as toxic if any
is, null labels as none; rows with a null doc_id can't be labelled and count as not held out; without labels of both kinds every
score is 0; repeated rows give repeated results, other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.op08_minmax_dedup import PIECE_BYTES, WordHasher, _mix
from tidelark.llm.shared import documents, small_batches, tidy

BUCKETS, PREFIX_BYTES = 1 << 20, (3, 4, 5, 6)
FIT_DOCS, FIT_BYTES, ROUNDS, A_ROUND, SHRINK, SMOOTH, LEAST_DOCS = 1000, 20_000, 100, 3, 0.5, 1e-3, 2
THRESHOLD = 0.5
GROUP_BYTES = 1 << 20


class SentenceHasher(WordHasher):
    """Features of the words of texts, a word being letters and digits; sentences end at a line feed, '.', '!' or '?'."""

    def __init__(self):
        super().__init__(seed=12)
        self.space = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
        self.stops = np.zeros(256, dtype=bool)
        self.stops[list(b"\n.!?")] = True

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets: a row for each word, its sentence, the document of each sentence, first and last byte of each sentence).

        Bytes are counted within all texts joined by line feeds.
        """
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space[data], [True]]).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        stops = np.cumsum(self.stops[data])[starts] if len(starts) else np.zeros(0, np.int64)
        new = np.concatenate([[True], stops[1:] != stops[:-1]])[: len(starts)]
        sentence = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        first, last = starts[heads], ends[np.append(heads[1:], len(starts))[: len(heads)] - 1] if len(heads) else np.zeros(0, np.int64)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
        return self._buckets(data, starts, ends), sentence, owner, first, last

    def _buckets(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, k = np.empty((len(starts), len(PREFIX_BYTES) + 1), dtype=np.int32), 0
        while k < len(starts):
            a = starts[k]
            to = max(int(np.searchsorted(ends, a + PIECE_BYTES, "right")), k + 1)
            piece = data[a : ends[to - 1]]
            self._grow(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(self.table[piece] * self.powers[: len(piece)], out=sums[1:])
            s, e = starts[k:to] - a, ends[k:to] - a
            for i, n in enumerate((*PREFIX_BYTES, None)):
                stop = e if n is None else np.minimum(s + n, e)
                # A beginning and a whole word of the same bytes are two features.
                h = _mix((sums[stop] - sums[s]) * self.inverses[s] + np.uint64(n or 99))
                out[k:to, i] = h & np.uint64(BUCKETS - 1)
            k = to
        return out


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> list[tuple[bytes, int]]:
    """(text, label) of the rows to learn from; at most 3 * fit_docs."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return []
    # A bound on the hash that four times the rows wanted are below: few rows meet the documents, however many are labelled.
    wanted = F.when(F.col("y") == 1, fit_docs).otherwise(2 * fit_docs)
    bound = F.when(F.col("y") == 1, min(2**62, 4 * fit_docs * 2**62 // counts[1])).otherwise(min(2**62, 8 * fit_docs * 2**62 // counts[0]))
    few = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).where(F.col("h") <= bound).select(F.col("doc_id").alias("_id"), "y", "h")
    found = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= fit_bytes)).select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    chosen = found.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id", "text"))).where(F.col("k") <= wanted)
    return [(r.text.encode(), r.y) for r in sorted(chosen.select("text", "y", "k").collect(), key=lambda r: (r.y, r.k))]


def _pairs(sentence: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of each distinct feature of each sentence."""
    both = np.unique(sentence.astype(np.int64) * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


def _in_parts(rows: list[tuple[bytes, int]], most: int = 100):
    """(rows before, buckets, sentence, owner) of `most` rows at a time, which bounds the memory that their features take."""
    hasher = SentenceHasher()
    for i in range(0, len(rows), most):
        buckets, sentence, owner, _, _ = hasher.features([r[0] for r in rows[i : i + most]])
        yield i, buckets, sentence, owner


def fit(rows: list[tuple[bytes, int]], rounds: int = ROUNDS, a_round: int = A_ROUND, shrink: float = SHRINK, smooth: float = SMOOTH, least_docs: int = LEAST_DOCS) -> tuple[np.ndarray, float] | None:
    """(weights by bucket, bias); features of fewer than `least_docs` toxic documents have none.  None without rows of both labels."""
    y = np.array([r[1] for r in rows], dtype=bool)
    if not y.any() or y.all():
        return None
    n, weights = len(rows), np.zeros(BUCKETS, dtype=np.float32)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for _, buckets, sentence, owner in _in_parts([r for r in rows if r[1]]):
        _, f = _pairs(np.repeat(owner[sentence], buckets.shape[1]), buckets.ravel())
        seen += np.bincount(f, minlength=BUCKETS)
    parts, owners, sentences = [], [], 0
    for before, buckets, sentence, owner in _in_parts(rows):
        at = seen[buckets] >= least_docs
        s, f = _pairs(np.repeat(sentence, at.sum(axis=1)), buckets[at])
        parts.append(((s + sentences).astype(np.int32), f.astype(np.int32)))
        owners.append(owner + before)
        sentences += len(owner)
    owner = np.concatenate(owners)
    if not len(owner):
        return weights, -20.0
    s, f = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(f, kind="stable")
    s, f = s[order], f[order]
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])[: len(f)])
    ends = np.append(starts[1:], len(f))
    toxic, z = y[owner], np.full(len(owner), np.log(0.3 * n / len(owner)))
    for _ in range(rounds):
        harm = np.bincount(owner, weights=softplus(z), minlength=n)
        # Size of the gradient of the log loss by each sentence's logit.
        g = np.where(toxic, (1 / np.expm1(np.clip(harm, 1e-9, 50)))[owner], 1.0) * sigmoid(z) / n
        up, down = np.where(toxic, g, 0), np.where(toxic, 0, g)
        z += np.clip(np.log((up.sum() + smooth) / (down.sum() + smooth)) / 2, -0.5, 0.5)
        if not len(starts):
            continue
        up, down = np.add.reduceat(up[s], starts) + smooth, np.add.reduceat(down[s], starts) + smooth
        for i in np.argsort(-((np.sqrt(up) - np.sqrt(down)) ** 2), kind="stable")[:a_round]:
            step = shrink * np.clip(np.log(up[i] / down[i]) / 2, -2, 2)
            weights[f[starts[i]]] += step
            z[s[starts[i] : ends[i]]] += step
    return weights, float(z[0] - weights[f[s == 0]].sum())


def logits(sentence: np.ndarray, buckets: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Of n sentences, by their words' buckets."""
    word, column = np.nonzero(weights[buckets])
    s, f = _pairs(sentence[word], buckets[word, column])
    return bias + np.bincount(s, weights=weights[f], minlength=n)


def score_sentences(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, n_sentences, offending (start, end, score, text; characters, end exclusive) of documents
    (doc_id, text): the sentences that reach the threshold, or the worst one of a document that does so only as a whole."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def scored(texts: list[bytes], hasher: SentenceHasher, weights: np.ndarray, bias: float):
        buckets, sentence, owner, first, last = hasher.features(texts)
        z = logits(sentence, buckets, len(owner), weights, bias)
        scores = -np.expm1(-np.bincount(owner, weights=softplus(z), minlength=len(texts)))
        p = sigmoid(z)
        hits: list[list] = [[] for _ in texts]
        begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
        toxic = scores >= threshold
        near = np.flatnonzero(toxic[owner]) if len(owner) else []
        worst: dict[int, int] = {}
        for i in near:
            if p[i] > p[worst.setdefault(int(owner[i]), i)]:
                worst[int(owner[i])] = i
        for i in near:
            d = int(owner[i])
            if p[i] >= threshold or worst[d] == i and p[i] < threshold:
                a, e = int(first[i] - begins[d]), int(last[i] - begins[d])
                text = texts[d][a:e].decode()
                start = len(texts[d][:a].decode())
                hits[d].append({"start": start, "end": start + len(text), "score": float(p[i]), "text": text})
        return scores, np.bincount(owner, minlength=len(texts)), hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = SentenceHasher(), shared.value
        for batch in batches:
            texts = batch.column(2).fill_null("").cast(pa.large_binary()).to_pylist()
            scores, counts, hits, at = [], [], [], 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= GROUP_BYTES:
                    size, to = size + len(texts[to]), to + 1
                if known is None:
                    s, c, h = np.zeros(to - at), hasher.features(texts[at:to])[2], [[] for _ in range(to - at)]
                    c = np.bincount(c, minlength=to - at)
                else:
                    s, c, h = scored(texts[at:to], hasher, *known)
                scores, counts, hits, at = [*scores, *s.tolist()], [*counts, *c.tolist()], [*hits, *h], to
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(span))], names=["doc_id", "held_out", "score", "n_sentences", "offending"])

    x = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return x.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, n_sentences long, offending array<struct<start:long,end:long,score:double,text:string>>")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    x = score_sentences(docs, model)
    spans = F.array_join(F.transform("offending", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return x.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"), spans.alias("offending"))


QUERIES = {"op12_toxicity": op12_toxicity}
SQL: dict[str, str] = {}
