"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q that is at least twice as long as q and that no neighbouring
word extends.  Every text's words are numbers; then

* a suffix array is built by doubling, for all texts of a group at once; the ranks of every doubling are kept, since two ranks
  are equal just where the 2^k words from there on are, which answers how far two places agree in either direction;
* suffix array and LCP array give the longest previous factor of each place (nearest smaller neighbours by pointer jumping,
  with the least LCP on the way), and these the LZ blocks;
* a run that touches the boundary of a block is found there by extending both ways, as Main's theorem bounds its period by the
  lengths of the two blocks; a run strictly within a block is a copy of an earlier one, found in buckets by its start.

All runs of at least `min_length` words are found, whatever their period; shorter ones are no runs here, and no copies of them
are needed.  Work is about linear in the words; memory is some 100 bytes a word of a group, and a group is at most
`GROUP_BYTES` of text or one text.

Defined cases: null, empty and blank texts have no words and no runs, and collapse to an empty text; rows are handled one by
one, so repeated rows and ids give repeated results and a null doc_id is no matter; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm.shared import documents, small_batches, tidy

MIN_LENGTH = 12
GROUP_BYTES = 2 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of every word, words of each text); equal words have equal numbers, from 0."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~blank].tobytes())])
    numbers = words.dictionary_encode().indices.to_numpy()
    limits = np.cumsum([len(t) + 1 for t in texts])
    return numbers.astype(np.int64), np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))


class Ranked:
    """Suffix array of many sequences, each behind a sentinel of its own; sequences are never compared with one another."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray):
        n = len(numbers) + len(sizes)
        heads = np.cumsum(np.concatenate([[0], sizes[:-1] + 1])) if len(sizes) else np.zeros(0, np.int64)
        self.n, self.heads = n, heads
        sequence = np.repeat(np.arange(len(sizes)), sizes + 1)
        symbols = np.zeros(n + 1, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[heads] = False
        symbols[:n][inner] = numbers + 1
        #: 1-based place within its sequence; 0 at the sentinel.
        self.place = np.arange(n) - heads[sequence]
        self.end = (heads + sizes + 1)[sequence]
        width = int(symbols.max(initial=0)) + 1
        self.levels = [np.append(sequence * width + symbols[:n], -1)]
        self._sort(symbols, sequence, width)

    def _sort(self, symbols: np.ndarray, sequence: np.ndarray, width: int) -> None:
        """By two words first, then by twice as many in each round, for those that are still equal."""
        n = self.n
        following = np.where(np.arange(1, n + 1) < self.end, symbols[1:], 0)
        key = (sequence * width + symbols[:n]) * width + following
        suffixes = np.argsort(key)
        sorted_key = key[suffixes]
        first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])[:n]
        rank = np.full(n + 1, -1, dtype=np.int64)
        rank[suffixes] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.levels.append(rank.astype(np.int32))
        open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
        reach = 2
        while len(open_):
            at = suffixes[open_]
            beyond = at + reach
            second = np.where(beyond < self.end[at], rank[np.minimum(beyond, n)], -1)
            key = rank[at] * (n + 1) + second + 1
            order = np.argsort(key)
            at, key = at[order], key[order]
            suffixes[open_] = at
            first = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at] = np.maximum.accumulate(np.where(first, open_, 0))
            self.levels.append(rank.astype(np.int32))
            open_ = open_[~(first & np.append(first[1:], True))]
            reach *= 2
        self.suffixes = suffixes

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b, in one sequence)."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                length += (level[np.minimum(a + length, self.n)] == level[np.minimum(b + length, self.n)]).astype(np.int64) << k
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b, in one sequence)."""
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                at = a - length - step
                same = (at >= 0) & (level[np.maximum(at, 0)] == level[np.maximum(b - length - step, 0)])
                length += same.astype(np.int64) << k
        return length

    def lcp(self) -> np.ndarray:
        """Common words of each suffix and the one before it in the order."""
        out = np.zeros(self.n + 1, dtype=np.int64)
        a, b = self.suffixes[:-1], self.suffixes[1:]
        words = (self.place[a] > 0) & (self.place[b] > 0)
        out[1 : self.n] = words & (self.levels[0][a] == self.levels[0][b])
        more = np.flatnonzero(words & (self.levels[1][a] == self.levels[1][b]))
        out[more + 1] = self.forward(np.minimum(a[more], b[more]), np.maximum(a[more], b[more]))
        return out

    def longest_previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the longest factor that also begins earlier, and one such earlier place."""
        n, lcp = self.n, self.lcp()
        value = np.append(self.place[self.suffixes], 0)
        words = np.flatnonzero(value[:n] > 0)
        best, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for step in (-1, 1):
            link = np.arange(n + 1) + step
            link[n] = n
            least = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
            todo = words[value[link[words]] > value[words]]
            while len(todo):
                over = link[todo]
                least[todo] = np.minimum(least[todo], least[over])
                link[todo] = link[over]
                todo = todo[(value[link[todo]] > value[todo]) & (least[todo] > 0)]
            at, near = self.suffixes[words], link[words]
            here = np.where(value[near] < value[words], least[words], 0)
            better = here > best[at]
            best[at[better]], source[at[better]] = here[better], self.suffixes[near[better]]
        return best, source


def _spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 1 .. counts[row]) one after the other."""
    row = np.repeat(np.arange(len(starts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def find_runs(numbers: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each sequence its runs (start, length, period) by start, then period."""
    ranked = Ranked(numbers, sizes)
    n = ranked.n
    previous, source = ranked.longest_previous()
    # Blocks: a sentinel is one of its own, with no words.
    steps, i, begins = np.maximum(previous, 1).tolist(), 0, []
    while i < n:
        begins.append(i)
        i += steps[i]
    begins = np.array(begins + [n], dtype=np.int64)
    sentinel = np.append(ranked.place[begins[:-1]] == 0, True)
    lengths = np.append(np.diff(begins), 0)
    lengths[sentinel] = 0
    before = np.concatenate([[0], lengths[:-1]])
    # The first word of the sequence that ends at, or goes on over, each boundary.
    owner = np.where(sentinel, begins - 1, begins)
    first = (owner - ranked.place[np.maximum(owner, 0)] + 1) if n else owner
    limits = (ranked.end[np.maximum(owner, 0)]) if n else owner

    found = []
    floor = max(2, (min_length + 1) // 2)
    level = ranked.levels[1]
    for left in (True, False):
        most = np.minimum(lengths + before - 1, begins - first) if left else np.minimum(lengths, limits - begins)
        row, p = _spans(begins, np.maximum(most, 0))
        a = begins[row] - p if left else begins[row]
        b = a + p
        # A run has words that agree over `floor` places at least, so two in a row right of the boundary or left of it.
        back = a - 2 >= 0
        maybe = (level[np.minimum(a, n)] == level[np.minimum(b, n)]) | (back & (level[np.maximum(a - 2, 0)] == level[np.maximum(b - 2, 0)])) if floor > 2 else np.ones(len(a), bool)
        row, p, a, b = row[maybe], p[maybe], a[maybe], b[maybe]
        f, g = ranked.forward(a, b), ranked.backward(a, b)
        good = f + g >= np.maximum(p, min_length - p)
        found.append(np.stack([a - g, b + f, p], axis=1)[good])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Of one stretch the smallest period counts.
    runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[: len(runs)]]

    runs = _with_copies(runs, begins, lengths, source, min_length)
    sequence = np.searchsorted(ranked.heads, runs[:, 0], "right") - 1
    runs = np.stack([runs[:, 0] - ranked.heads[sequence] - 1, runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1) if len(runs) else np.zeros((0, 3), np.int64)
    return np.split(runs, np.searchsorted(sequence, np.arange(1, len(sizes)))) if len(sizes) else []


def _with_copies(runs: np.ndarray, begins: np.ndarray, lengths: np.ndarray, source: np.ndarray, min_length: int) -> np.ndarray:
    """Runs and their copies strictly within blocks, by start, then period."""
    bucket: dict[int, list] = {}
    for s, t, p in runs.tolist():
        bucket.setdefault(s, []).append((t, p))
    copied = []
    for k in np.flatnonzero(lengths >= min_length + 2).tolist() if len(runs) else ():
        b, e = int(begins[k]), int(begins[k] + lengths[k])
        d = b - int(source[b])
        for s in range(b + 1, e - min_length):
            for t, p in bucket.get(s - d, ()):
                if t + d < e:
                    bucket.setdefault(s, []).append((t + d, p))
                    copied.append((s, t + d, p))
    if copied:
        runs = np.concatenate([runs, np.array(copied, dtype=np.int64)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run has after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] > 0


def _groups(texts: list[bytes], most: int):
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield texts[start:]


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed of documents (doc_id, text): the words that
    no run repeats, joined by one space."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary()).to_pylist()
            counts, found, collapsed = [], [], []
            for group in _groups(texts, group_bytes):
                numbers, sizes = word_numbers(group)
                counts.append(sizes)
                for text, n, runs in zip(group, sizes.tolist(), find_runs(numbers, sizes, min_length), strict=True):
                    words = text.split()
                    if len(runs):
                        words = [w for w, gone in zip(words, repeated(runs, n).tolist(), strict=True) if not gone]
                    found.append(runs)
                    collapsed.append(b" ".join(words))
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(RUN)))
            n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.record_batch([batch.column(0), n_words, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(text: Column, doc_id: Column) -> Column:
    """The text with the words from a place on replaced by a loop, for documents whose hash of the id ends in 0.

    h = crc32(decimal id), g = h // 10, n words; from word a = g % n on, word i becomes word a + (i - a) % p, with
    p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewritten(x: Column) -> Column:
        n, w = x["n"], x["w"]
        a = (x["g"] % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + x["g"] % 8))).cast("int")
        kept = F.slice(w, 1, a)
        return F.array_join(F.concat(kept, F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at(w, a + i % p + 1))), " ")

    once = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))), lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g"), F.size(x["w"]).alias("n")))
    loop = F.transform(once, lambda x: F.when(x["n"] > 0, rewritten(x)).otherwise(""))[0]
    return F.when(h % 10 == 0, loop).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = documents(spark, sf_dir).select("doc_id", looped(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    x = collapse_runs(x)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    exponent = F.expr("(1000 * -b.l) div b.period").cast("long")
    return x.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op11_runs": op11_runs}
SQL: dict[str, str] = {}
