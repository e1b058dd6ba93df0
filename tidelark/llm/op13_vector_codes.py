"""Vector code compression: a codebook for each part of the vectors, refined in rounds with kd-trees.

Components become integers, so that every sum and distance is exact.  A round broadcasts one kd-tree for each codebook (its
size is fixed: entries times components), tasks find each part's nearest entry by branch and bound, and integer sums and counts
of each entry, added up in the tasks first, make the next codebooks.  A subtree is visited while its bound is no larger than
the best distance: equal ones too, so that the lower index of two entries at the same distance is found.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; equal ids are ordered by their
vectors, and a null id comes after all others; with fewer rows than entries the codebooks are shorter; repeated rows count as
often as they come; a null label is one label; other columns are ignored; an empty table gives an empty result.  Vectors of
different lengths, of a length that the parts don't divide, or with components beyond `LARGEST` are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm.shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers from here on have squares that Python's own integers hold; distances must fit a long all the same.
WIDE, LARGEST = 1 << 26, 1 << 60
LEAF = 2


class KdTree:
    """The entries of one codebook: boxes around them, split at the median of the widest side."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.nodes = entries, []
        self._add(np.arange(len(entries)))

    def _add(self, ids: np.ndarray) -> int:
        inside, at = self.entries[ids], len(self.nodes)
        low, high = inside.min(axis=0), inside.max(axis=0)
        self.nodes.append(None)
        side = int(np.argmax(high - low)) if len(low) else 0
        if len(ids) <= LEAF or not len(low) or low[side] == high[side]:
            self.nodes[at] = (low, high, sorted(ids.tolist()), -1, -1)
            return at
        order = ids[np.argsort(inside[:, side], kind="stable")]
        half = len(order) // 2
        self.nodes[at] = (low, high, [], self._add(order[:half]), self._add(order[half:]))
        return at

    def bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """The least squared distance from each row of x to the node's box."""
        low, high = self.nodes[node][:2]
        gap = np.maximum(np.maximum(low - x, x - high), 0)
        return (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; the lowest index of several."""
        best = np.full(len(x), -1, dtype=x.dtype)
        index = np.zeros(len(x), dtype=np.int64)
        self._visit(0, np.arange(len(x)), x, best, index)
        return index, best

    def _visit(self, node: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        _, _, ids, left, right = self.nodes[node]
        here = x[rows]
        for e in ids:
            gap = here - self.entries[e]
            d = (gap * gap).sum(axis=1)
            nearer = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = d[nearer], e
        if left < 0:
            return
        to_left, to_right = self.bound(left, here), self.bound(right, here)
        near = to_left <= to_right
        self._visit(left, rows[near], x, best, index)
        self._visit(right, rows[~near], x, best, index)
        # What is still no nearer than the other box; equal bounds may hide a lower index.
        again = near & (to_right <= best[rows])
        self._visit(right, rows[again], x, best, index)
        again = ~near & (to_left <= best[rows])
        self._visit(left, rows[again], x, best, index)


def whole(column: Column | str) -> Column:
    """Vectors without null or non-finite components."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(lists: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their vectors as integers floor(SCALE * x)) of an array of lists."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy()
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(np.maximum(sizes, 0))
    keep = np.flatnonzero((sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)]))
    length = length if length is not None else int(sizes[keep[0]]) if len(keep) else 0
    if (sizes[keep] != length).any() or length % PARTS:
        raise ValueError(f"vectors must all have one length that {PARTS} divides")
    x = np.floor(SCALE * values[((ends - sizes)[keep][:, None] + np.arange(length))]) if len(keep) else np.zeros((0, length))
    largest = float(np.abs(x).max()) if x.size else 0.0
    if largest >= LARGEST:
        raise ValueError("components are too large for distances that fit a long")
    return keep, x.astype(np.int64) if largest < WIDE else x.astype(np.int64).astype(object)


def _assigned(trees: list[KdTree], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its vectors, their entries, the squared distances."""
    width = x.shape[1] // PARTS
    for j, tree in enumerate(trees):
        part = x[:, j * width : (j + 1) * width]
        wide = object if part.dtype == object or tree.entries.dtype == object else np.int64
        part = np.ascontiguousarray(part.astype(wide, copy=False))
        yield part, *tree.nearest(part)


def _sums(trees, length: int):
    """(part, entry, position, total, n) of a task's vectors; position -1 has the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = trees.value
        width = length // PARTS
        total = np.zeros((PARTS, ENTRIES, width), dtype=object)
        count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), length)
            for j, (part, index, _) in enumerate(_assigned(found, x)):
                count[j] += np.bincount(index, minlength=ENTRIES)
                for e in np.unique(index):
                    total[j, e] += part[index == e].sum(axis=0).astype(object)
        rows = [(j, e, i, Decimal(int(total[j, e, i])), int(count[j, e])) for j in range(PARTS) for e in range(ENTRIES) if count[j, e] for i in range(width)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "position", "total", "n"])

    return run


def fit_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part of vectors (vec_id, embedding): a row for each entry, of integers.  Empty for an empty table."""
    spark = vectors.sparkSession
    first = vectors.where(whole("embedding")).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").collect()
    if not first:
        return []
    length = len(first[0][0])
    _, x = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), length)
    books = np.split(x, PARTS, axis=1)
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        sums = vectors.select("embedding").mapInArrow(_sums(trees, length), "part int, entry int, position int, total decimal(38,0), n long")
        # As many rows as the codebooks have components.
        for r in sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            if books[r.part].dtype != object and abs(int(r.total) // r.n) >= WIDE:
                books[r.part] = books[r.part].astype(object)
            books[r.part][r.entry, r.position] = int(r.total) // r.n
        trees.unpersist()
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (the entry of each part, two hexadecimal digits each), error (squared distances, summed) of vectors
    (vec_id, label, embedding)."""
    names, kinds = ["vec_id", "label", "code", "error"], "vec_id long, label long, code string, error long"
    length = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [KdTree(b) for b in books]
        for batch in batches:
            keep, x = integers(batch.column(2), length)
            codes = np.zeros((len(x), PARTS), dtype=np.uint8)
            error = np.zeros(len(x), dtype=object)
            for j, (_, index, distance) in enumerate(_assigned(trees, x)):
                codes[:, j] = index
                error += distance
            rows = batch.select([0, 1]).take(pa.array(keep))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error.tolist(), pa.int64())], names=names)

    x = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return x.mapInArrow(run, kinds) if books else x.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))


def decode(code: str, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for."""
    return [float(v) / SCALE for j, b in enumerate(books) for v in b[int(code[2 * j : 2 * j + 2], 16)]]


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = fit_codebooks(vectors)
    coded = cut(encode(vectors, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    listed = ",".join(str(int(v)) for b in books for entry in b for v in entry)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as one query after the other, for vectors of 64 components."""
    width = 8
    distance = "list_sum(list_transform(range(1, 9), lambda i: (p.s[i] - c.s[i]) * (p.s[i] - c.s[i])))"
    mean = ", ".join(f"CAST((sum(p.s[{i}]) - ((sum(p.s[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, width + 1))
    steps = [
        "q AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rid, list_transform(embedding, lambda v: CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "p AS (SELECT rid, j AS part, v[j * 8 + 1 : j * 8 + 8] AS s FROM q, range(8) t(j))",
        "c0 AS (SELECT part, rid - 1 AS k, s FROM p WHERE rid <= 16)",
    ]
    for i in range(7):
        steps.append(f"a{i} AS (SELECT p.rid, p.part, arg_min(c.k, ({distance}, c.k)) AS k, min({distance}) AS d FROM p JOIN c{i} c ON c.part = p.part GROUP BY 1, 2)")
        if i < 6:
            steps.append(f"c{i + 1} AS (SELECT c.part, c.k, coalesce(n.s, c.s) AS s FROM c{i} c LEFT JOIN (SELECT a.part, a.k, [{mean}] AS s FROM a{i} a JOIN p ON p.rid = a.rid AND p.part = a.part GROUP BY 1, 2) n ON n.part = c.part AND n.k = c.k)")
    steps.append("b AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c6)")
    steps.append("e AS (SELECT rid, string_agg(format('{:02x}', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM q JOIN e ON e.rid = q.rid, b"


QUERIES = {"op13_vector_codes": op13_vector_codes}
SQL = {"op13_vector_codes": _sql()}
