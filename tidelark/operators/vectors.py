"""A vector index of inverted lists: fitted centres, vectors stored by their nearest one, searches of the nearest lists.

A generation of the index is a folder with `centres` (list, centre) and `vectors` (key, embedding, gap to the centre), which is
partitioned by list, so that a search of few lists reads few files.  The number of lists is floor(sqrt(n)), at most MAX_LISTS,
which bounds what is broadcast.  A search reads as many of them as a build has found to give the recall asked for: for the exact
neighbours of a bounded sample of vectors, the rank of their list among those of the vector; never fewer than
floor(sqrt(lists / 2)).  Inserted vectors go to
their lists at once; when the number of lists that fits has grown to more than REBUILD times the present one, a new generation is
built and the old one deleted.

A search takes any number of queries.  Each query's lists meet the vectors in blocks of a list and of its queries, so a list of
any size is dealt over many tasks; a block keeps the k nearest of each query, and those of all blocks are ranked.  Exact results
come from a second pass: by the triangle inequality a list whose centre is farther than the kth distance and the list's radius
together holds nothing nearer.  Queries that find fewer than k vectors always take it.

Vectors must be of one length, without nulls and finite; rows whose vector is null are left out.  Keys are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.plans.standins import table
from tidelark.sources.stores import cut, delete, exists, names, new_path

#: Lists at most, rows that centres are fitted to (for each list, and in all), growth of the number of lists that rebuilds.
MAX_LISTS, SAMPLE_ROWS, SAMPLE_MOST, REBUILD = 32_768, 64, 1_000_000, 1.2
#: Vectors of a list, and queries of a list, that meet in one task; distinct lists that a filter of the scan names at most.
BLOCK, QUERY_BLOCK, FILTER_LISTS = 20_000, 500, 1_000
#: Components of queries, repeated for each of their lists, in one batch that Python makes at most: 8 MB.
BATCH_COMPONENTS = 1 << 20
#: Mean recall that the number of lists read is chosen for, by so many vectors and neighbours of each.
RECALL, TUNE_ROWS, TUNE_NEAREST = 0.95, 100, 10


def list_count(n: int) -> int:
    return max(1, min(MAX_LISTS, math.isqrt(n)))


def probe_count(lists: int) -> int:
    return max(1, math.isqrt(lists // 2))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x to one vector or, row by row, to those of y; summed in one order, so that equal vectors are equally far."""
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, the nearest first."""
    out = np.empty((len(x), k), dtype=np.int64)
    step = max(1, (1 << 22) // max(1, len(centres)))
    for i in range(0, len(x), step):
        d = (centres**2).sum(axis=1) - 2 * x[i : i + step] @ centres.T
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _repeated(batch: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """The rows (query, embedding) of a batch, each with its list, in batches of at most BATCH_COMPONENTS."""
    step = max(1, BATCH_COMPONENTS // max(1, width))
    for i in range(0, len(rows), step):
        yield batch.take(pa.array(rows[i : i + step])).append_column("list", pa.array(lists[i : i + step].astype(np.int32)))


class VectorIndex:
    """An index in a folder; `key` and `column` name the id and the vector of the rows given to it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column = spark, path.rstrip("/"), key, column

    # A generation counts once its centres are there, which are written last.

    def _generations(self) -> list[str]:
        found = [f"{self.path}/{n}" for n in names(self.spark, self.path) if n.startswith("generation-")]
        return [g for g in found if exists(self.spark, f"{g}/centres/_SUCCESS")]

    @property
    def place(self) -> str:
        found = self._generations()
        if not found:
            raise ValueError(f"no index in {self.path}")
        return found[-1]

    def vectors(self) -> DataFrame:
        """key, embedding, gap, list."""
        return self.spark.read.parquet(f"{self.place}/vectors")

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.place}/centres").orderBy("list").collect()
        return np.array([r.centre for r in rows], dtype=np.float64)

    def build(self, vectors: DataFrame) -> None:
        vectors = vectors.where(F.col(self.column).isNotNull()).select(F.col(self.key).alias("key"), F.col(self.column).alias("embedding"))
        n = vectors.count()
        if not n:
            raise ValueError("no vectors")
        old = self._generations()
        number = int(old[-1].rsplit("-", 1)[1]) + 1 if old else 1
        place = f"{self.path}/generation-{number:06d}"
        delete(self.spark, place)
        centres = self._fit(vectors, n, list_count(n))
        self._write(vectors, centres, place)
        rows = [(i, [float(v) for v in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.parquet(f"{place}/centres")
        self._tune(n)
        for g in old:
            delete(self.spark, g)

    def _tune(self, n: int) -> None:
        """Write the number of lists that RECALL takes."""
        share = min(1.0, TUNE_ROWS / n)
        x = self.vectors().where(F.pmod(F.xxhash64("key", F.lit("tune")), F.lit(1 << 40)) < max(1, int(2 * share * (1 << 40))))
        x = cut(x.select(F.col("key").alias("query"), "embedding").limit(TUNE_ROWS), "tune")
        centres, fewest = self.centres(), probe_count(len(self.centres()))
        near = self.search(x, TUNE_NEAREST + 1, exact=True).where("query <> key").select("query", "key")
        # At most TUNE_ROWS * TUNE_NEAREST rows, each with its list.
        near = self.vectors().select("key", "list").join(F.broadcast(near), "key").join(x, "query").select("embedding", "list").collect()
        ranks = np.zeros(0, dtype=np.int64)
        if near:
            order = _nearest_centres(np.array([r.embedding for r in near], dtype=np.float64), centres, len(centres))
            ranks = np.sort(np.argmax(order == np.array([[r.list] for r in near]), axis=1))
        probes = max(fewest, int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1 if len(ranks) else 1)
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{self.place}/tuning")

    def probes(self) -> int:
        """Lists that a search reads unless told otherwise."""
        place = f"{self.place}/tuning"
        if exists(self.spark, f"{place}/_SUCCESS"):
            return self.spark.read.parquet(place).first().probes
        return probe_count(len(self.centres()))

    def _fit(self, vectors: DataFrame, n: int, lists: int) -> np.ndarray:
        """Centres of a sample of at most SAMPLE_ROWS rows a list and SAMPLE_MOST in all, by hashed key."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        share = min(SAMPLE_ROWS * lists, SAMPLE_MOST) / n
        sample = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < max(1, int(share * (1 << 40)))) if share < 1 else vectors
        sample = cut(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), "sample")
        if lists == 1 or sample.limit(lists).count() < lists:
            lists = 1
        model = KMeans(k=lists, maxIter=8, seed=7, initMode="random").fit(sample)
        return np.array(model.clusterCenters())

    def _write(self, vectors: DataFrame, centres: np.ndarray, place: str) -> None:
        shared = self.spark.sparkContext.broadcast(centres)
        kinds = dict(vectors.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                near = _nearest_centres(x, shared.value, 1)[:, 0] if len(x) else np.zeros(0, np.int64)
                gap = _distances(x, shared.value[near]) if len(x) else np.zeros(0)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(gap), pa.array(near.astype(np.int32))], names=["key", "embedding", "gap", "list"])

        rows = vectors.mapInArrow(run, f"key {kinds['key']}, embedding {kinds['embedding']}, gap double, list int")
        # Rows of a list meet before the write, a large list in several tasks.
        rows.hint("rebalance", "list").write.partitionBy("list").mode("append").parquet(f"{place}/vectors")

    def insert(self, vectors: DataFrame) -> bool:
        """Add vectors; True where the index was built anew."""
        place = self.place
        vectors = vectors.where(F.col(self.column).isNotNull()).select(F.col(self.key).alias("key"), F.col(self.column).alias("embedding"))
        self._write(vectors, self.centres(), place)
        present = self.spark.read.parquet(f"{place}/centres").count()
        if list_count(self.vectors().count()) <= present * REBUILD:
            return False
        self.build(self.vectors().select(F.col("key").alias(self.key), F.col("embedding").alias(self.column)))
        return True

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query, key, distance, rank of the k nearest vectors of each of `queries` (query, embedding): by distance, then key."""
        members = self.vectors()
        centres = self.centres()
        shared = self.spark.sparkContext.broadcast(centres)
        probes = min(len(centres), probes or self.probes())
        # As many rows as there are lists.
        stats = cut(members.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")), "list-sizes")
        queries = cut(queries.where(F.col("embedding").isNotNull()).select("query", F.col("embedding").cast("array<double>").alias("embedding")), "queries")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                few = max(1, BATCH_COMPONENTS // len(shared.value))
                for i in range(0, len(x), few):
                    lists = _nearest_centres(x[i : i + few], shared.value, probes)
                    yield from _repeated(batch, np.repeat(np.arange(i, i + len(lists)), probes), lists.ravel(), x.shape[1])

        kind = dict(queries.dtypes)["query"]
        chosen = cut(queries.mapInArrow(near, f"query {kind}, embedding array<double>, list int"), "probes")
        found = cut(self._scored(chosen, members, stats, k), "found")

        best = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        bound = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("inf")))
        again = queries.join(best, "query", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).drop("n", "kth")
        again = cut(again if exact else again.where(F.col("bound") == float("inf")), "again")
        if not again.isEmpty():
            radius = np.full(len(centres), -1.0)
            for r in stats.collect():
                radius[r.list] = r.radius
            sizes = self.spark.sparkContext.broadcast(radius)

            def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x, bounds = _matrix(batch.column(1)), batch.column(2).to_numpy()
                    few = max(1, BATCH_COMPONENTS // len(shared.value))
                    for i in range(0, len(x), few):
                        done = _nearest_centres(x[i : i + few], shared.value, probes)
                        rows, lists = [], []
                        for j, (v, b) in enumerate(zip(x[i : i + few], bounds[i : i + few], strict=True)):
                            gap = _distances(shared.value, v)
                            # A little more than the bound, for the rounding of the three distances.
                            may = (sizes.value >= 0) & (gap - sizes.value <= b + 1e-9 * (1 + gap))
                            may[done[j]] = False
                            lists.append(np.flatnonzero(may))
                            rows.append(np.full(len(lists[-1]), i + j))
                        yield from _repeated(batch.select([0, 1]), np.concatenate(rows), np.concatenate(lists), x.shape[1])

            more = cut(again.mapInArrow(within, f"query {kind}, embedding array<double>, list int"), "more-probes")
            found = found.unionByName(self._scored(more, members, stats, k))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _scored(self, chosen: DataFrame, members: DataFrame, stats: DataFrame, k: int) -> DataFrame:
        """query, key, distance: of each block of a list the k nearest of each query that asks for it (query, embedding, list)."""
        asked = chosen.groupBy("list").agg(F.count("*").alias("asked"))
        plan = cut(stats.join(asked, "list").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("turns")), "blocks")
        wanted = [r.list for r in plan.select("list").limit(FILTER_LISTS + 1).collect()]
        if len(wanted) <= FILTER_LISTS:
            members = members.where(F.col("list").isin(wanted))
        plan = F.broadcast(plan)
        cell = ["list", "block", "turn"]
        q = chosen.join(plan, "list").withColumn("turn", F.pmod(F.xxhash64("query"), F.col("turns")).cast("int"))
        q = q.select("query", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "turn")
        m = members.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        m = m.select("key", "embedding", "list", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

        def near(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(held):
                held = held.sort_values("key")
                keys, x = held["key"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype(np.float64)
                for query, v in zip(asked["query"], asked["embedding"], strict=True):
                    d = _distances(x, np.asarray(v, dtype=np.float64))
                    # Keys ascend, and the sort is stable: ties go to the smaller key.
                    far = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                    at = np.flatnonzero(d <= far)
                    at = at[np.argsort(d[at], kind="stable")][:k]
                    out.append(pd.DataFrame({"query": query, "key": keys[at], "distance": d[at]}))
            return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "distance": []})

        kinds = f"query {dict(chosen.dtypes)['query']}, key {dict(members.dtypes)['key']}, distance double"
        return q.groupBy(*cell).cogroup(m.groupBy(*cell)).applyInPandas(near, kinds)


def _searched(s: SparkSession, d: str, exact: bool) -> DataFrame:
    """The ten nearest vectors of every one whose id is divisible by 50, by an index of all vectors."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(s, new_path(s, "vector-index"))
    index.build(vectors)
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), "embedding")
    return index.search(queries, 10, exact=exact).select("query", F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


_EVERY = "sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i]) * (CAST(e.embedding[i] AS DOUBLE) - q.embedding[i]))))"
QUERIES = {
    "t10_index": lambda s, d: _searched(s, d, False),
    "t10_index_exact": lambda s, d: _searched(s, d, True),
}
SQL = {
    "t10_index_exact": f"WITH x AS (SELECT q.vec_id AS query, e.vec_id, {_EVERY} AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) SELECT query, vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INT) AS rank FROM x QUALIFY rank <= 10",
}
