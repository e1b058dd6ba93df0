"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is not negative.  Codes are cut into m segments whose
widths differ by one bit at most; the index has a row for each code and segment.  A search looks up, for every segment, the
values at Hamming distance 0, 1, 2, ... from the query's.  With radius r looked up in a segments and radius r - 1 in the
others, a code at distance m * r + a - 1 or less must have been found, so a query is finished as soon as its kth verified
distance is no larger.  Open queries go on, each only in as many segments as its kth distance needs.

m is the number for which lookups and candidates cost least, by the kth distances of SAMPLE_QUERIES queries against all codes.
A query's kth distance to SAMPLE_CODES codes bounds its kth distance to all, so the join that brings the candidates verifies
them at once: it lets only those through that are within the bound, which falls to the kth best as the radius grows.  Both
samples only bound or price the work: the answers are those of a scan of all rows, whatever they hold.

Equal codes are one entry with its k smallest ids (no answer needs more), so a vector that a third of the rows share is one
row of the index, and equal queries are searched once.  A code is taken up at its closest segment only, which removes
repeated candidates without a shuffle.

Defined cases: vectors that are null, hold nulls or have another dimension than `bits` have no code and are neither found nor
searched for; ties in distance are ordered by vec_id; a query finds itself at distance 0; with fewer than k codes all are
returned; rows that repeat a vec_id and its code count once, while a vec_id with two codes stands for two vectors (as a query
it gets the answers of both); other columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.shared import cut

TOP, QUERY_EVERY = 10, 50
#: Queries whose kth distances price the index, codes whose distances bound a query's, and candidates that cost as a lookup.
SAMPLE_QUERIES, SAMPLE_CODES, LOOKUP_COST = 16, 1_000, 10


def codes_of(vectors: DataFrame, bits: int) -> DataFrame:
    """vec_id, code (64-bit integer) of vectors (vec_id, embedding)."""
    if not 1 <= bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    whole = vectors.where((F.size("embedding") == bits) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull())
    code = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("embedding")[i] >= 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(bits)])
    return whole.select("vec_id", code.cast("long").alias("code"))


def widths(bits: int, m: int) -> list[int]:
    """Bits of each of m segments, the wider ones first."""
    return [bits // m + (i < bits % m) for i in range(m)]


def segments(code: Column | str, sizes: list[int]) -> list[Column]:
    code = F.col(code) if isinstance(code, str) else code
    return [F.shiftrightunsigned(code, sum(sizes[:j])).bitwiseAND(F.lit((1 << w) - 1)).cast("long") for j, w in enumerate(sizes)]


def masks(width: int, radius: int) -> list[int]:
    return [reduce(add, (1 << b for b in bits), 0) for bits in combinations(range(width), radius)]


def constant_array(values: list[int], kind: str = "int") -> Column:
    """An array that the optimizer folds to one constant instead of an expression for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def kth_distances(index: DataFrame, sample: list[int], k: int, bits: int) -> list[int]:
    """The distance of the kth code of (code, ids) from each of a few codes; `bits` where there are fewer."""
    apart = F.posexplode(F.transform(constant_array(sample, "bigint"), lambda q: F.bit_count(q.bitwiseXOR(F.col("code")))))
    counts = index.select(apart.alias("i", "distance")).groupBy("i", "distance").agg(F.count("*").alias("n"))
    kth = []
    found = {(r.i, r.distance): r.n for r in counts.collect()}
    for i in range(len(sample)):
        taken = [d for d in range(bits + 1) if sum(found.get((i, e), 0) for e in range(d + 1)) >= k]
        kth.append(taken[0] if taken else bits)
    return kth


def segment_count(n: int, kth: list[int], bits: int) -> int:
    """The number of segments for which lookups and the candidates expected among n codes cost least for queries with these kth
    distances.  No segment has more than some log2(n) bits, so that no query ever looks up more values than there are codes."""

    def cost(m: int) -> float:
        total = 0.0
        for d in kth:
            radius, more = divmod(d + 1, m)
            for j, w in enumerate(widths(bits, m)):
                ball = sum(math.comb(w, r) for r in range(min(w, radius if j < more else radius - 1) + 1))
                total += ball * (LOOKUP_COST + n / (1 << w))
        return total

    return min(range(math.ceil(bits / max(4, math.log2(max(n, 1)))), bits + 1), key=cost)


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, bits: int = 64) -> DataFrame:
    """query_id, rank, vec_id, distance: the k vectors of (vec_id, embedding) closest to each of the queries (vec_id, embedding)."""
    spark = vectors.sparkSession
    ranked = codes_of(vectors, bits).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("vec_id")))
    index = cut(ranked.where(F.col("rank") <= k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "codes")
    n = index.count()
    asked = cut(codes_of(queries, bits).distinct().select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")), "queries")
    first_of = lambda df, c, most: [r[0] for r in df.select(c).distinct().orderBy(F.xxhash64(c), c).limit(most).collect()]
    sample = first_of(asked, "q", SAMPLE_QUERIES)
    m = segment_count(n, kth_distances(index, sample, k, bits), bits) if sample and n else bits
    sizes = widths(bits, m)
    wide, n_wide = sizes[0], sizes.count(sizes[0])
    parts = cut(index.select("code", "ids", F.posexplode(F.array(*segments("code", sizes))).alias("j", "value")), "segments")

    near = F.transform(constant_array(first_of(index, "code", SAMPLE_CODES), "bigint"), lambda c: F.bit_count(c.bitwiseXOR(F.col("q"))))
    bound = F.coalesce(F.get(F.array_sort(near), F.lit(k - 1)), F.lit(bits))
    open_queries = asked.select("q").distinct().withColumn("bound", bound).withColumn("need", F.least(F.lit(m), F.col("bound") + 1))
    open_queries = cut(open_queries, "open")
    best = spark.createDataFrame([], "q long, code long, ids array<long>, distance int")
    finished = []
    for radius in range(wide + 1):
        probe = open_queries.select("q", "need", "bound", F.posexplode(F.array(*segments("q", sizes))).alias("j", "s")).where("j < need")
        flips = F.when(F.col("j") < n_wide, constant_array(masks(wide, radius))).otherwise(constant_array(masks(wide - 1, radius)))
        probe = probe.withColumn("mask", F.explode(flips)).select("q", "bound", "j", F.col("s").bitwiseXOR(F.col("mask")).alias("value"))
        apart = [F.bit_count(x) for x in segments(F.col("q").bitwiseXOR(F.col("code")), sizes)]
        first = reduce(lambda a, b: a & b, [F.when(F.col("p.j") > i, apart[i] > radius).otherwise(apart[i] >= radius) for i in range(m)])
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        same = (F.col("p.j") == F.col("i.j")) & (F.col("p.value") == F.col("i.value"))
        # Spark's estimate of the exploded side is that of the queries: without the hint it would be broadcast.
        found = probe.hint("merge").alias("p").join(parts.alias("i"), same & (distance <= F.col("bound")) & first).select("q", "code", "ids", distance.alias("distance"))
        order = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
        best = cut(best.unionByName(found).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), "best")
        taken = F.least(F.lit(k), F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        reached = best.withColumn("n", taken).groupBy("q").agg(F.max("n").alias("n"), F.min(F.when(F.col("n") >= k, F.col("distance"))).alias("kth"))
        state = cut(open_queries.join(reached.select("q", "kth"), "q", "left"), "state")
        done = F.coalesce(F.col("kth") <= F.col("need") + (m * radius - 1), F.lit(False)) | F.lit(radius == wide)
        finished.append(best.join(state.where(done), "q", "left_semi"))
        bound = F.least("bound", F.coalesce("kth", F.lit(bits)))
        open_queries = cut(state.where(~done).select("q", bound.alias("bound"), F.least(F.lit(m), bound - (m * (radius + 1) - 1)).alias("need")), "open")
        if open_queries.isEmpty():
            break
        best = best.join(open_queries, "q", "left_semi")

    answers = reduce(DataFrame.unionByName, finished).select("q", "distance", F.explode("ids").alias("vec_id"))
    answers = cut(answers.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).where(F.col("rank") <= k), "answers")
    return asked.join(answers, "q").select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"op9_topk": op9_topk}
SQL = {
    "op9_topk": """
WITH b AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x >= 0) AS bits FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(a.bits[i] <> b.bits[i] AS INT))) AS INT) AS distance FROM b a CROSS JOIN b WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
}
