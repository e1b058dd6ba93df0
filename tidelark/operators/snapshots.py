"""Snapshots of file trees stored by content, and their differences found by descending into what differs.

A directory is known by a digest of its entries (name, file or directory, digest).  Entries are stored once for each digest, so a
subtree that two snapshots or two places share costs nothing more, and a comparison stops where digests are equal.

A digest sums numbers made of the SHA-256 of the entries, 32 bits each, and hashes the sums: sums are combined before the shuffle, so
a folder of any number of files (up to 2 billion) is no array in one task.  Unlike `graphs.merkle`, names count, so a file that is renamed is a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.plans.standins import table
from tidelark.sources.stores import cut, exists, new_path

#: Digests that are broadcast at most when a level's entries are read, some 10 MB.
BROADCAST_DIGESTS = 100_000
ENTRIES = "digest string, name string, child string, is_dir boolean, bucket int"
#: Numbers that an entry adds to its directory's sums: two for each quarter of its SHA-256.
PARTS = [f"_p{i}" for i in range(8)]


def _name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def _parent(path: str) -> Column:
    """What is before the last slash; "" without one.  No pattern is matched, since each level asks it of each path."""
    return F.substring(F.col(path), F.lit(1), F.length(path) - F.length(_name(path)) - 1)


def _depth(path: str) -> Column:
    """As columns.depth, by the number of slashes."""
    p = F.trim(F.col(path), F.lit("/"))
    return F.when(p == "", F.when(F.col(path).isin("", "/"), 0).otherwise(1)).otherwise(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) + 1)


def _entry_parts() -> list[Column]:
    """What an entry adds to its directory's sums, in whole numbers below 2 ** 32 that longs can sum."""
    h = F.sha2(F.concat_ws("/", F.col("name"), F.when(F.col("is_dir"), "d").otherwise("f"), F.col("child")), 256)
    quarters = [F.xxhash64(F.substring(h, 16 * i + 1, 16)) for i in range(4)]
    return [part.alias(p) for p, part in zip(PARTS, [x for q in quarters for x in (q.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(q, 32))], strict=True)]


def _digest() -> Column:
    """Digest of a group of entries; without entries the sums are 0."""
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in PARTS]
    return F.sha2(F.concat_ws(",", F.count("child").cast("string"), *sums), 256)


def tree_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories (path, digest), entries (parent, name, child, is_dir)) of files (path, hash), paths and hashes not null.

    One aggregation a level, the deepest first; a path that comes twice counts once, with the greatest of its hashes.
    """
    rows = files.groupBy("path").agg(F.max("hash").alias("child"))
    rows = cut(rows.select(_parent("path").alias("parent"), _name("path").alias("name"), "child", F.lit(False).alias("is_dir"), _depth("path").alias("depth")), "snapshot-files")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    front, dirs, entries = None, [], [rows.drop("depth")]
    for k in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == k).drop("depth")
        here = here if front is None else here.unionByName(front)
        found = cut(here.select("parent", "child", *_entry_parts()).groupBy(F.col("parent").alias("path")).agg(_digest().alias("digest")), "snapshot-level")
        dirs.append(found)
        if k > 1:
            front = found.select(_parent("path").alias("parent"), _name("path").alias("name"), F.col("digest").alias("child"), F.lit(True).alias("is_dir"))
            entries.append(front)
    if not dirs:
        nothing = rows.select("child", *(F.lit(0).cast("long").alias(p) for p in PARTS)).agg(_digest().alias("digest"))
        dirs = [nothing.select(F.lit("").alias("path"), "digest")]
    every = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(every(tables[1:]))
    return every(dirs), every(entries)


class SnapshotStore:
    """Snapshots of file trees below `path`: entries by digest, in `buckets` partitions, and the root of each version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, digest: str) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._table("entries", ENTRIES)

    def add(self, version: str, files: DataFrame) -> int:
        """Store a snapshot (path, hash); gives the number of directories that weren't stored yet.  Entries are written before
        the version's root, so a run that is cut off leaves no version without its entries."""
        dirs, entries = tree_entries(files)
        dirs = cut(dirs, "snapshot-dirs")
        # Of places with one digest one stands for all; what is stored already is left out.
        one = dirs.groupBy("digest").agg(F.min("path").alias("parent")).withColumn("bucket", self._bucket("digest"))
        one = cut(one.join(self.entries().select("digest", "bucket").distinct(), ["digest", "bucket"], "left_anti"), "snapshot-new")
        # Each task of the join writes its own files: brought together by bucket, entries of any number would be in `buckets` tasks.
        rows = entries.join(one, "parent").select("digest", "name", "child", "is_dir", "bucket")
        rows.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/entries")
        root = dirs.where("path = ''").select(F.lit(version).alias("version"), "digest")
        root.coalesce(1).write.mode("append").parquet(f"{self.path}/roots")
        return one.count()

    def root(self, version: str) -> str:
        found = self._table("roots", "version string, digest string").where(F.col("version") == version).select("digest").distinct().take(2)
        if len(found) != 1:
            raise ValueError(f"{len(found)} snapshots have the version {version!r}")
        return found[0][0]

    def children(self, wanted: DataFrame, side: str) -> DataFrame:
        """(path, name, side_child, side_dir) of the directories (path, digest): only their buckets are read."""
        digests = cut(wanted.select("digest").distinct().withColumn("bucket", self._bucket("digest")), "snapshot-wanted")
        buckets = [r[0] for r in digests.select("bucket").distinct().collect()]  # `buckets` numbers at most
        few = digests.count() <= BROADCAST_DIGESTS
        digests = digests.select("digest")
        stored = self.entries().where(F.col("bucket").isin(buckets)) if buckets else self.entries().limit(0)
        stored = stored.join(F.broadcast(digests) if few else digests, "digest", "left_semi")
        # The least of equal rows: a run that was repeated may have stored a directory twice.
        stored = stored.groupBy("digest", "name", "is_dir").agg(F.min("child").alias("child"))
        return wanted.join(stored, "digest").select("path", "name", F.col("child").alias(f"{side}_child"), F.col("is_dir").alias(f"{side}_dir"))

    def diff(self, old: str, new: str) -> DataFrame:
        """path, status of the files that were added, removed or changed from one version to another.

        Goes down a level at a time into directories whose digests differ; a directory of one side only is walked whole, since all
        its files are answers.  A name that was a file and is a directory now is one file removed and those below it added.
        """
        a, b = self.root(old), self.root(new)
        front = self.spark.createDataFrame([("", a, b)] if a != b else [], "path string, a string, b string")
        out = None
        while not front.isEmpty():
            side = lambda c, s: self.children(front.where(F.col(c).isNotNull()).select("path", F.col(c).alias("digest")), s)  # noqa: E731, B023
            left, right = side("a", "a"), side("b", "b")
            # A name may be a file on one side and a directory on the other; the two are different entries.
            x = left.withColumn("is_dir", F.col("a_dir")).join(right.withColumn("is_dir", F.col("b_dir")), ["path", "name", "is_dir"], "full_outer")
            path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
            x = cut(x.where("NOT a_child <=> b_child").select(path.alias("path"), "is_dir", F.col("a_child").alias("a"), F.col("b_child").alias("b")), "snapshot-diff")
            status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
            files = x.where("NOT is_dir").select("path", status.alias("status"))
            out = files if out is None else out.unionByName(files)
            front = x.where("is_dir").select("path", "a", "b")
        return out if out is not None else self.spark.createDataFrame([], "path string, status string")


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files of their customers, in two snapshots: of every 50th customer some orders change, go and come."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x = table(s, d, "orders").select(F.concat_ws("/", (cust % 10).cast("string"), cust.cast("string"), key.cast("string")).alias("path"), key, cust)
    old = x.select("path", key.cast("string").alias("hash"))
    touched = cust % 50 == 0
    same = x.where(~touched | (key % 3 != 1)).select("path", F.when(touched & (key % 3 == 0), F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("hash"))
    more = x.where(touched & (key % 3 == 2)).select(F.concat("path", F.lit("/new")).alias("path"), key.cast("string").alias("hash"))
    return old, same.where(~touched | (key % 3 != 2)).unionByName(more)


def _pruned_diff(s: SparkSession, d: str) -> DataFrame:
    store, (old, new) = SnapshotStore(s, new_path(s, "snapshots")), _versions(s, d)
    store.add("old", old)
    store.add("new", new)
    return store.diff("old", "new")


def _stored_once(s: SparkSession, d: str) -> DataFrame:
    """Entries by level of the two snapshots, those that both have stored once."""
    store = SnapshotStore(s, new_path(s, "snapshots"))
    for name, files in zip(("old", "new"), _versions(s, d), strict=True):
        store.add(name, files)
    return store.entries().groupBy("is_dir").agg(F.count("*").alias("entries"))


_NEW = """f AS (SELECT (o_custkey % 10) || '/' || o_custkey || '/' || o_orderkey AS path, o_orderkey AS k, o_custkey AS c FROM orders),
n AS (SELECT CASE WHEN c % 50 = 0 AND k % 3 = 2 THEN path || '/new' ELSE path END AS path, CASE WHEN c % 50 = 0 AND k % 3 = 0 THEN 'x' || k ELSE CAST(k AS VARCHAR) END AS hash, k, c FROM f WHERE c % 50 <> 0 OR k % 3 <> 1)"""
QUERIES = {"j21_pruned_diff": _pruned_diff, "g14_stored_once": _stored_once}
SQL = {
    "j21_pruned_diff": f"WITH {_NEW} SELECT coalesce(f.path, n.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM f FULL JOIN n ON n.path = f.path WHERE f.path IS NULL OR n.path IS NULL OR n.hash <> CAST(f.k AS VARCHAR)",
    # A directory's entries are stored again where its listing in the new snapshot differs from that in the old one.
    "g14_stored_once": f"""WITH {_NEW}, t AS (SELECT DISTINCT c FROM f WHERE c % 50 = 0), p AS (SELECT DISTINCT c % 10 AS top FROM t)
SELECT FALSE AS is_dir, (SELECT count(*) FROM f) + (SELECT count(*) FROM n WHERE c % 50 = 0 AND k % 3 = 0) + (SELECT count(*) FROM n WHERE c % 50 = 0 AND k % 3 = 2) AS entries
UNION ALL SELECT TRUE, (SELECT count(DISTINCT c % 10) FROM f) + (SELECT count(DISTINCT c) FROM f) + (SELECT count(*) FROM n WHERE c % 50 = 0 AND k % 3 = 2)
 + (SELECT count(DISTINCT c % 10) FROM n WHERE EXISTS (SELECT 1 FROM p)) + (SELECT count(DISTINCT c) FROM n WHERE c % 10 IN (SELECT top FROM p))""",
}
