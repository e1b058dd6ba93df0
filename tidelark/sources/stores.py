"""Parquet, keyed, chunked, JSON, document and archive stores.

Everything is written and read by Spark, so any file system that Spark reaches will do.
"""

from __future__ import annotations

import functools
import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelark.operators.usage import insert_ignore, upsert

CHUNK_NAME = "chunk_%05d"
#: Rows of one task, where a step's memory goes with its rows.
TASK_ROWS = 250_000


@functools.cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="tidelark-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used before, in the folder that spark.checkpoint.dir names; a temporary one only on one machine
    where that is unset (tests)."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _own_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/tidelark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, per_task: int = TASK_ROWS) -> int:
    """Tasks to spread rows over by `repartition`, so that the memory of one doesn't grow with the table.  Left to itself, Spark
    joins small shuffle blocks until they fill a task, by their size before a join or a sort makes more of them."""
    return max(1, math.ceil(rows / per_task))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


class Versions:
    """A table that is replaced whole: each version is a folder of its own, and the newest that Spark has finished counts.

    A crash leaves an unfinished folder that the next write replaces; the version before the newest stays for its readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, number: int) -> str:
        return f"{self.path}/version-{number:010d}"

    def _numbers(self) -> list[int]:
        found = [int(n.removeprefix("version-")) for n in names(self.spark, self.path) if n.startswith("version-")]
        return [n for n in found if exists(self.spark, f"{self._place(n)}/_SUCCESS")]

    def current(self) -> str | None:
        found = self._numbers()
        return self._place(found[-1]) if found else None

    def read(self, schema: StructType | None = None) -> DataFrame | None:
        """None where nothing has been written."""
        place = self.current()
        if place is None:
            return None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(place)

    def write(self, df: DataFrame) -> str:
        found = self._numbers()
        place = self._place(found[-1] + 1 if found else 1)
        df.write.mode("overwrite").parquet(place)
        for n in found[:-1]:
            delete(self.spark, self._place(n))
        return place


def require_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns, cast to its types; a null in a column that has none fails the job when it is met."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def checked(f) -> Column:
        c = F.col(f.name).cast(f.dataType)
        return c.alias(f.name) if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType)).alias(f.name)

    return df.select(*map(checked, schema))


class ParquetStore:
    """Tables by repository and name under a root, plain or in partitions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def place(self, repository: str, name: str) -> str:
        return f"{self.root}/{repository}/{name}"

    def write(self, df: DataFrame, repository: str, name: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
        """With partitions, only those that df holds are replaced."""
        w = df.write.mode(mode).option("compression", "snappy")
        if partition_by:
            w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
        w.parquet(self.place(repository, name))

    def append(self, df: DataFrame, repository: str, name: str) -> None:
        df.write.mode("append").parquet(self.place(repository, name))

    def read(self, repository: str, name: str, schema: StructType, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """An empty table where nothing has been written; filters and columns reach the scan."""
        path = self.place(repository, name)
        df = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        df = df.where(where) if where is not None else df
        return df.select(*columns) if columns else df

    def repositories(self) -> list[str]:
        return [n for n in names(self.spark, self.root) if n.isdigit() or n.count("-") == 4]

    def delete(self, repository: str) -> bool:
        return delete(self.spark, f"{self.root}/{repository}")


class KeyedStore:
    """A table with a key, written as a new version by each change."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.versions, self.schema, self.keys = spark, Versions(spark, path), schema, keys

    def read(self) -> DataFrame:
        found = self.versions.read(self.schema)
        return self.spark.createDataFrame([], self.schema) if found is None else found

    def _replace(self, df: DataFrame) -> None:
        self.versions.write(df.select(*self.schema.names))

    def upsert(self, rows: DataFrame, version: str) -> None:
        self._replace(upsert(self.read(), rows, self.keys, version))

    def insert_ignore(self, rows: DataFrame) -> None:
        self._replace(insert_ignore(self.read(), rows, self.keys))

    def delete(self, where: Column) -> None:
        self._replace(self.read().where(~F.coalesce(where, F.lit(False))))

    def compact(self, files: int) -> None:
        self._replace(self.read().coalesce(files))


class ChunkStore:
    """Append-only numbered chunks and their merge into one sorted or partitioned table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{CHUNK_NAME % number}")

    def chunks(self, start: int = 0, limit: int | None = None) -> list[str]:
        return names(self.spark, self.root)[start:][:limit]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunk_*")

    def merge_sorted(self, path: str, *order: str) -> None:
        """A range sort: files follow one another in the order."""
        self.read().orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)

    def merge_partitioned(self, path: str, column: str) -> None:
        """Rows of a partition value meet before the write; a large one is dealt over several tasks."""
        self.read().hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)

    def delete_all(self) -> int:
        found = self.chunks()
        delete(self.spark, self.root)
        return len(found)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """None where nothing has been written; rows that are no JSON are nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path) if exists(spark, path) else None


def walk(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, length, content of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        files = files.where(F.regexp_like("path", F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")))
    return files.select("path", "length", "content")


#: Format of the exports that git_log reads: `git log --numstat --format=...`.
GIT_LOG_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cI%x1f%s"


def git_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, changes) of Git history exported as text in GIT_LOG_FORMAT; a commit that several exports hold is one.

    commits: commit_sha, parents, author, author_email, committed_at, message.  changes: commit_sha, file_path, additions_lines,
    deletions_lines (null for binary files); a renamed file counts under its new path.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path)
    head = F.split(F.substring_index("value", "\n", 1), "\x1f")
    x = raw.select(head.alias("h"), "value").where((F.size("h") >= 6) & (F.col("h")[0] != ""))
    x = x.select(F.col("h")[0].alias("commit_sha"), "h", "value")
    found = x.select("commit_sha", F.filter(F.split(F.col("h")[1], " "), lambda p: p != "").alias("parents"), F.col("h")[2].alias("author"), F.col("h")[3].alias("author_email"), F.try_to_timestamp(F.col("h")[4]).alias("committed_at"), F.array_join(F.slice("h", 6, F.size("h")), "\x1f").alias("message"))
    line = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    lines = x.dropDuplicates(["commit_sha"]).select("commit_sha", F.explode(F.split("value", "\n")).alias("line")).where(F.regexp_like("line", F.lit(line)))
    new_name = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", line, 3), r"\{[^{}]* => ([^{}]*)\}", "$1"), "^.* => ", "")
    count = lambda k: F.expr(f"try_cast(split(line, '\\t')[{k}] AS long)")
    changes = lines.select("commit_sha", F.replace(new_name, F.lit("//"), F.lit("/")).alias("file_path"), count(0).alias("additions_lines"), count(1).alias("deletions_lines"))
    return found.dropDuplicates(["commit_sha"]), changes


def paged_log(spark: SparkSession, path: str, entry: StructType | str, after: str | int | None = None, kinds: list[str] | None = None, stream: bool = False) -> DataFrame:
    """Entries of log pages, each line of the files one page (a JSON array of entries): those after a cursor (the last log_id
    taken), of the given types.  Pages overlap where entries came in between, so an entry counts once; a line that is no page has
    none.  As a stream, the files' order is that of the pages, and checkpoints keep the place instead of the cursor."""
    reader = spark.readStream if stream else spark.read
    kind = entry if isinstance(entry, str) else entry.simpleString()
    x = reader.text(path).select(F.explode(F.from_json("value", f"array<struct<{kind}>>" if isinstance(entry, str) else f"array<{kind}>")).alias("e")).select("e.*").where("log_id IS NOT NULL")
    x = x.where(F.col("log_id") > F.lit(after)) if after is not None else x
    x = x.where(F.col("type").isin(kinds)) if kinds is not None else x
    return x.dropDuplicates(["log_id"])


def next_cursor(entries: DataFrame) -> str | int | None:
    return entries.agg(F.max("log_id")).first()[0]


def archive_members(files: DataFrame) -> DataFrame:
    """path, member, size, content of the members of zip files (path, content), without resource forks; a broken file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, i.filename, i.file_size, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX")]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "size", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, content binary")


def page_text(html: Column | str) -> Column:
    """The text of a page: no scripts, styles, comments or tags; the common entities as characters."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    h = F.regexp_replace(h, r"(?i)<(?:/p|/li|/h[1-6]|/tr|/div|br)\b[^>]*>", "\n")
    h = F.regexp_replace(h, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(h, r"[ \t\r]+", " "), r" *\n[ \n]*", "\n"), F.lit(" \n"))


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title>(.*?)</title>", 1))
