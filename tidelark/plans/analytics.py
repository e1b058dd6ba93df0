"""The analytics run: commits and file changes in, aggregates and marts out, in full or since the last run.

One job graph takes the place of extract, merge and aggregate phases.  Commits are stored by run, under their keys
(repository, branch, sha), so an incremental run takes up whatever the source has and the runs before haven't, however old it
is; a run with nothing new and no branch gone does nothing.  Where a branch has lost commits (its history was rewritten) or the
state is of another version, an incremental run is a full one.  Branches that have gone stay with their last values until they
appear again.

A run counts when its state is written, after everything else.  One that dies before leaves folders of its number, which the
next run replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelark.operators import aggregates as A
from tidelark.operators.usage import tombstones
from tidelark.sources.stores import ParquetStore, Versions, cut, delete, exists, write_json

STATE_VERSION = "2"
KEY = ["codebase_id", "branch_name", "commit_sha"]


@dataclass
class Outcome:
    """What a run did."""

    new_commits: int
    skipped: bool
    tables: dict[str, str]


class AnalyticsRun:
    def __init__(self, spark: SparkSession, root: str, repository: str):
        self.spark, self.store, self.repository = spark, ParquetStore(spark, root), repository

    def _place(self, name: str) -> str:
        return self.store.place(self.repository, name)

    def read(self, name: str) -> DataFrame | None:
        """A table of the last run; None before the first."""
        return Versions(self.spark, self._place(name)).read()

    def state(self):
        """version, first, run, commits of the last finished run; its commits are those of the runs from first on."""
        found = self.read("state")
        return found.first() if found is not None else None

    def _of_runs(self, name: str, schema: StructType, first: int, last: int) -> DataFrame:
        place = self._place(name)
        if not exists(self.spark, place):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("run", LongType())])).parquet(place)
        return rows.where(F.col("run").between(first, last)).drop("run")

    def run(self, commits: DataFrame, changes: DataFrame, as_of: Column, incremental: bool = False) -> Outcome:
        """commits and changes hold what the source has."""
        last = self.state()
        number = last.run + 1 if last else 1
        goes_on = incremental and last is not None and last.version == STATE_VERSION
        current = cut(commits.select("codebase_id", "branch_name").distinct(), "branches")
        taken = self._of_runs("commits", commits.schema, last.first, last.run) if goes_on else commits.limit(0)
        if goes_on:
            there = taken.join(current, ["codebase_id", "branch_name"], "left_semi")
            goes_on = there.join(commits.select(*KEY), KEY, "left_anti").isEmpty()
        first = last.first if goes_on else number
        new = cut(commits.join(taken.select(*KEY), KEY, "left_anti") if goes_on else commits, "new-commits")
        count = new.select("commit_sha").distinct().count()
        known = self.read("branches") if incremental else None
        gone = known is not None and not known.where("NOT is_deleted").join(current, ["codebase_id", "branch_name"], "left_anti").isEmpty()
        if goes_on and count == 0 and not gone:
            return Outcome(0, True, {})
        shas = new.select("commit_sha").distinct()
        shas = shas.join(taken.select("commit_sha"), "commit_sha", "left_anti") if goes_on else shas
        for name, rows in (("commits", new), ("file_changes", changes.join(shas, "commit_sha", "left_semi"))):
            rows.write.mode("overwrite").parquet(f"{self._place(name)}/run={number}")
        every = self._of_runs("commits", commits.schema, first, number)
        files = self._of_runs("file_changes", changes.schema, first, number)
        branches = A.branch_metrics(every).join(current, ["codebase_id", "branch_name"], "left_semi")
        branches = branches.withColumn("branch", F.concat_ws("/", "codebase_id", "branch_name"))
        previous = known.drop("is_deleted") if known is not None else branches.limit(0)
        tables = {
            "repository": A.repository_summary(every),
            "daily": A.daily_rollup(every),
            "monthly": A.monthly_rollup(every),
            "branches": tombstones(previous, branches),
            "contributors": A.contributors(every, as_of),
            "ownership": A.directory_ownership(files, every),
        }
        places = {name: Versions(self.spark, self._place(name)).write(df) for name, df in tables.items()}
        self._marts(as_of)
        counts = every.agg(F.lit(STATE_VERSION).alias("version"), F.lit(first).cast("long").alias("first"), F.lit(number).cast("long").alias("run"), F.countDistinct("commit_sha").alias("commits"))
        Versions(self.spark, self._place("state")).write(counts)
        for name in ("commits", "file_changes"):
            for old in range(last.first if last else number, first):
                delete(self.spark, f"{self._place(name)}/run={old}")
        return Outcome(count, False, places)

    def _marts(self, as_of: Column) -> None:
        """JSON for readers: overview, branches with status, activity of the last 365 days with commits, ownership by directory."""
        branches = self.read("branches").withColumn("is_merged", F.col("unique_commits") == 0)
        activity = F.row_number().over(Window.partitionBy("codebase_id").orderBy(F.desc("day")))
        by_directory = self.read("ownership").groupBy("directory", "contributors").agg(F.sum("churn_sloc").alias("churn_sloc"), F.array_sort(F.collect_list(F.struct("rank", "author_email", "churn_sloc", "share"))).alias("top"))
        marts = {
            "overview": self.read("repository"),
            "branch_list": branches.withColumn("status", A.branch_status(branches, as_of)),
            "activity": self.read("daily").withColumn("n", activity).where("n <= 365").drop("n"),
            "ownership_tree": by_directory,
        }
        for name, df in marts.items():
            write_json(df, self._place(f"marts/{name}"))
