"""Line diffs of files between two snapshots.

Two texts are compared by anchors: lines that occur once on either side, in the longest run that keeps both orders.  Between two
anchors the same is done again; where no such line is left, equal lines at both ends are taken off and what remains has been
replaced.  A line that moved is removed and added.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starts of added and removed lines that look like the head of a diff, and don't count.
HEADS = {"+": "++", "-": "--"}
#: Files and bytes of a batch that is sent to Python.
BATCH_ROWS, BATCH_BYTES = 4_096, 4 << 20


def lines_of(text: str) -> list[str]:
    """Lines without their ends; an end of text after a line end begins no line."""
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ascending in the first, that ascends in the second too."""
    tails, at, before = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        tails[k : k + 1], at[k : k + 1] = [b], [i]
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def diff(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """(numbers of the lines of a that are removed, of those of b that are added), ascending."""
    gone, new = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j or k == m:
            gone += range(i, j)
            new += range(k, m)
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: n for n, x in enumerate(b[k:m], k) if once_b[x] == 1 and once_a[x] == 1}
        run = _longest_run([(n, place[x]) for n, x in enumerate(a[i:j], i) if x in place])
        if not run:
            gone += range(i, j)
            new += range(k, m)
            continue
        for p, q in run:
            todo.append((i, p, k, q))
            i, k = p + 1, q + 1
        todo.append((i, j, k, m))
    return sorted(gone), sorted(new)


def _sizes(lines: list[str], sign: str) -> int:
    """Characters of lines, each with one for its end."""
    return sum(len(x) + 1 for x in lines if not x.startswith(HEADS[sign]))


def line_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status, added_lines, removed_lines, added, removed, changed of files (path, text) of two snapshots; paths are unique.

    A file on both sides is modified, or same: `added` and `removed` are the sizes of such lines with their ends, `changed` the size
    of the difference of the two.  A file on one side is added or deleted, and its bytes are what changed.
    """
    a = old.select("path", F.coalesce("text", F.lit("")).alias("old"))
    b = new.select("path", F.coalesce("text", F.lit("")).alias("new"))
    both = a.join(b, "path", "full")
    # Whole texts go to Python: batches are bounded by their bytes.
    both.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    both.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, x, y in zip(batch["path"], batch["old"], batch["new"], strict=True):
                if x is None or y is None:
                    text = x if y is None else y
                    n, size = len(lines_of(text)), len(text.encode())
                    rows.append((path, "deleted", 0, n, 0, size, size) if y is None else (path, "added", n, 0, size, 0, size))
                    continue
                x, y = lines_of(x), lines_of(y)
                gone, put = diff(x, y)
                added, removed = _sizes([y[i] for i in put], "+"), _sizes([x[i] for i in gone], "-")
                rows.append((path, "modified" if gone or put else "same", len(put), len(gone), added, removed, abs(added - removed)))
            yield pd.DataFrame(rows, columns=["path", "status", "added_lines", "removed_lines", "added", "removed", "changed"])

    kind = dict(both.dtypes)["path"]
    return both.mapInPandas(run, f"path {kind}, status string, added_lines long, removed_lines long, added long, removed long, changed long")


def changed_bytes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, changed of files (path, text) of two snapshots."""
    return line_diffs(old, new).select("path", "changed")


def _versions(s, d) -> tuple[DataFrame, DataFrame]:
    """Each document's text, and the next document's as its later version."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("path"), "text"), docs.select((F.col("doc_id") - 1).alias("path"), "text")


def _edited(s, d) -> tuple[DataFrame, DataFrame]:
    """Each document's lines, and those of its later version: without each fifth line, and each seventh twice."""
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(lines, lambda x: x["i"] % 5 != 3)
    text = F.array_join(F.flatten(F.transform(kept, lambda x: F.when(x["i"] % 7 == 6, F.array(x["x"], x["x"])).otherwise(F.array(x["x"])))), "\n")
    return docs, docs.select("path", text.alias("text"))


QUERIES = {
    "a25_changed_bytes": lambda s, d: changed_bytes(*_versions(s, d)),
    "a25_line_diffs": lambda s, d: line_diffs(*_edited(s, d)),
}
_SIZE = "list_sum(list_transform(list_filter(CASE WHEN {t} LIKE '%' || chr(10) THEN string_split({t}, chr(10))[:-2] WHEN {t} = '' THEN [] ELSE string_split({t}, chr(10)) END, lambda x: NOT starts_with(x, '{head}')), lambda x: length(x) + 1))"
SQL = {
    # Lines that both sides have cancel, whatever the diff, unless they begin like the head of one.
    "a25_changed_bytes": f"""WITH o AS (SELECT doc_id AS path, text AS a FROM documents), n AS (SELECT doc_id - 1 AS path, text AS b FROM documents)
SELECT coalesce(o.path, n.path) AS path, CAST(CASE WHEN a IS NULL THEN strlen(b) WHEN b IS NULL THEN strlen(a) ELSE abs(coalesce({_SIZE.format(t="b", head="++")}, 0) - coalesce({_SIZE.format(t="a", head="--")}, 0)) END AS BIGINT) AS changed FROM o FULL JOIN n ON o.path = n.path""",
}
