"""Symbols of Python files, and map-reduce over chunks with a function of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.operators.search import chunks, tokens
from tidelark.sources.stores import cut

SYMBOLS = "path string, name string, kind string, parent string, start_line int, end_line int"


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions, imports and calls of files (path, source); a file that doesn't parse has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for batch in batches:
            rows = []
            for path, source in zip(batch["path"], batch["source"], strict=True):
                try:
                    todo = [(ast.parse(source), "")]
                except (SyntaxError, ValueError, TypeError):
                    continue
                while todo:
                    node, above = todo.pop()
                    for x in ast.iter_child_nodes(node):
                        name = above
                        if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                            rows.append((path, x.name, "class" if isinstance(x, ast.ClassDef) else "function", above, x.lineno, x.end_lineno))
                            name = f"{above}.{x.name}" if above else x.name
                        elif isinstance(x, ast.Import):
                            rows += [(path, a.name, "import", above, x.lineno, x.end_lineno) for a in x.names]
                        elif isinstance(x, ast.ImportFrom):
                            rows.append((path, "." * x.level + (x.module or ""), "import", above, x.lineno, x.end_lineno))
                        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                            rows.append((path, x.func.id, "call", above, x.lineno, x.end_lineno))
                        todo.append((x, name))
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "parent", "start_line", "end_line"])

    return files.select("path", "source").mapInPandas(run, SYMBOLS)


def module_of(path: Column | str) -> Column:
    """Dotted module name of a Python file."""
    return F.translate(F.regexp_replace(F.regexp_replace(C.col(path), r"\.py$", ""), r"/__init__$", ""), "/", ".")


def resolved_imports(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """path, target: the file that each import names, or the module above it; the first by name where several do."""
    wanted = symbols.where("kind = 'import'").select("path", F.col("name").alias("module"))
    wanted = wanted.withColumn("tries", F.array(F.struct(F.lit(0).alias("k"), F.col("module").alias("m")), F.struct(F.lit(1).alias("k"), F.regexp_replace("module", r"\.[^.]*$", "").alias("m"))))
    parts = F.split(module_of("target"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = files.select(F.col("path").alias("target")).select("target", F.explode(tails).alias("m"))
    found = wanted.select("path", "module", F.explode("tries").alias("t")).select("path", "module", "t.k", "t.m").join(ends, "m")
    return found.groupBy("path", "module").agg(F.min_by("target", F.struct("k", "target")).alias("target"))


def chunk_texts(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """doc_id, texts: a document's chunks as an array; a text without tokens has no row."""
    x = docs.select("doc_id", tokens("text").alias("t")).where(F.size("t") > 0)
    part = lambda i: F.array_join(F.transform(F.sequence(i + 1, F.least(i + size, F.size("t"))), lambda k: F.element_at("t", k)), " ")
    return x.select("doc_id", F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(size - overlap)), part).alias("texts"))


def reduced(docs: DataFrame, describe: Callable[[Column], Column], chunk_tokens: int = 512, max_rounds: int = 12) -> DataFrame:
    """One description of each document (doc_id, text): chunks are described and joined until a document is one chunk.

    Chunks are dealt over the tasks, and one table a round is written.  Goes on as long as the open documents together get shorter;
    `max_rounds` rounds on end without that raise.
    """
    done, rest = None, docs.select("doc_id", "text")
    least, stuck = None, 0
    while stuck < max_rounds:
        parts = chunks(rest, chunk_tokens, 0).select("doc_id", "chunk_number", describe(F.col("text")).alias("text"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_number", "text"))), lambda s: s["text"]), " ")
        joined = cut(parts.groupBy("doc_id").agg(F.count("*").alias("n"), joined.alias("text")), "joined")
        ready = joined.where("n = 1").select("doc_id", "text")
        done = ready if done is None else done.unionByName(ready)
        rest = joined.where("n > 1").select("doc_id", "text")
        n, size = rest.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        if n == 0:
            return done
        least, stuck = (size, 0) if least is None or size < least else (least, stuck + 1)
    raise RuntimeError("descriptions don't get shorter")


def described_by_size(docs: DataFrame, alone: Callable[[Column], Column], in_turn: Callable[[Column, Column], Column], gathered: Callable[[Column], Column], chunk_tokens: int = 512, overlap: int = 64, few: int = 5) -> DataFrame:
    """doc_id, way, text: a text of one chunk is described alone; one of 2 to `few` chunk after chunk, each with what came before,
    over chunks that overlap; a longer one from all its chunks at once (an array)."""
    # Texts are parted by their tokens before they are cut, so that no filter on the chunks repeats the cutting.
    n = F.size(tokens("text"))
    part = lambda where, way, text, lap=0: chunk_texts(docs.where(where), chunk_tokens, lap).select("doc_id", F.lit(way).alias("way"), text.alias("text"))
    one = part(n <= chunk_tokens, "alone", alone(F.col("texts")[0]))
    turn = part((n > chunk_tokens) & (n <= few * chunk_tokens), "in turn", F.aggregate("texts", F.lit(""), in_turn), overlap)
    many = part(n > few * chunk_tokens, "gathered", gathered(F.col("texts")))
    return one.unionByName(turn).unionByName(many)


def by_batch(function: Callable[[list[str]], list], kind: str, batch: int = 500) -> Callable[[Column | str], Column]:
    """A column function that gives texts to `function` in lists of at most `batch`, for embeddings, summaries or scores of the
    type `kind`; a null text gives null and isn't passed."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.dropna()
            found = [v for i in range(0, len(known), batch) for v in function(known.iloc[i : i + batch].tolist())]
            yield pd.Series(found, index=known.index, dtype=object).reindex(texts.index)

    return F.pandas_udf(run, kind)


def embedded_chunks(docs: DataFrame, embed: Callable[[list[str]], list], size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, chunk_number, text, vec: the chunks of documents and what `embed` gives for their texts."""
    return chunks(docs, size, overlap).select("doc_id", "chunk_number", "text", by_batch(embed, "array<double>")("text").alias("vec"))


def tagged_scores(items: DataFrame, scores: dict[str, Column], n: int, least: float) -> DataFrame:
    """The n best items of each tag with a score of at least `least`."""
    from tidelark.operators.listing import first_by

    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), c.cast("double").alias("score")) for t, c in scores.items()]))
    x = items.select("id", pairs.alias("s")).select("id", "s.tag", "s.score").where(F.col("score") >= least)
    return first_by(x, ["tag"], F.desc("score"), F.asc("id"), n=n)


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _half(column: Column) -> Column:
    """A stand-in for a model: every second word."""
    return F.array_join(F.transform(F.filter(F.transform(F.split(column, r"\s+"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] % 2 == 0), lambda x: x["w"]), " ")


def _sizes(texts: list[str]) -> list:
    """A stand-in for an embedding: bytes and words."""
    return [[float(len(t.encode())), float(len(t.split()))] for t in texts]


def _lengths(texts: list[str]) -> list:
    """A stand-in for a model's score: longer words are better, up to 1."""
    return [min(1.0, len(t) / (10.0 * max(1, len(t.split(" "))))) for t in texts]


def _by_size(s, d):
    last = lambda c: F.element_at(tokens(c), -1)
    return described_by_size(_docs(s, d), lambda c: F.concat(F.lit("="), c), lambda done, c: F.concat(done, F.lit("|"), last(c)), lambda texts: F.array_join(F.transform(texts, last), " "), 40, 8)


QUERIES = {
    "t3_embedded_chunks": lambda s, d: embedded_chunks(_docs(s, d), _sizes, 100, 20).select("doc_id", "chunk_number", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1")),
    "ud4_text_scores": lambda s, d: _docs(s, d).select("doc_id", by_batch(_lengths, "double")("text").alias("score")),
    "ud6_by_size": _by_size,
    "ud5_map_reduce": lambda s, d: reduced(_docs(s, d), _half, 64),
    "ud7_tagged_scores": lambda s, d: tagged_scores(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "n_chars", "lang"), {"long": F.col("n_chars") / 10000, "english": F.when(F.col("lang") == "en", 1.0).otherwise(0.0)}, 15, 0.5),
}
_WORDS = r"t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents)"
SQL = {
    "t3_embedded_chunks": f"WITH {_WORDS}, s AS (SELECT doc_id, t, unnest(range(0, len(t), 80)) AS i FROM t) SELECT doc_id, CAST(i // 80 AS INT) AS chunk_number, CAST(strlen(array_to_string(t[i + 1:i + 100], ' ')) AS DOUBLE) AS v0, CAST(len(t[i + 1:i + 100]) AS DOUBLE) AS v1 FROM s",
    "ud4_text_scores": "SELECT doc_id, least(1.0, length(text) / (10.0::DOUBLE * greatest(1, len(string_split(text, ' '))))) AS score FROM documents",
    "ud6_by_size": f"""WITH {_WORDS} SELECT doc_id, 'alone' AS way, '=' || array_to_string(t, ' ') AS text FROM t WHERE len(t) BETWEEN 1 AND 40
UNION ALL SELECT doc_id, 'in turn', '|' || array_to_string(list_transform(range(0, len(t), 32), lambda i: t[least(i + 40, len(t))]), '|') FROM t WHERE len(t) BETWEEN 41 AND 200
UNION ALL SELECT doc_id, 'gathered', array_to_string(list_transform(range(0, len(t), 40), lambda i: t[least(i + 40, len(t))]), ' ') FROM t WHERE len(t) > 200""",
    "ud7_tagged_scores": "WITH x AS (SELECT doc_id AS id, 'long' AS tag, n_chars / 10000 AS score FROM documents UNION ALL SELECT doc_id, 'english', CASE lang WHEN 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM documents) SELECT * FROM x WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) <= 15",
    "ud5_map_reduce": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents),
r(doc_id, n, step) AS (SELECT doc_id, len(w), 2 FROM w WHERE len(w) > 0 UNION ALL SELECT doc_id, n - n // 2, step * 2 FROM r WHERE n > 64),
k AS (SELECT doc_id, max(step) AS step FROM r GROUP BY 1)
SELECT k.doc_id, array_to_string(list_transform(range(0, len(w), step), lambda i: w[i + 1]), ' ') AS text FROM k JOIN w ON w.doc_id = k.doc_id""",
}
