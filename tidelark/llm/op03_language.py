"""Language ID by compression.

Each language has a zstandard raw-content dictionary of its own text.  A text is compressed with each; the language whose
dictionary leaves the fewest bytes is predicted, and the prediction is rejected when the runner-up is as good or nearly so.

The dictionaries are the whole model.  They are fitted on a bounded sample of the labelled rows: of each language the
`sample_docs` documents with the smallest hashed id, an excerpt of `excerpt_chars` of each, joined up to `dict_bytes`.
Prediction reads every text whole.  Texts of equal size under several dictionaries, which happens to short ones, are
compressed again with four bytes a character, where a match of two characters already pays.

Defined cases: a null text or one without a letter (Unicode category L) is `und` with score 0 and is rejected; sizes that are
equal in both encodings go to the language with most labelled rows, then by name, and are rejected; rows with null lang are
predicted but not learned from; without any labelled row everything is `und`; more than `max_languages` labels are an error;
repeated rows give repeated results (and repeated samples), other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.shared import documents, small_batches, tidy

LEVEL, DICT_BYTES, SAMPLE_DOCS, EXCERPT_CHARS, MAX_LANGUAGES = 9, 250_000, 400, 2_000, 200
#: Level of the second encoding, and the size of text that its tables are laid out for, which bounds their memory.
WIDE_LEVEL, WIDE_SOURCE = 9, 1 << 16
#: Below this share of the runner-up's size a lead is narrow.
MIN_MARGIN = 0.002
_LETTER = regex.compile(r"\p{L}")
#: ASCII characters other than letters become spaces.
_ASCII = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """What is compressed: lower case, digits and ASCII punctuation as spaces."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_ASCII) + b" "


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, excerpt_chars: int = EXCERPT_CHARS, dict_bytes: int = DICT_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """Raw dictionaries by language, most labelled rows first.  What reaches the driver is bounded by the parameters."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # A hash bound that four times the sample's rows of a language are below: what is shuffled doesn't grow with the input.
    bound = F.lit(0)
    for r in counts:
        bound = F.when(F.col("lang") == r.lang, min(2**62, 4 * sample_docs * 2**62 // r["count"])).otherwise(bound)
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    hashed = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).where(F.col("h") <= bound)
    rows = hashed.select("lang", "doc_id", "h", F.substring("text", 1, excerpt_chars).alias("t")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs).select("lang", "k", "t").collect()
    texts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.k):
        texts.setdefault(r.lang, []).append(plain(r.t))
    return {r.lang: b"".join(texts.get(r.lang, []))[:dict_bytes] for r in counts}


def narrow(raw: bytes) -> zstandard.ZstdCompressor:
    """Compressor of the first encoding with a raw dictionary."""
    words = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def wide(raw: bytes) -> zstandard.ZstdCompressor:
    """Compressor of the second encoding with the same dictionary."""
    raw = raw.decode("utf-8", "ignore").encode("utf-32-le").ljust(8)
    words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(WIDE_LEVEL, source_size=WIDE_SOURCE, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
    words.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)


class Classifier:
    """Sizes of a text under each language's dictionary; equal ones are decided by the second encoding."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = {k: narrow(v) for k, v in dictionaries.items()}
        self._dictionaries = dictionaries

    @functools.cached_property
    def wide(self) -> dict[str, zstandard.ZstdCompressor]:
        return {k: wide(v) for k, v in self._dictionaries.items()}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); the margin is the lead over the runner-up as a share of the runner-up's size."""
        if text is None or not self.compressors or not _LETTER.search(text):
            return "und", 0.0, 0.0
        data = plain(text)
        sizes = [len(c.compress(data)) for c in self.compressors.values()]
        if sizes.count(min(sizes)) > 1:
            data = data.decode("utf-8", "replace").encode("utf-32-le")
            sizes = [len(c.compress(data)) for c in self.wide.values()]
        best = min(sizes)
        lang = list(self.compressors)[sizes.index(best)]
        rest = sorted(sizes)[1:2]
        margin = (rest[0] - best) / rest[0] if rest else 1.0
        return lang, 1 / sum(math.exp(max(-700.0, (best - s) / 4)) for s in sizes), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row of (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column(2)]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x < min_margin for x in margin], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose prediction is rejected go; the lang of the others is the predicted one."""
    small_batches(spark)
    dictionaries = fit(docs)
    at, names = docs.columns.index("text"), docs.columns
    lang_at = names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.predict(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([x[0] for x in found], pa.string()) if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, names=names).filter(pa.array([x[2] >= MIN_MARGIN for x in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))


QUERIES = {"op3_language": op3_language}
SQL: dict[str, str] = {}
