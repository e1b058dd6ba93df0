"""Document fingerprints by SpotSigs.

A text is lower-cased and cut into words of letters and digits.  Common words are anchors; the chain of the three content words
that follow an anchor is a spot signature.  Two kinds of anchor are added to the method's: the start of a text, and a content
word whose hash is a multiple of `RARE`; they keep texts of names, numbers or other languages from having no signatures.  A fingerprint is the sorted
set of the signatures' 32-bit hashes, written as eight hexadecimal digits each; likeness is the Jaccard similarity of two sets.

`similar_pairs` finds pairs in a collection (query `spotsigs_pairs`): sets are partitioned by length so that only partitions whose lengths allow the
similarity meet, and within them the rarest signatures of a set are looked up only, as many as the similarity needs.

Neighbours in the order of doc_id are found without a global sort of texts: ids fall into ranges of `RANGE`, the first document
of each range is also sent to the range before it, and one window works on each range.  The range before each is found among
the ranges' numbers, which are sorted in parts, and across parts by their last numbers.

Only DataFrame functions are used.  Defined cases: a null text counts as empty; an empty text has the one signature of an
empty word, so equal texts always have likeness 1; rows that repeat a doc_id are ordered by text; a null doc_id comes first,
also as a class that only such rows have (its class_id is null);
the document after the last is the first; other columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.shared import cut, documents, text_or_empty

#: Ids in a range, and range heads that are broadcast at most.
RANGE, BROADCAST_HEADS = 256, 100_000
CHAIN, RARE = 3, 16
#: Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his in is it its not of on or said she that the their there they
this to was were which will with you
au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas pour que qui se son sur un une
als auch auf aus bei das dem den der die ein eine einen er es hat ich im ist mit nach nicht sich sie sind und von war wie zu zum
al como con del el las lo los más no para pero por si sin su una y
""".split()


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signature hashes of a text, as an array of long.

    Lambda variables bind each array: an expression used inside a lambda would be evaluated for each element.
    """
    is_anchor = lambda w: w.isin(ANCHORS)
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " ")), " ")

    def parts(w: Column) -> Column:
        anchors = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: is_anchor(F.get(w, i - 1)))
        return F.named_struct(F.lit("anchors"), anchors, F.lit("content"), F.filter(w, lambda x: ~is_anchor(x)))

    def found(p: Column) -> Column:
        content = p["content"]
        # The kth anchor (from 0) at word i (from 1) has i - 1 - k content words before it: its chain starts there.
        after_anchors = F.transform(p["anchors"], lambda i, k: i - 1 - k)
        rare = F.array_compact(F.transform(content, lambda x, j: F.when(F.xxhash64(x) % RARE == 0, j + 1)))
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), after_anchors, rare))
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(content, i + j) for j in range(CHAIN))).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.array_sort(F.array_distinct(hashes))

    return F.transform(F.transform(F.array(words), parts), found)[0]


def written(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of documents (doc_id, text)."""
    return docs.select("doc_id", F.length(text_or_empty()).cast("long").alias("n_chars"), written(signatures(text_or_empty())).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs and those of the document after it, next_text and next_sigs."""
    order_id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", text_or_empty().alias("text"), order_id.alias("o")).withColumn("range", F.expr(f"o div {RANGE} - if(o % {RANGE} < 0, 1, 0)"))
    heads = rows.groupBy("range").agg(F.min("o").alias("o"))
    # The range before each: within parts of the sorted ranges, then across parts, of which there are as many as partitions.
    heads = cut(heads.repartitionByRange("range").withColumn("part", F.spark_partition_id()), "heads")
    within = heads.withColumn("before", F.lag("range").over(Window.partitionBy("part").orderBy("range")))
    parts = heads.groupBy("part").agg(F.max("range").alias("last"))
    final = heads.agg(F.max("range")).first()[0]
    edges = parts.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.lit(final)).alias("edge"))
    heads = cut(within.join(edges, "part").select("o", F.coalesce("before", "edge").alias("before")), "heads-before")
    if heads.count() <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    own = F.struct(F.lit(False).alias("copy"), F.col("range"))
    sent = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.lit(True).alias("copy"), F.col("before").alias("range"))))
    rows = rows.join(heads, "o", "left").select("doc_id", "o", "text", signatures(F.col("text")).alias("sigs"), F.explode(sent).alias("at")).select("doc_id", "o", "text", "sigs", "at.*")
    order = Window.partitionBy("range").orderBy("copy", "o", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).where("not copy").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, with the likeness to those and to the next document's."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    k = F.expr("cast(n_chars div 4 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring("next_text", F.lit(1), k))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "edited", F.col("sigs").alias("s"), signatures(F.col("edited")).alias("e"), F.col("next_sigs").alias("x"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("s")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("x")).alias("near_next"))


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): u, v, likeness of class representatives, and doc_id, class_id of all documents.

    Documents with equal fingerprints form a class, which its smallest doc_id stands for.
    """
    sets = docs.select("doc_id", signatures(text_or_empty()).alias("sigs"))
    sets = cut(sets.withColumn("print", F.md5(written(F.col("sigs")))), "spot-sets")
    classes = cut(sets.groupBy("print").agg(F.min("doc_id").alias("class_id")), "spot-classes")
    members = sets.join(classes, "print").select("doc_id", "class_id")
    unique = cut(sets.join(classes, "print").where("doc_id = class_id").dropDuplicates(["class_id"]).select("class_id", "sigs", F.size("sigs").alias("n")), "spot-unique")
    spots = unique.select("class_id", "n", F.explode("sigs").alias("h"))
    common = cut(spots.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "spot-counts")
    own = Window.partitionBy("class_id")
    placed = spots.join(common, "h").withColumn("i", F.row_number().over(own.orderBy("c", "h"))).withColumn("k", F.count("*").over(own))
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    prefix = cut(placed.where(F.col("i") <= F.col("k") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("h", "class_id", "n", part.alias("part"), (F.col("k") - F.col("i") + 1).alias("rest")), "spot-prefix")
    probe = prefix.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))).select("h", "part", F.col("class_id").alias("a"), F.col("n").alias("an"), F.col("rest").alias("arest"))
    enough = F.least("rest", "arest") >= (F.col("n") + F.col("an")) * (threshold / (1 + threshold)) - 1e-9
    shorter = (F.col("an") < F.col("n")) | ((F.col("an") == F.col("n")) & (F.col("a") < F.col("class_id")))
    pairs = probe.join(prefix, ["h", "part"]).where(shorter & (F.col("an") >= F.col("n") * threshold - 1e-9) & enough).select("a", F.col("class_id").alias("b")).distinct()
    pairs = cut(pairs, "spot-pairs")
    left, right = (unique.select(F.col("class_id").alias(c), F.col("sigs").alias(f"{c}s")) for c in ("a", "b"))
    close = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("as"), F.col("bs"))).where(F.col("likeness") >= threshold)
    return close.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "likeness"), members


def linked(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links of documents (doc_id, text): the class of equal fingerprints and the classes similar to it."""
    pairs, members = similar_pairs(docs, threshold)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


def spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


QUERIES = {"op10_spotsigs": op10_spotsigs, "spotsigs_pairs": spotsigs_pairs}
SQL: dict[str, str] = {}
