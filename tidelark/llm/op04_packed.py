"""Token-id output in fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary's largest id, least significant bit first, so a block of n ids of
width w is n * w / 8 bytes, and id i of it starts at bit i * w: numpy unpacks any range of a block at once.

Documents are dealt to shards by ranges of doc_id and written in ascending order.  A shard is a series of blocks of some
`block_ids` ids, each with whole documents, their doc_ids and their offsets in the block; blocks are rows of a Parquet file
(the block offsets are thus the file's own index and the files can lie in any store that Spark writes to).  Where a shard
begins in the whole sequence follows from the shards' totals, of which there are as many as shards.

Defined cases: a null text counts as empty and has the end id alone; repeated rows of a doc_id are written one after the
other, by text; other columns are ignored; an empty table gives an empty folder and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelark.llm.chunks import word_bpe
from tidelark.llm.shared import documents, new_path, small_batches, text_or_empty, tidy

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, start long, n_ids long, width int, doc_ids array<long>, offsets array<long>, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{width // 8}")[start:stop].astype("<u4")
    first, last = start * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, dtype=np.uint8)[first:last], bitorder="little")[start * width - first * 8 :][: (stop - start) * width]
    return (bits.reshape(-1, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of documents (doc_id, text), each followed by end_id, in ascending order of doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer_path)
        width = width_of(max(vocabulary, end_id + 1))
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype="<u4")
        ids: list[np.ndarray] = []
        doc_ids: list[int] = []
        offsets = [0]

        def full() -> pa.RecordBatch:
            row = [[shard], [block], [start], [offsets[-1]], [width], [doc_ids], [offsets], [pack(np.concatenate(ids), width)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "block", "start", "n_ids", "width", "doc_ids", "offsets", "payload"])

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids += [found, end]
                doc_ids.append(doc_id)
                offsets.append(offsets[-1] + len(found) + 1)
                if offsets[-1] >= block_ids:
                    yield full()
                    block, start, ids, doc_ids, offsets = block + 1, start + offsets[-1], [], [], [0]
        if doc_ids:
            yield full()

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(run), BLOCK_SCHEMA).write.parquet(path)


def shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each shard.  One number for each shard reaches the driver."""
    out, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r.shard):
        out[r.shard] = total
        total += r.n
    return out


def read_packed(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    starts = shard_starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, n = row["offsets"], len(row["doc_ids"])
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"])
                base = starts[row["shard"]] + row["start"]
                parts = [ids[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([base + a for a in offsets[:n]], pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    small_batches(spark)
    return blocks.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Random access: ids start to stop of the whole sequence.

    The totals of the shards tell the shards that hold some of them; the filter on these reaches the scan, so that other shards'
    files are passed over by their statistics, and within them the filter on a block's start does the same.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    starts = shard_starts(blocks)
    ends = dict(zip(starts, [*list(starts.values())[1:], 2**63 - 1], strict=True))
    found = []
    for shard in (s for s in starts if starts[s] < stop and ends[s] > start):
        own = blocks.where((F.col("shard") == shard) & (F.col("start") < stop - starts[shard]) & (F.col("start") + F.col("n_ids") > start - starts[shard]))
        found += own.select((F.col("start") + starts[shard]).alias("base"), "n_ids", "width", "payload").orderBy("base").collect()
    parts = [unpack(r.payload, r.width, max(0, start - r.base), min(r.n_ids, stop - r.base)) for r in found]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def op4_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "packed")
    write_packed(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_packed(spark, path)


QUERIES = {"op4_packed": op4_packed}
SQL: dict[str, str] = {}
