"""SentencePiece encoding and decoding by a merge-type prefix table.

For each prefix of a segment the last token of its encoding is unique.  The table is filled from left to right: an automaton
over all pieces yields those that end at a position, and the one that may follow the last token of the prefix before it is the
entry; a pair may follow one another if merging their joined text gives the same pair back.  Ids are recovered from the end.
The work is linear in the length of a segment, whatever its length.

A text is cut where no piece can cross: before each run of word marks and around newlines, if the vocabulary allows it.
The distinct segments of a group of texts fill their tables together, position by position over numpy arrays; what a worker
keeps between groups is a bounded table of tested pairs.

Defined cases: a null text counts as empty; an empty text has the end id alone; characters outside the vocabulary become byte
pieces; repeated rows give repeated results; columns other than doc_id and text are ignored (the stage returns doc_id,
n_tokens, both digests and ids) and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2

from tidelark.llm.chunks import SplitEncoder
from tidelark.llm.shared import documents, small_batches, text_or_empty, tidy

MARK = "▁"
#: Pairs that a worker remembers at most.
MEMO_PAIRS = 400_000
#: Text bytes whose segments are encoded together.
GROUP_BYTES = 1 << 20
#: Segments up to this length are filled together, longer ones each by itself.
TOGETHER = 64
SLOT_BITS = 19
_ID, _SPREAD = (1 << 20) - 1, np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Results of a test of pairs (left << 20 | right), so that many are looked up at once: a slot for the pair last asked for
    by hash, and behind them all tested pairs in sorted arrays."""

    def __init__(self, test: Callable[[int, int], bool]):
        self.test, self.keys, self.fits = test, np.zeros(0, np.int64), np.zeros(0, bool)
        self.slots, self.slot_fits = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        out, missing = self.slot_fits[slot], np.flatnonzero(self.slots[slot] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            fits = self._tested(new)
            out[missing] = fits[back]
            slot = slot[missing]
            self.slots[slot] = keys[missing]
            self.slot_fits[slot] = out[missing]
        return out

    def _tested(self, keys: np.ndarray) -> np.ndarray:
        """Results of sorted distinct pairs."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[known] = self.fits[at[known]]
        if not known.all():
            new = keys[~known]
            tested = out[~known] = np.array([self.test(k >> 20, k & _ID) for k in new.tolist()], dtype=bool)
            if len(self.keys) + len(new) > MEMO_PAIRS:
                self.keys, self.fits = new, tested
            else:
                places = np.searchsorted(self.keys, new)
                self.keys, self.fits = np.insert(self.keys, places, new), np.insert(self.fits, places, tested)
        return out


class PrefixTableEncoder:
    """Encodes and decodes as the sentencepiece library does with a BPE model with byte fallback and no normalisation."""

    def __init__(self, model_path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end_id = self.library.eos_id()
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces):
            raise ValueError("pieces cross the places where texts are cut")
        self.names = [p.piece for p in proto.pieces]
        self.sizes = np.array([len(p) for p in self.names], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            if len(piece) > 1:
                self.automaton.add_word(piece, len(piece) << 20 | i)
        self.automaton.make_automaton()
        self.known = {p for p in self.pieces if len(p) == 1}
        self.of_char = np.full(max(map(ord, self.known)) + 2, -1, dtype=np.int64)
        self.of_char[[ord(p) for p in self.known]] = [self.pieces[p] for p in self.known]
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.known)))}])")
        self.pairs = PairTable(self.may_follow)
        self.feed = self.byte_ids[10]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the best adjacent pair again and again gives: the definition, used on one pair at a time."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens, or the start (0) and a token, can stand side by side in an encoding."""
        tokens = [self.names[left], self.names[right]] if left else [self.names[right]]
        return self.merged("".join(tokens)) == tokens

    def known_ids(self, segment: str) -> list[int]:
        """Ids of one segment of characters that all are pieces."""
        last = [0] + [-1] * len(segment)
        tested: dict[int, bool] = {}

        def fill(end: int, size: int, token: int) -> None:
            before = last[end - size]
            if last[end] < 0 <= before:
                pair = before << 20 | token
                if pair not in tested:
                    if len(tested) >= MEMO_PAIRS:
                        tested.clear()
                    tested[pair] = self.may_follow(before, token)
                if tested[pair]:
                    last[end] = token

        done = 0
        for end, value in chain(self.automaton.iter(segment), [(len(segment) - 1, 0)]):
            # Matches come by their end: what ends before this one is either filled by now or a character by itself.
            for i in range(done, end):
                fill(i + 1, 1, self.pieces[segment[i]])
            done = max(done, end)
            if value:
                fill(end + 1, value >> 20, value & _ID)
        if segment:
            fill(len(segment), 1, self.pieces[segment[-1]])
        out, i, names = [], len(segment), self.names
        while i:
            out.append(last[i])
            i -= len(names[last[i]])
        out.reverse()
        return out

    def segment_ids(self, segment: str) -> list[int]:
        if self.known.issuperset(segment):
            return self.known_ids(segment)
        out: list[int] = []
        for k, part in enumerate(self.unknown.split(segment)):
            out.extend([self.byte_ids[b] for b in part.encode()] if k % 2 else self.known_ids(part))
        return out

    def tables(self, joined: str, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Last token by prefix (start of the segment + length of the prefix) of segments joined by line feeds; -1 where there
        is none: behind a character that is no piece, and in segments longer than TOGETHER."""
        last = np.full(len(joined) + 1, -1, dtype=np.int32)
        last[starts] = 0
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        alone = self.of_char[np.minimum(chars, len(self.of_char) - 1)]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64)
        ends, values = found[0::2] + 1, found[1::2]
        own = np.repeat(np.arange(len(starts), dtype=np.int32), lengths + 1)[ends - 1]
        together = lengths[own] <= TOGETHER
        ends, values, own = ends[together], values[together], own[together]
        at = (ends - starts[own]).astype(np.uint8)
        order = np.argsort(at, kind="stable")
        bounds = np.cumsum(np.bincount(at, minlength=TOGETHER + 1))
        open_segments = starts[(lengths > 0) & (lengths <= TOGETHER)]
        limits = (starts + lengths)[(lengths > 0) & (lengths <= TOGETHER)]
        for i in range(1, TOGETHER + 1):
            if not len(open_segments):
                break
            some = order[bounds[i - 1] : bounds[i]]
            end, token = ends[some], values[some]
            before = last[end - (token >> 20)].astype(np.int64)
            reached = before >= 0
            end, token = end[reached], token[reached] & _ID
            fits = self.pairs.lookup(before[reached] << 20 | token)
            last[end[fits]] = token[fits]
            # Where no longer piece fits, the last character may be a token by itself.
            end = open_segments + i
            before, token = last[end - 1].astype(np.int64), alone[end - 1]
            left = (last[end] < 0) & (before >= 0) & (token >= 0)
            end, token = end[left], token[left]
            fits = self.pairs.lookup(before[left] << 20 | token)
            last[end[fits]] = token[fits]
            going = limits > open_segments + i
            open_segments, limits = open_segments[going], limits[going]
        return last

    def ids_of_segments(self, segments: pa.Array, feeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments one after the other, ids of each): segments without line feeds; one goes before where `feeds` says so."""
        lengths = pc.utf8_length(segments).to_numpy().astype(np.int64)
        n = len(segments)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), segments), "\n")[0].as_py() if n else ""
        last = self.tables(joined, starts, lengths) if n else np.zeros(0, np.int32)
        at = starts + lengths
        alone = np.flatnonzero(last[at] < 0) if n else np.zeros(0, np.int64)
        by_itself = [np.array(self.segment_ids(joined[starts[i] : at[i]]), dtype=np.int32) for i in alone.tolist()]
        counts, turns = np.zeros(n, dtype=np.int64), []
        open_ = lengths > 0
        open_[alone] = False
        open_ = np.flatnonzero(open_)
        while len(open_):
            token = last[at[open_]]
            turns.append((open_, token))
            counts[open_] += 1
            at[open_] -= self.sizes[token]
            open_ = open_[at[open_] > starts[open_]]
        counts[alone] = [len(x) for x in by_itself]
        sizes = counts + feeds
        begin = np.cumsum(sizes) - counts
        pool = np.full(int(sizes.sum()), self.feed, dtype="<i4")
        for turn, (which, token) in enumerate(turns):
            pool[begin[which] + counts[which] - 1 - turn] = token
        for i, ids in zip(alone.tolist(), by_itself, strict=True):
            pool[begin[i] : begin[i] + len(ids)] = ids
        return pool, sizes

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids of any text."""
        text = self.prefix + text.replace(" ", MARK) if text else ""
        segments = re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", text)
        feeds = np.array([x == "\n" for x in segments], dtype=np.int64)
        return self.ids_of_segments(pa.array(["" if x == "\n" else x for x in segments], pa.string()), feeds)[0]

    def pool(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts between single spaces; one that begins with a line feed has no mark."""
        feeds = pc.starts_with(parts, "\n")
        segments = pc.if_else(feeds, pc.utf8_slice_codeunits(parts, 1), pc.binary_join_element_wise(MARK, parts, ""))
        return self.ids_of_segments(segments, feeds.to_numpy(zero_copy_only=False).astype(np.int64))

    def splitter(self) -> SplitEncoder:
        def lists(texts: pa.Array) -> pa.ListArray:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

        def odd(texts: pa.Array) -> pa.Array:
            return pc.match_substring_regex(texts, f"{MARK}|  |\n | \n|\\A |\\A\n| \\z|\\A\\z")

        return SplitEncoder(self, lists, odd if self.prefix else lambda t: pc.is_valid(t), self.encode_whole, GROUP_BYTES)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, text), with ids and the decoded text if asked for."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixTableEncoder(model_path)
        splitter = encoder.splitter()
        decimal = [str(i) for i in range(encoder.library.vocab_size())]
        for batch in batches:
            arrays, sizes, pieces_sha, text_sha, texts = [], [], [], [], []
            for found in splitter.encode_all(batch.column(1)):
                found = np.append(found, np.int32(encoder.end_id))
                ids = found.tolist()
                decoded = encoder.decode(ids)
                sizes.append(len(ids))
                pieces_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    arrays.append(found)
                if keep_text:
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pieces_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                flat = pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32())
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes)], pa.int32()), flat)], [*names, "ids"]
            if keep_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.record_batch(columns, names=names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(tidy(run), schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, every document's ids and their digests; the other columns end here."""
    return encode_documents(docs, model_path(), keep_ids=True)


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), model_path())


QUERIES = {"op2_pieces": op2_pieces}
SQL: dict[str, str] = {}
