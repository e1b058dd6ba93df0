"""Token ids of whole texts by way of the distinct words of a batch.

Where a tokenizer always cuts a text at certain places, the parts between them are encoded independently.  Arrow splits the
texts of a batch there and numbers the distinct parts; only those are looked up or encoded, and numpy puts every text's ids
together again.  Texts that the rules for a tokenizer don't cover are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that a worker remembers: two generations of so many.
MEMO_PARTS, LONGEST_PART = 200_000, 64
#: Words that are encoded as one line.
LINE_PARTS = 256
#: Text bytes that are handled at a time.
GROUP_BYTES = 8 << 20
#: White space of any kind other than one space or line feed between two other characters.
ODD_SPACES = "[\\t\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z|\\A\\z"


class PartTable:
    """Ids (32-bit, as bytes) by part.  When the young generation is full it becomes the old one."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.young, self.old = encode, {}, {}

    def lookup(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        missing = [i for i, f in enumerate(found) if f is None]
        if not missing:
            return found
        if len(self.young) + len(missing) > MEMO_PARTS:
            self.young, self.old = {}, self.young
        new = []
        for i in missing:
            if (f := self.old.get(parts[i])) is None:
                new.append(i)
            else:
                found[i] = self.young[parts[i]] = f
        for i, ids in zip(new, self.encode([parts[i] for i in new]), strict=True):
            found[i] = ids
            if len(parts[i]) <= LONGEST_PART:
                self.young[parts[i]] = ids
        return found

    def pool(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, ids of each)."""
        ids = self.lookup(parts.to_pylist())
        return np.frombuffer(b"".join(ids), dtype="<i4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)


def ids_of_lists(lists: pa.ListArray, table) -> list[np.ndarray]:
    """The joined ids of each list of parts; `table` has a `pool` as PartTable has."""
    numbered = lists.flatten().dictionary_encode()
    pool, sizes = table.pool(numbered.dictionary)
    index = numbered.indices.to_numpy()
    starts = np.cumsum(sizes) - sizes
    each = sizes[index]
    ends = np.cumsum(each)
    at = np.repeat(starts[index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = pool[at]
    cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _groups(texts: pa.Array, group_bytes: int):
    start, size = 0, 0
    lengths = pc.binary_length(texts).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= group_bytes or i + 1 == len(texts):
            yield texts.slice(start, i + 1 - start)
            start, size = i + 1, 0


class SplitEncoder:
    """Ids of texts; `lists` splits those that `whole` doesn't mark, `encode_text` takes the others."""

    def __init__(self, table, lists: Callable[[pa.Array], pa.ListArray], whole: Callable[[pa.Array], pa.Array] | None, encode_text: Callable[[str], np.ndarray], group_bytes: int = GROUP_BYTES):
        self.table, self.lists, self.whole, self.encode_text, self.group_bytes = table, lists, whole, encode_text, group_bytes

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, none of them null."""
        out: list[np.ndarray] = []
        for group in _groups(texts, self.group_bytes):
            odd = self.whole(group).to_numpy(zero_copy_only=False) if self.whole else np.zeros(len(group), bool)
            ids: list = [None] * len(group)
            plain = np.flatnonzero(~odd)
            if len(plain):
                for i, x in zip(plain, ids_of_lists(self.lists(group.take(pa.array(plain))), self.table), strict=True):
                    ids[i] = x
            for i in np.flatnonzero(odd):
                ids[i] = self.encode_text(group[int(i)].as_py())
            out.extend(ids)
        return out


def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def _encode_with(library, parts: list[str]) -> list[bytes]:
    return [np.array(e.ids, dtype="<i4").tobytes() for e in library.encode_batch_fast(parts, add_special_tokens=False)] if parts else []


def _encode_words(library, ends: np.ndarray, parts: list[str]) -> list[bytes]:
    """Ids of parts; those of letters alone are encoded as lines of many and taken apart behind tokens that end a word."""
    out: list = [None] * len(parts)
    letters = [i for i, p in enumerate(parts) if p.isalpha()]
    rest = [i for i, p in enumerate(parts) if not p.isalpha()]
    lines = [letters[k : k + LINE_PARTS] for k in range(0, len(letters), LINE_PARTS)]
    for line, e in zip(lines, library.encode_batch_fast([" ".join([parts[i] for i in line]) for line in lines], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype="<i4")
        cuts = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        if len(cuts) != len(line):  # a letter that lower-cases to more than letters
            rest.extend(line)
            continue
        data, a = ids.tobytes(), 0
        for i, b in zip(line, cuts, strict=True):
            out[i], a = data[a:b], b
    for i, ids in zip(rest, _encode_with(library, [parts[i] for i in rest]), strict=True):
        out[i] = ids
    return out


def word_bpe(path: str) -> SplitEncoder:
    """For a tokenizer that lower-cases texts and whose pre-tokenizer drops white space and parts letters from other characters:
    texts are cut at spaces and line feeds, and between a letter and the punctuation at the end of a word.

    A-Z are lower-cased beforehand, so that words at the start of sentences are the same parts as elsewhere; a text that may
    hold a special token, which is matched as it stands, is left whole, and so is one with a mark right after a capital: composed
    first, as the library does, it may be another letter than lower-cased first.
    """
    library = _library(path)
    suffix = library.model.end_of_word_suffix
    ends = np.zeros(library.get_vocab_size(), dtype=bool)
    ends[[i for token, i in library.get_vocab().items() if token.endswith(suffix)]] = True

    def lists(texts: pa.Array) -> pa.ListArray:
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        return pc.split_pattern(pc.replace_substring_regex(plain, "([a-z])([.,!?;:]+) ", "\\1 \\2 "), " ")

    return SplitEncoder(PartTable(lambda parts: _encode_words(library, ends, parts)), lists, lambda t: pc.match_substring_regex(t, "<\\||[A-Z]\\pM"), lambda t: np.frombuffer(_encode_with(library, [t])[0], "<i4"))


def byte_bpe(path: str) -> SplitEncoder:
    """For byte-level BPE whose pre-tokenizer puts one space before a word into its token: texts are cut before single spaces
    and line feeds.  A part after a space is looked up without it, the first part of a text with a carriage return before it."""
    library = _library(path)

    def encode(parts: list[str]) -> list[bytes]:
        return _encode_with(library, [p if p[:1] == "\n" else p[1:] if p[:1] == "\r" else " " + p for p in parts])

    def lists(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), ""), " ")

    return SplitEncoder(PartTable(encode), lists, lambda t: pc.match_substring_regex(t, ODD_SPACES), lambda t: np.frombuffer(_encode_with(library, [t])[0], "<i4"))
