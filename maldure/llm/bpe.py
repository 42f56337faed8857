"""Encoding of a whole corpus with a public byte-pair vocabulary, by prefix-sharing trie traversal.

The encoding of a prefix is known by its last token: token ``t`` ends the encoding of a prefix exactly if it is a suffix
of it and fits behind the last token of what comes before, that is, if the two tokens' bytes together encode to just
these two. The distinct words of a batch are the paths of a trie. It is walked depth first (the words in sorted order,
the path's states on a stack), so the state of every shared prefix is computed once; a word's ids are then read from its
end back to its start. Nothing is shuffled: each task shares the prefixes of its own rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published pattern by which this family of tokenizers splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers, and bytes of text whose words are walked together.
REMEMBERED = 300_000
LONG_WORD = 2_000


class TrieEncoder:
    """Encodes words by walking the trie of their bytes."""

    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        lengths: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                lengths.setdefault(token[-2:], {1}).add(len(token))
        #: By the last two bytes, the lengths of the tokens that end so, the longest first.
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in lengths.items()}
        self.fit: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, bytes] = {}  # of each word, as 32-bit integers
        self.split = regex.compile(PATTERN)

    def merged(self, text: bytes) -> list[int]:
        """Plain byte-pair encoding of a short text: always the pair of least rank first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes."""
        known = self.fit.get((a, b))
        if known is None:
            known = self.fit[(a, b)] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def walk(self, words: list[str]) -> None:
        """Remember the ids of the words, which are distinct and new."""
        ranks, fits, lengths, one = self.ranks, self.fits, self.lengths, (1,)
        before, last, size = b"", [-1], [0]
        for path, word in sorted((w.encode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(before), len(path))
            if before[:most] == path[:most]:
                shared = most
            else:
                while before[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(path) + 1):
                for n in lengths.get(path[end - 2 : end], one) if end > 1 else one:
                    if n > end:
                        continue
                    token = ranks.get(path[end - n : end])
                    if token is not None and (n == end or fits(last[end - n], token)):
                        last.append(token)
                        size.append(n)
                        break
            at, ids = len(path), []
            while at:
                ids.append(last[at])
                at -= size[at]
            self.ids[word] = array("i", reversed(ids)).tobytes()
            before = path

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after another; none for empty and null ones. Words are joined, not ids."""
        split = [self.split.findall(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            new = set(chain.from_iterable(split))
        self.walk(list(new))
        ids = self.ids
        out = [b"".join(map(ids.__getitem__, words)) for words in split]
        for word in [w for w in new if len(w) > LONG_WORD]:
            del ids[word]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for empty and null ones."""
        return [array("i", x).tolist() for x in self.encoded(texts)]


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes) -> TrieEncoder:
    """One encoder per Python worker and vocabulary."""
    return TrieEncoder(vocabulary)


#: Rows encoded at once: bounds what a task holds.
ROWS = 512


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, sent once to each executor; its size is fixed (under a megabyte)."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The token ids of every text, without special tokens. Columns: key, ids.

    Null and empty texts have an empty list; blank texts are encoded as they are; whole texts are encoded, of
    any length; repeated keys keep their rows.
    """
    held = _vocabulary(df, vocabulary)
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = own.encoded(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """As encode_corpus, with the number of ids only. Columns: key, tokens (int)."""
    held = _vocabulary(df, vocabulary)
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n = [len(x) // 4 for x in own.encoded(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, type=pa.int32())], names=[key, "tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens int")
