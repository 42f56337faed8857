"""Text garbled by a wrong decoding: find it and restore it.

A chain says how a text was garbled: its bytes, in the ``right`` encoding, were read in the ``wrong`` one. Undoing a chain
encodes each word in the wrong encoding and decodes it strictly in the right one. Every candidate that this gives is
compressed with a dictionary of each language (zstandard); the one of least description length, the chain's own cost
included, is taken, and undone again as long as that pays (text garbled twice). Loss is a chain too: beside the rest of the text it
costs a byte for each replacement character or control, where the unchanged text pays for characters that no undoubted
text has. Otherwise the text stays. A candidate counts only if what it decodes to consists of characters that the corpus's
undoubted texts have.

All dictionaries are trained on the whole corpus: Korean and English on the values of keyboard characters only, those of other
scripts on the values that have characters beyond these, but none that any chain can undo or that was lost. Every pair of
adjoining pieces (a word, two digits, signs) of all these values is counted; a dictionary is trained on lines that have the pairs
that cover most bytes, one for each of its own bytes, in proportion to their counts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import groupby
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maldure.tables import checkpoint

if TYPE_CHECKING:
    import pandas as pd

DICTIONARY_BYTES = 16384
#: The text that a dictionary is trained on, in sizes of the dictionary.
TRAINING_TEXT = 32
#: Different pairs that a task counts before it hands its counts on.
HELD_PAIRS = 200_000
#: Words that a task remembers with what a chain makes of them, as the same ones recur.
HELD_WORDS = 50_000
#: Bytes that one undone decoding costs, a lost character, and one that no undoubted text has (a code point's, written out).
CHAIN_COST = 2
LOST_COST = 1
UNSEEN_COST = 4
LOSS = "lost"
LEVEL = 3
#: Of the restored characters, how many must occur in undoubted texts.
KNOWN_SHARE = 0.75

#: Wrong encodings of one byte a character, and of several; with the encodings the text may really have had.
SINGLE = {"western": ("utf-8", "cp949"), "cp437": ("utf-8", "cp949"), "cp850": ("utf-8", "cp949"), "mac_roman": ("utf-8", "cp949"), "cp1251": ("utf-8",)}
SEVERAL = {"gbk": ("utf-8", "cp949"), "cp932": ("utf-8", "cp949"), "cp949": ("utf-8",), "big5": ("utf-8", "cp949"), "euc_jp": ("utf-8", "cp949")}

_SEPARATORS = re.compile(r"([ \t\r\n/_\-]+)")
_HANGUL = re.compile("([가-힣ㄱ-ㆎ]+)")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_HIGH = re.compile(r"[^\x00-\x7f]")
_PIECE = re.compile(r"[\W_]{0,4}[^\W\d_]{1,16}|[\W_]{0,4}\d{1,2}|[\W_]{1,4}")
#: Texts of only these characters are undoubted, and are never sent to Python.
UNDOUBTED = r"\A[\t\n\r -~가-힣ㄱ-ㆎ]*+\z"


@lru_cache(maxsize=1)
def _single_bytes() -> dict[str, dict[int, int]]:
    """Of each encoding of one byte a character: the byte of each character. Undefined bytes stand for themselves."""
    out = {}
    for name in SINGLE:
        codec = "cp1252" if name == "western" else name
        table: dict[int, int] = {}
        for byte in range(128, 256):
            if name == "western":
                table[byte] = byte
            char = bytes([byte]).decode(codec, "replace")
            table.setdefault(byte if char == "�" else ord(char), byte)
        out[name] = table
    return out


def train(samples: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the samples; of few samples, what they contain."""
    data = [x.encode("utf-8", "replace") for x in samples if x]
    try:
        return zstandard.train_dictionary(size, data).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-size:] or b" " * 8


def script(text: str) -> str:
    """The script of the first letter beyond Korean and ASCII, by its Unicode name; of a text without one: signs."""
    for c in text:
        if c > "\x7f" and not _HANGUL.match(c) and c.isalpha():
            return unicodedata.name(c, "signs").split(" ")[0]
    return "signs"


@lru_cache(maxsize=16)
def _words(text: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The words of a text and what separates them, and where there are words with characters beyond ASCII."""
    out = tuple(_SEPARATORS.split(text))
    return out, tuple(i for i in range(0, len(out), 2) if not out[i].isascii())


class Restorer:
    """Undoes wrong decodings by least description length."""

    def __init__(self, dictionaries: Mapping[str, bytes], known: frozenset[str]) -> None:
        self.known = known
        self.undone = lru_cache(maxsize=HELD_WORDS)(self._undone)
        self.compressors = []
        for blob in dictionaries.values():
            held = zstandard.ZstdCompressionDict(blob)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def cost(self, text: str) -> int:
        """Description length in bytes: the shortest over the languages."""
        data = text.encode("utf-8", "replace")
        return min(len(c.compress(data)) for c in self.compressors)

    def plausible(self, text: str) -> bool:
        high = _HIGH.findall(text)
        return bool(high) and sum(c in self.known for c in high) >= KNOWN_SHARE * len(high)

    def undo(self, text: str, wrong: str, right: str, whole: bool = False) -> str:
        """The text with every word undone that this chain can have garbled; whole: also words of characters that are not known."""
        out, high = _words(text)
        out = list(out)
        for i in high:
            out[i] = self.undone(out[i], wrong, right, whole)
        return "".join(out)

    def _undone(self, word: str, wrong: str, right: str, whole: bool) -> str:
        """The word undone, or as it is."""
        if wrong in SEVERAL and wrong != "cp949" and _HANGUL.search(word):
            return word
        table = _single_bytes().get(wrong)
        parts = _HANGUL.split(word) if wrong != "cp949" else [word]
        for j in range(0, len(parts), 2):  # Hangul, in between, is in no other wrong encoding
            part = parts[j]
            if part.isascii():
                continue
            try:
                if table is not None:
                    data = bytes([table[c] if (c := ord(x)) > 127 else c for x in part])
                else:
                    data = part.encode(wrong)
                back = data.decode(right)
            except (KeyError, UnicodeError):
                continue
            if _LOST.search(back) and wrong not in ("western",):
                continue
            if whole or (table is not None and right == "utf-8") or self.plausible(back):
                parts[j] = back
        return "".join(parts)

    def candidates(self, text: str) -> Iterator[tuple[str, str, bool]]:
        """What undoing each chain gives, if that is another text: the text, the chain, and whether every word was undone."""
        for wrong, rights in (*SINGLE.items(), *SEVERAL.items()):
            for right in rights:
                other = self.undo(text, wrong, right)
                if other == text:
                    continue
                every = self.undo(text, wrong, right, True) if right == "cp949" and wrong in SINGLE else other
                yield other, f"{right} read as {wrong}", every == other
                if every != other:
                    yield every, f"{right} read as {wrong}", True

    def restore(self, text: str) -> tuple[str, list[str]]:
        """The text of least description length, and the chain that leads to it (empty: unchanged). What was lost stays in the text."""
        chain: list[str] = []
        cost = self.cost(text)
        while True:  # every step has a lower cost, so this ends
            best, how, least = text, "", cost
            for candidate, name, every in self.candidates(text):
                if (now := self.cost(candidate) + CHAIN_COST) < least or (now == least < cost and every and candidate != best):
                    best, how, least = candidate, name, now
            if not how:
                break
            text, cost = best, least
            chain.append(how)
        if gone := len(_LOST.findall(text)):
            rest = self.cost(_LOST.sub("", text))
            if rest + CHAIN_COST + LOST_COST * gone < rest + UNSEEN_COST * gone:
                chain.append(LOSS)
        return text, chain


@lru_cache(maxsize=4)
def _restorer(dictionaries: tuple[tuple[str, bytes], ...], known: frozenset[str]) -> Restorer:
    return Restorer(dict(dictionaries), known)


def undoubted(value: Column) -> Column:
    """Whether a value has only characters of which no wrong decoding of Korean text consists; nulls are."""
    return value.isNull() | value.rlike(UNDOUBTED)


def pairs(text: str) -> Iterator[tuple[str, str]]:
    """Every two adjoining pieces of a text; "" stands before the first and behind the last. Pieces are bounded, so that long words and numbers recur too."""
    pieces = ["", *_PIECE.findall(text), ""]
    return zip(pieces, pieces[1:])


def training_lines(counts: Mapping[tuple[str, str], int], size: int = DICTIONARY_BYTES) -> list[str]:
    """Lines in which every counted pair occurs in proportion to its count (as often, if that fits), at least once.

    A line follows the pairs from piece to piece until none is left there; each piece's pairs take turns, spread evenly.
    """
    total = sum(n * len((a + b).encode("utf-8")) for (a, b), n in counts.items()) // 2
    most = max(TRAINING_TEXT * size, 1)
    places = []
    for (a, b), n in counts.items():
        copies = n if total <= most else -(-n * most // total)
        shift = zlib.crc32(f"{a}\n{b}".encode()) / 2**32
        places += [((i + shift) / copies, a, b) for i in range(copies)]
    after: dict[str, list[str]] = {}
    for _, a, b in sorted(places, reverse=True):
        after.setdefault(a, []).append(b)
    lines = []
    for start in sorted(after):
        while after[start]:
            line = [start]
            while after.get(line[-1]):
                line.append(after[line[-1]].pop())
                if not line[-1]:
                    break
            lines.append("".join(line))
    return lines


def count_pairs(texts: DataFrame) -> DataFrame:
    """How often each pair occurs in all texts (columns value, name), by name; and, as name "", the characters beyond ASCII. Columns: name, first, second, n.

    Each task counts on its own; what is shuffled are its counts, not its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, dtype=bool)
        held: dict[str, Counter[tuple[str, str]]] = {}

        def out() -> pa.RecordBatch:
            rows = [(name, a, b, n) for name, mine in held.items() for (a, b), n in mine.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["name", "first", "second", "n"])

        for batch in batches:
            values = batch.column(0).to_pylist()
            seen[np.frombuffer("".join(values).encode("utf-32-le"), dtype="uint32")] = True
            for value, name in zip(values, batch.column(1).to_pylist()):
                held.setdefault(name, Counter()).update(pairs(value))
            if sum(map(len, held.values())) > HELD_PAIRS:
                yield out()
        yield out()
        held[""] = Counter((chr(x), "") for x in np.flatnonzero(seen) if x > 127)
        yield out()

    return texts.select("value", "name").mapInArrow(run, "name string, first string, second string, n long").groupBy("name", "first", "second").agg(F.sum("n").alias("n"))


def greatest(counted: DataFrame, most: Mapping[str, int], other: int) -> DataFrame:
    """Of each name's counted pairs, those that cover most bytes: most of them by name, else other. Each task keeps its greatest first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        def cut(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["bytes", "first", "second"], ascending=[False, True, True])
            return frame[frame.groupby("name").cumcount() < frame["name"].map(most).fillna(other)]

        held = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) > HELD_PAIRS:
                held = [cut(pd.concat(held))]
        if held:
            yield cut(pd.concat(held))

    first = counted.withColumn("bytes", F.col("n") * (F.octet_length("first") + F.octet_length("second"))).mapInPandas(run, "name string, first string, second string, n long, bytes long")
    place = F.row_number().over(W.partitionBy("name").orderBy(F.desc("bytes"), "first", "second"))
    bound = F.coalesce(*[F.when(F.col("name") == name, n) for name, n in most.items()], F.lit(other))
    return first.withColumn("_n", place).where(F.col("_n") <= bound).select("name", "first", "second", "n").sort("name", "first", "second")


def learn_undoubted(values: DataFrame, size: int = DICTIONARY_BYTES) -> tuple[dict[str, bytes], frozenset[str]]:
    """The dictionaries of Korean and English, and all characters beyond ASCII, of all undoubted values (column value)."""
    texts = values.where(F.col("value").isNotNull() & (F.col("value") != "") & undoubted(F.col("value")))
    counted = count_pairs(texts.select("value", F.when(F.col("value").rlike(_HANGUL.pattern), "ko").otherwise("en").alias("name")))
    # the characters are bounded by the number of Hangul syllables and jamo
    rows = greatest(counted, {"": 0x110000, "ko": size, "en": size}, 0).collect()
    counts = {name: {(r["first"], r["second"]): r["n"] for r in rows if r["name"] == name} for name in ("ko", "en")}
    return {name: train(training_lines(mine, size), size) for name, mine in counts.items()}, frozenset(r["first"] for r in rows if not r["name"])


def tell_apart(values: DataFrame, known: frozenset[str]) -> DataFrame:
    """All values with doubtful characters, with a column script: null if a chain can undo the value, or something was lost; else its script."""
    doubtful = values.where(~undoubted(F.col("value")))
    names = doubtful.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer({}, known)
        for batch in batches:
            scripts = [None if _LOST.search(x) or any(own.candidates(x)) else script(x) for x in batch.column(names.index("value")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scripts, type=pa.string())], names=[*names, "script"])

    return doubtful.mapInArrow(run, T.StructType([*doubtful.schema.fields, T.StructField("script", T.StringType())]))


def learn_scripts(apart: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionary of each other script, of all values that no chain can undo; apart: as tell_apart gives them."""
    counted = count_pairs(apart.where(F.col("script").isNotNull()).select("value", F.col("script").alias("name"))).where("name != ''")
    rows = groupby(greatest(counted, {}, size).toLocalIterator(), key=lambda r: r["name"])  # one script's pairs at a time
    return {name: train(training_lines({(r["first"], r["second"]): r["n"] for r in mine}, size), size) for name, mine in rows}


def learn(values: DataFrame, size: int = DICTIONARY_BYTES, foreign: int = DICTIONARY_BYTES) -> tuple[tuple[tuple[str, bytes], ...], frozenset[str]]:
    """A dictionary of each language (of size bytes) or other script (foreign bytes), and all characters beyond ASCII of the undoubted
    values (column value). All values are counted; a dictionary depends on the counts only, not on how the values are spread."""
    own, known = learn_undoubted(values, size)
    return tuple(sorted((own | learn_scripts(tell_apart(values, known), foreign)).items())), known


def restore_values(values: DataFrame) -> DataFrame:
    """Judge every value. values: table_name, row_key, value. Rows come out only for garbled values.

    Columns: table_name, row_key, value, restored (the best text found; what was lost stays lost), chain (array), lost
    (whether something can't be recovered). Null, empty and undoubted values are never garbled; repeated rows each count.
    """
    own, known = learn_undoubted(values)
    apart = checkpoint(tell_apart(values.select("table_name", "row_key", "value"), known))
    held = values.sparkSession.sparkContext.broadcast((tuple(sorted((own | learn_scripts(apart)).items())), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _restorer(*held.value)
        for batch in batches:
            keep, texts, chains = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                back, chain = own.restore(text)
                if chain:
                    keep.append(i)
                    texts.append(back)
                    chains.append(chain)
            part = batch.take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string()), pa.array(chains, type=pa.list_(pa.string())), pa.array([LOSS in c for c in chains], type=pa.bool_())], names=["table_name", "row_key", "value", "restored", "chain", "lost"])

    # what no chain can undo, and nothing was lost of, stays as it is
    return apart.where(F.col("script").isNull()).drop("script").mapInArrow(run, "table_name string, row_key long, value string, restored string, chain array<string>, lost boolean")
