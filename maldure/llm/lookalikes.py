"""Visually identical text with different characters: find it and bring it to one form.

Code points and strings form a graph whose edges join what looks the same; its connected components (union-find) are the
look-alike classes. Every class has one representative: a member that a Korean or English keyboard gives, else one that
Unicode's canonical composition keeps, and among those the most frequent of the corpus. Text is rewritten by an automaton over
all other members, leftmost and longest first.

Words need more than their code points: a Cyrillic letter in a Cyrillic word is right. So words are strings of the graph too,
with an edge between two that differ in one letter and its look-alike. The letters' classes come from union-find over
Unicode's table of confusable characters, which Spark's ICU library holds. Two words are then connected if and only if they have
the same representatives letter by letter, so a word's class is found from the word alone, and no task holds the graph. A
class's most frequent spelling in the corpus decides: if it is all Latin, its other spellings are rewritten; a word that mixes
Latin letters with look-alikes of another script always is. Words are rewritten by an automaton as well.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maldure.tables import checkpoint

# Letters of other scripts with the very shape of a Latin letter; words of one such letter are told apart by frequency.
LIKE_LATIN = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj",
}
# Code points that show nothing.
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0001, 0xE007F), (0xE0100, 0xE01EF)]
# Dashes as short as the hyphen.
HYPHENS = "\u02d7\u2010\u2011\u2043\u2212\ufe63"

#: What needs no look: the ASCII of a keyboard, Hangul syllables and single (compatibility) jamo.
PLAIN = r"\t\n\u000b\f\r -~ㄱ-ㅣㅥ-ㆎ가-힣"
_WORD = r"A-Za-z\u00c0-\u024f\u0300-\u052f\u1e00-\u1fff"
_FOREIGN = re.compile("[\u0370-\u052f]")
_LATIN = re.compile("[A-Za-z]")
#: What is no look-alike letter: Latin letters of a keyboard, Hangul, Hanja.
_PLAIN_LETTER = re.compile("[A-Za-z가-힣\u3400-\u9fff]")


def keyboard(text: str) -> bool:
    """Whether a Korean or English keyboard gives every character."""
    return all(" " <= c <= "~" or "가" <= c <= "힣" or "ㄱ" <= c <= "ㅣ" or c in "\t\n\r" for c in text)


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def _edges() -> Iterator[tuple[str, str]]:
    """Pairs that look the same, by rule from Unicode's own data."""
    letters: dict[str, dict[str, str]] = {}
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs" and c != " ":
            yield c, " "
        how = unicodedata.decomposition(c)
        if how.startswith(("<wide>", "<narrow>", "<font>")) or (how.startswith("<noBreak>") and kind != "Zs"):
            yield c, "".join(chr(int(x, 16)) for x in how.split()[1:])
        if unicodedata.normalize("NFC", c) != c:
            yield c, unicodedata.normalize("NFC", c)
        elif (apart := unicodedata.normalize("NFD", c)) != c:
            yield apart, c
            if len(step := "".join(chr(int(x, 16)) for x in how.split())) > 1 and step != apart:
                yield step, c
            if "가" <= c <= "힣" and len(apart) == 3:
                yield unicodedata.normalize("NFC", apart[:2]) + apart[2], c
        if 0x1100 <= point < 0x1200 or 0x3131 <= point <= 0x318E:
            name = unicodedata.name(c, "")
            for part in ("CHOSEONG ", "JUNGSEONG ", "JONGSEONG ", "LETTER "):
                if name.startswith("HANGUL " + part):
                    letters.setdefault(name[len("HANGUL " + part) :], {})[c] = part
    for forms in letters.values():
        modern = [c for c, part in forms.items() if part == "LETTER "]
        for c in forms:
            if modern and c != modern[0]:
                yield c, modern[0]
    for c in HYPHENS:
        yield c, "-"
    for low, high in INVISIBLE:
        for point in range(low, high + 1):
            yield chr(point), ""
    yield "\u2028", "\n"
    yield "\u2029", "\n"


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """The look-alike classes of code points and strings, apart from letters of other scripts. Their number is fixed by Unicode."""
    graph = Classes()
    for x, y in _edges():
        graph.join(x, y)
    return graph.members()


def confusable_letters(spark: SparkSession) -> list[tuple[str, str]]:
    """Letters of any script, with the Latin letter that Unicode's confusables give the same skeleton. Without ICU there is no answer, but an error."""
    letters = [c for p in range(sys.maxunicode + 1) if unicodedata.category(c := chr(p))[0] == "L" and unicodedata.normalize("NFKC", c) == c and not _PLAIN_LETTER.match(c)]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join([*letters, *string.ascii_letters])).split("\n")
    except TypeError as error:  # a class that the JVM hasn't is a package for py4j, which can't be called
        raise RuntimeError("look-alike letters need ICU's com.ibm.icu.text.SpoofChecker on Spark's class path") from error
    if len(skeletons) != len(letters) + len(string.ascii_letters):
        raise RuntimeError(f"ICU gave {len(skeletons)} skeletons of {len(letters) + len(string.ascii_letters)} letters")
    latin: dict[str, list[str]] = {}
    for c, skeleton in zip(string.ascii_letters, skeletons[len(letters) :]):
        latin.setdefault(skeleton, []).append(c)
    # where a capital and a small Latin letter look alike, a letter goes with that of its case
    alike = ((c, latin.get(k, [])) for c, k in zip(letters, skeletons))
    return [(c, next((x for x in found if x.isupper() == c.isupper()), found[0])) for c, found in alike if found]


def latin_classes(more: Sequence[tuple[str, str]] = ()) -> dict[str, str]:
    """Each letter that is in one class with a Latin letter, with that letter: those of LIKE_LATIN, and more pairs."""
    graph = Classes()
    for pair in " ".join(LIKE_LATIN.values()).split():
        graph.join(pair[0], pair[1])
    for x, y in more:
        if x not in graph.parent:
            graph.join(x, y)
    out = {}
    for members in graph.members().values():
        latin = [x for x in members if _LATIN.match(x)]
        out.update({x: latin[0] for x in members if x not in latin})
    return out


class Letters:
    """What words are read with: the letters' classes, and expressions for words and for their odd letters."""

    def __init__(self, like: Mapping[str, str]) -> None:
        self.like = dict(sorted(like.items()))
        every = "".join(map(re.escape, self.like))
        self.word, self.odd = re.compile(f"[{_WORD}{every}]+"), re.compile(f"[{every}]")
        self.table = str.maketrans(self.like)

    def others(self) -> str:
        """The letters of other scripts than Latin."""
        return "".join(c for c in self.like if not unicodedata.name(c, "").startswith("LATIN"))

    def latinized(self, word: str) -> str | None:
        """The word in Latin letters, if all of its odd letters look like Latin ones; they are its class's representatives."""
        out = word.translate(self.table)
        return None if _FOREIGN.search(out) or out == word else out


def representatives(counts: Mapping[str, int] | None = None) -> dict[str, str]:
    """Each member that isn't its class's representative, with the representative; counts: the code points' frequencies."""
    counts = counts or {}

    def rank(x: str):
        seen = min((counts.get(c, 0) for c in x), default=sys.maxsize)
        return (not keyboard(x), unicodedata.normalize("NFC", x) != x, -seen, len(x), x)

    out = {}
    for members in classes().values():
        best = min(members, key=rank)
        out.update({x: best for x in members if x != best})
    return out


class Rewriter:
    """Greedy rewriting, leftmost and longest first, by one automaton over all members that aren't representatives."""

    def __init__(self, counts: Mapping[str, int] | None = None) -> None:
        self.to = representatives(counts)
        self.automaton = ahocorasick.Automaton()
        for x, best in self.to.items():
            self.automaton.add_word(x, (len(x), best))
        self.automaton.make_automaton()
        self.hidden = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]")

    @staticmethod
    def _emoji(text: str, at: int) -> bool:
        """Whether a joiner or selector belongs to an emoji."""
        before = text[at - 1] if at else ""
        if not before:
            return False
        if text[at] == "\u200d":
            return unicodedata.category(before) in ("So", "Sk") or before == "\ufe0f"
        return text[at] in "\ufe0e\ufe0f" and (unicodedata.category(before) in ("So", "Sk") or before in "#*0123456789")

    def visible(self, text: str) -> str:
        """Without characters that show nothing."""
        return self.hidden.sub(lambda m: m[0] if self._emoji(text, m.start()) else "", text)

    def points(self, text: str) -> str:
        """One form for all code points and short strings; words stay."""
        text, out, done = self.visible(text), [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            start = end - n + 1
            if best == "":
                continue  # kept by visible()
            out += text[done:start], best
            done = end + 1
        return "".join(out) + text[done:] if out else text


@lru_cache(maxsize=4)
def _rewriter(counts: tuple) -> Rewriter:
    return Rewriter(dict(counts))


def point_counts(df: DataFrame, columns: Sequence[str], letters: Letters) -> DataFrame:
    """How often each code point, and each word that looks Latin, occurs in the columns. Columns: kind (point, word), item, n.

    Each task counts on its own; what is shuffled are its counts, not its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.zeros(sys.maxunicode + 1, dtype="int64")
        words: Counter[str] = Counter()

        def out(items: list[tuple[str, str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], type=t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "item", "n"])

        hidden = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in INVISIBLE) + "]")
        for batch in batches:
            for column in batch.columns:
                text = "\n".join(x for x in column.to_pylist() if x)
                if not text:
                    continue
                found = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="uint32"))
                points[: len(found)] += found
                words.update(letters.word.findall(hidden.sub("", text)))
            if len(words) > 200_000:
                yield out([("word", w, n) for w, n in words.items()])
                words.clear()
        words = Counter({w: n for w, n in words.items() if not _FOREIGN.search(w.translate(letters.table))})
        yield out([("word", w, n) for w, n in words.items()] + [("point", chr(p), int(points[p])) for p in np.flatnonzero(points) if p != 10 and not 0xD800 <= p < 0xE000])

    return df.select(*columns).mapInArrow(run, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def word_rewrites(words: DataFrame, letters: Letters) -> DataFrame:
    """Of counted words (item, n): those to be rewritten, with their class's representative. Columns: word, best.

    A word of one letter is a letter of its script, unless it has the very shape of a Latin one (LIKE_LATIN).
    """
    same = "".join(latin_classes())
    spelled = words.where((F.length("item") > 1) | F.col("item").rlike(f"[A-Za-z{same}]")).withColumn("latin", F.translate("item", "".join(letters.like), "".join(letters.like.values())))
    # the most frequent spelling, then the all-Latin one, by a partial aggregate; no class is gathered
    best = F.max(F.struct(F.col("n"), (F.col("item") == F.col("latin")).alias("plain"), F.col("item"))).alias("best")
    classes_of = spelled.groupBy("latin").agg(best, F.count(F.lit(1)).alias("forms"))
    odd = spelled.where(F.col("item") != F.col("latin"))
    mixed = F.col("item").rlike("[A-Za-z]") & F.col("item").rlike(f"[{letters.others()}]")
    return (
        odd.join(classes_of, "latin")
        .where(mixed | (F.col("best.plain") & (F.col("best.item") != F.col("item"))))
        .select(F.col("item").alias("word"), F.col("latin").alias("best"))
    )


def _suspicious(c) -> Column:
    return c.isNotNull() & c.rlike(f"[^{PLAIN}]")


def inspect(df: DataFrame, key: str, columns: Sequence[str], counts: Mapping[str, int], letters: Letters) -> DataFrame:
    """The texts that may be cases. Columns: key, field_name, text, changed (its code points are), clean, words (odd ones left).

    Texts of plain characters are told apart inside the JVM and never reach Python.
    """
    frozen = tuple(sorted(counts.items()))
    texts = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns])).alias("s")).select("_key", "s.*")
    texts = texts.where(_suspicious(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _rewriter(frozen)
        for batch in batches:
            clean, words = [], []
            for text in batch.column(2).to_pylist():
                clean.append(own.points(text))
                words.append(sorted({w for w in letters.word.findall(clean[-1]) if letters.odd.search(w) and letters.latinized(w)}) if letters.odd.search(clean[-1]) else [])
            changed = [a != b for a, b in zip(clean, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(changed), pa.array(clean, type=pa.string()), pa.array(words, type=pa.list_(pa.string()))], names=["_key", "field_name", "text", "changed", "clean", "words"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return texts.mapInArrow(run, f"_key {kind}, field_name string, text string, changed boolean, clean string, words array<string>").withColumnRenamed("_key", key)


def class_counts(counted: DataFrame) -> dict[str, int]:
    """The frequencies of those code points that are in a look-alike class; at most as many as Unicode has."""
    own = {c for members in classes().values() for x in members for c in x}
    return {r["item"]: r["n"] for r in counted.where("kind = 'point'").select("item", "n").toLocalIterator() if r["item"] in own and not keyboard(r["item"])}


def find_lookalikes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Values written with look-alikes. Columns: key, field_name. Null and empty values are none; each row counts, repeated or not."""
    letters = Letters(latin_classes(confusable_letters(df.sparkSession)))
    counted = checkpoint(point_counts(df, columns, letters))
    rewrites = word_rewrites(counted.where("kind = 'word'").select("item", "n"), letters)
    seen = checkpoint(inspect(df, key, columns, class_counts(counted), letters).select(key, "field_name", "changed", "words").where("changed OR size(words) > 0"))
    by_word = seen.where("NOT changed").select(key, "field_name", F.explode("words").alias("word"))
    found = by_word.join(rewrites.select("word"), "word", "left_semi").select(key, "field_name")
    return seen.where("changed").select(key, "field_name").unionByName(found.distinct())


class WordRewriter:
    """Rewrites whole words, by one automaton over all of them."""

    def __init__(self, to: Mapping[str, str], letters: Letters) -> None:
        self.letters, self.automaton = letters, ahocorasick.Automaton()
        for word, best in to.items():
            self.automaton.add_word(word, (len(word), best))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        out, done = [], 0
        for end, (n, best) in self.automaton.iter_long(text):
            start = end - n + 1
            if not any(self.letters.word.match(c) for c in (text[start - 1 : start], text[end + 1 : end + 2])):
                out += text[done:start], best
                done = end + 1
        return "".join(out) + text[done:]


def rewrite_lookalikes(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns in one form. Plain and null values stay as they are. The key must be unique."""
    letters = Letters(latin_classes(confusable_letters(df.sparkSession)))
    counted = checkpoint(point_counts(df, columns, letters))
    rewrites = word_rewrites(counted.where("kind = 'word'").select("item", "n"), letters)
    seen = checkpoint(inspect(df, key, columns, class_counts(counted), letters).where("changed OR size(words) > 0").drop("text"))
    pairs = seen.select(key, "field_name", F.explode("words").alias("word")).join(rewrites, "word").groupBy(key, "field_name").agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("_to"))

    @F.pandas_udf(T.StringType())
    def words_in(clean, to):
        import pandas as pd

        maps = [dict(x) if x is not None else {} for x in to]
        every = {w: best for own in maps for w, best in own.items()}
        rewrite = WordRewriter(every, letters) if every else None
        return pd.Series([rewrite(text) if own else text for text, own in zip(clean, maps)], dtype="object")

    new = seen.join(pairs, [key, "field_name"], "left").select(key, "field_name", words_in("clean", "_to").alias("_new"))
    wide = new.groupBy(key).agg(*[F.max(F.when(F.col("field_name") == c, F.col("_new"))).alias(f"_new_{c}") for c in columns])
    out = df.join(wide, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])
