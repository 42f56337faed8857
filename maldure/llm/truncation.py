"""Text cut off by field limits or during transfer.

Lengths. The discrete hazard of a length is the share of the texts at least that long which end there; here, with an
incomplete ending. Two tests use it:

- limits: in a source that cuts texts at a limit, many texts end at exactly that length, and incomplete. Window functions give
  every length's hazard of incomplete endings for each source, in characters, in bytes and in bytes up to the next whole
  character; each is tested against its neighbours' (lengths that differ by at most a twentieth).
- transfers: a transfer that breaks off ends a text anywhere, so a source that loses texts so has a raised hazard of
  incomplete endings at all lengths. For each source, the incomplete endings of every octave of length are set against the
  hazard that its neighbours, the other sources, have in the same octave, and added up (a log-rank test).

Tails are those of a Poisson count, bounded after Chernoff; false discoveries are controlled after Benjamini and Hochberg.

Endings. What completes a text is learned from the whole corpus (lines that close many texts, words that end lines and
sentences), and each ending is graded: COMPLETE, OPEN_QUESTION (may be complete or not), INCOMPLETE (as no text of the corpus
ends) or BROKEN (inside a number, a bracket, a JSON value, a code block, a character).

A text was cut if it is INCOMPLETE or an OPEN_QUESTION at a significant length (reason ``limit``), INCOMPLETE in a source whose
hazard of such endings is raised (``transfer``) or at least not significantly below its neighbours' (``ending``: too few texts
to tell), or BROKEN (``structure``). An INCOMPLETE ending at no significant length in a source whose hazard is significantly
low is an unusual ending of a whole text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maldure.tables import checkpoint

#: Expected share of false discoveries among a source's significant lengths.
FALSE_DISCOVERY = 0.001
#: Neighbours of a length: those that differ by at most this share.
NEIGHBOURS = 0.05
#: A line closes texts if at least this share of the texts end with it; so there are at most 1 / CLOSERS such lines.
CLOSERS = 0.002
#: A word ends lines or sentences if at least this share of them end with it.
ENDINGS = 0.0003
#: Ending words that follow one and the same word so often are a fixed phrase.
PHRASE = 0.9
#: So many occurrences of anything may be chance; shares are taken of what is beyond them.
CHANCE = 2

COMPLETE, OPEN_QUESTION, INCOMPLETE, BROKEN = 0, 1, 2, 3
#: How a JSON value begins, other than prose with a bracket in front.
_JSON = re.compile(r'\s*[\[{]\s*["{\[\]}]')
#: A word before a full stop; it is only tried where a word begins, so long runs cost no more than their length.
_SENTENCE = re.compile(r"(?<![^\s.?!。？！])([^\s.?!。？！]++)[.?!](?=\s|$)")
_SPEAKER = re.compile(r"^[^\s:：]{1,8} ?[:：] ?")
# What tools put behind a text that they cut.
_MARK = re.compile(r"(?i)(?:[\[(<](?:truncated|cut(?: off)?|more|snip|잘림|생략|이하 생략|중략)[\])>]|- ?more ?-+)\Z")
_DOTS = ".…⋯"
_NUMBER = re.compile(r"(?<![\d.])\d+\.$")
_PAIRS = {")": "(", "]": "[", "}": "{", "」": "「", "』": "『", "”": "“", "’": "‘"}


def stops(text: str) -> bool:
    """Whether a text ends with a full stop, perhaps inside of quotes or brackets."""
    return text.rstrip("\"'”’」』)]")[-1:] in tuple(".?!。？！")


def line_form(line: str) -> str:
    """A line without its speaker, with digits and whole numbers alike and single spaces."""
    line = re.sub(r"[^\w\s!-/:-@\[-`{-~]", "", line)
    line = re.sub(r"(?<![0-9.])[0-9]+(?![0-9.])", "0", " ".join(_SPEAKER.sub("", line.strip()).split()))
    return re.sub("[0-9]", "0", line)


def last_words(line: str) -> tuple[str, str]:
    """The last word of a line and the one before."""
    words = line_form(line).split()
    return (words[-1] if words else "", words[-2] if len(words) > 1 else "")


def _closed(text: str) -> bool:
    """Whether every bracket and string of a JSON text that isn't well-formed is closed, the first bracket last."""
    open_ones, inside, escaped = [], False, False
    for c in text:
        if inside:
            inside = escaped or c != '"'
            escaped = not escaped and c == "\\"
        elif c == '"':
            inside = True
        elif c in "{[":
            open_ones.append(c)
        elif c in "}]" and open_ones and open_ones[-1] == _PAIRS[c]:
            open_ones.pop()
    return not inside and not open_ones and text[-1] in "}]"


def line_hash(line: str) -> str:
    """What stands for a line's form; lines of any length are counted by it."""
    return xxhash.xxh64_hexdigest(line.encode("utf-8", "surrogatepass"))


def _unusual(word: str) -> bool:
    """Whether a string between spaces is no Korean or English word."""
    return bool(word) and (len(word) >= 20 or not re.search("[가-힣A-Za-z]", word))


def is_json(text: str) -> bool:
    """Whether a text is graded as JSON; all others are prose, whose endings are learned."""
    return _JSON.match(text) is not None


class Endings:
    """What completes texts in a corpus. closers: the hashes of closing lines."""

    def __init__(self, closers: set[str], bare: dict[str, int], phrases: dict[tuple[str, str], int], sentences: set[str]) -> None:
        self.closers, self.sentences = closers, sentences
        self.bare: dict[str, set[str] | None] = {}
        before: dict[str, Counter] = {}
        for (first, last), n in phrases.items():
            before.setdefault(last, Counter())[first] += n
        for word, n in bare.items():
            own = before.get(word, Counter())
            self.bare[word] = set(own) if sum(own.values()) >= PHRASE * n else None

    def ends_line(self, line: str) -> bool:
        """Whether lines of the corpus end like this one without a full stop."""
        word, first = last_words(line)
        if word not in self.bare:
            return False
        return self.bare[word] is None or first in self.bare[word] or _unusual(first)

    def closes(self, line: str) -> bool:
        """Whether a line is a closing one, or ends with one after a string that is no word."""
        form = line_form(line)
        if line_hash(form) in self.closers:
            return True
        words = form.split(" ")
        return any(_unusual(words[i - 1]) and line_hash(" ".join(words[i:])) in self.closers for i in range(max(1, len(words) - 4), len(words)))

    def grade(self, text: str) -> int:
        """COMPLETE, OPEN_QUESTION, INCOMPLETE or BROKEN; a blank text is complete."""
        text = text.rstrip()
        if not text:
            return COMPLETE
        if text[-1] == "�":
            return BROKEN
        if is_json(text):
            try:
                json.loads(text, strict=False)
                return COMPLETE
            except (ValueError, RecursionError):
                return COMPLETE if _closed(text) else BROKEN
        if text.count("```") % 2:
            return BROKEN
        line = text.rsplit("\n", 1)[-1]
        if self.closes(line) or text.endswith("```"):
            return COMPLETE
        open_ones: list[str] = []
        for c in line:
            if c in "([{「『“":
                open_ones.append(c)
            elif c in _PAIRS and open_ones and open_ones[-1] == _PAIRS[c]:
                open_ones.pop()
        if open_ones or _MARK.search(line):
            return BROKEN
        bare = text.rstrip(_DOTS)
        if len(text) - len(bare) > 1 or text[-1] in "…⋯":
            words = bare.split()
            return COMPLETE if words and words[-1] in self.sentences or self.ends_line(line.rstrip(_DOTS)) else INCOMPLETE
        if stops(text):
            return BROKEN if _NUMBER.search(line) else COMPLETE
        if self.ends_line(line):
            return OPEN_QUESTION
        return INCOMPLETE if self.learned(text) else OPEN_QUESTION

    def learned(self, text: str) -> bool:
        """Whether the text is of the kinds whose endings are known: another line or sentence of it is complete, or it has words."""
        return len(text.split()) > 1 or bool(_SENTENCE.search(text))


def _evidence(texts: DataFrame) -> DataFrame:
    """What lines and sentences inside of the texts end with, and the texts' last lines, counted. Columns: kind, item, n.

    One pass: each task counts on its own. Of a text that occurs more than once the last line counts once; last lines of any
    length are counted by their hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, str]] = Counter()

        def out(kinds: list[str], items: list[str], texts: list[int | None], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds, type=pa.string()), pa.array(items, type=pa.string()), pa.array(texts, type=pa.int64()), pa.array(n, type=pa.int64())], names=["kind", "item", "h", "n"])

        def settled() -> pa.RecordBatch:
            held = list(found)
            done = out([k for k, _ in held], [x for _, x in held], [None] * len(held), list(found.values()))
            found.clear()
            return done

        for batch in batches:
            hashes, last = batch.column(0).to_pylist(), []
            for text in batch.column(1).to_pylist():
                last.append(line_hash(line_form(text.rstrip().rsplit("\n", 1)[-1])))
                if is_json(text):
                    continue
                found.update(("sentence", w) for w in _SENTENCE.findall(text))
                for line in text.rstrip().split("\n")[:-1]:
                    line = line.rstrip()
                    if line and not stops(line):
                        word, before = last_words(line)
                        if word:
                            found["bare", word] += 1
                            found["phrase", f"{before}\t{word}"] += 1
            yield out(["final"] * len(last), last, hashes, [1] * len(last))
            if len(found) > 200_000:
                yield settled()
        yield settled()

    rows = texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "kind string, item string, h long, n long")
    once = rows.groupBy("kind", "item", "h").agg(F.sum("n").alias("n"))
    return once.groupBy("kind", "item").agg(F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(1)).alias("n"))


def learn_endings(texts: DataFrame) -> Endings:
    """What completes the texts (column text); only shares above CLOSERS and ENDINGS are gathered, so their number is bounded."""
    counts = checkpoint(_evidence(texts))
    totals = {r["kind"]: r["total"] for r in counts.groupBy("kind").agg(F.sum("n").alias("total")).collect()}
    enough = F.lit(False)
    for kind, total in totals.items():
        enough = enough | ((F.col("kind") == kind) & (F.col("n") - CHANCE >= (CLOSERS if kind == "final" else ENDINGS) * total))
    held: dict[str, dict] = {"bare": {}, "phrase": {}, "sentence": {}, "final": {}}
    for r in counts.where(enough).collect():
        held[r["kind"]][r["item"]] = r["n"]
    phrases = {tuple(k.split("\t")): n for k, n in held["phrase"].items()}
    return Endings(set(held["final"]) - {line_hash("")}, held["bare"], phrases, set(held["sentence"]))


def _tail(count: Column, expected: Column, above: bool) -> Column:
    """The chance of a Poisson count as far above (below) its expectation, at most; after Chernoff."""
    bound = F.exp(count - expected + F.when(count > 0, count * F.log(expected / count)).otherwise(0.0))
    return F.when((count > expected) if above else (count < expected), F.least(F.lit(1.0), bound)).otherwise(1.0)


def _discoveries(d: DataFrame, p: str, name: str, groups: list[str], tests: Column, tie: str) -> DataFrame:
    """``d`` with the flag ``name``: discoveries at FALSE_DISCOVERY after Benjamini and Hochberg, in each group."""
    own = W.partitionBy(*groups)
    d = d.withColumn("_rank", F.row_number().over(own.orderBy(p, tie)))
    last = F.max(F.when(F.col(p) <= FALSE_DISCOVERY * F.col("_rank") / tests, F.col("_rank"))).over(own)
    return d.withColumn(name, F.coalesce(F.col("_rank") <= last, F.lit(False))).drop("_rank")


def length_hazards(lengths: DataFrame) -> DataFrame:
    """The hazard of an incomplete ending at each length, tested.

    lengths: source, unit, len, texts (different ones of that length), incomplete (of those, endings that are incomplete); a row per
    source, unit and length that occurs, so no window holds more rows than there are lengths. Columns: source, unit, len, incomplete,
    at_risk (texts at least that long), hazard, expected (the neighbours' hazard), p, significant. Null sources are one source.
    """
    own = W.partitionBy("source", "unit")
    d = lengths.withColumn("at_risk", F.sum("texts").over(own.orderBy(F.col("len").desc()))).withColumn("_at", F.round(F.log("len") * 10000).cast("long"))
    # texts are at risk at the lengths in between too, where none ends; of those, so many as are neighbours
    between = F.least(F.col("len") - 1 - F.coalesce(F.lag("len").over(own.orderBy("len")), F.lit(0)), F.floor(F.lit(NEIGHBOURS) * F.col("len")))
    d = d.withColumn("_between", F.col("at_risk") * between)
    wide = round(NEIGHBOURS * 10000)
    near = own.orderBy("_at").rangeBetween(-wide, wide)
    ends, risk = F.sum("incomplete").over(near) - F.col("incomplete"), F.sum(F.col("at_risk") + F.col("_between")).over(near) - F.col("at_risk")
    d = d.withColumn("expected", (ends + 0.5) / (risk + 1.0)).drop("_between")
    d = d.withColumn("hazard", F.col("incomplete") / F.col("at_risk"))
    d = d.withColumn("p", _tail(F.col("incomplete").cast("double"), F.col("expected") * F.col("at_risk"), True))
    # lengths without an end are tests too, with p = 1: their number only enlarges the divisor
    return _discoveries(d, "p", "significant", ["source", "unit"], F.max("len").over(own), "len").drop("_at", "texts")


def transfer_hazards(octaves: DataFrame) -> DataFrame:
    """Whether a source's hazard of incomplete endings, over all lengths, is above or below its neighbours'.

    octaves: source, octave (of length), texts (different ones that end there), incomplete (of those, endings that are incomplete).
    Columns: source, incomplete, expected, raised, lowered. Null sources are one source.
    """
    # a text is at risk in every octave up to its own
    at = octaves.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("octave"))))
    ends = F.sum(F.when(F.col("_at") == F.col("octave"), F.col("incomplete")).otherwise(0))
    d = at.groupBy("source", "_at").agg(F.sum("texts").alias("_risk"), ends.alias("incomplete"))
    whole = d.groupBy("_at").agg(F.sum("incomplete").alias("_i"), F.sum("_risk").alias("_r"))
    d = d.join(whole, "_at").withColumn("_rate", (F.col("_i") - F.col("incomplete")) / F.greatest(F.col("_r") - F.col("_risk"), F.lit(1)))
    d = d.groupBy("source").agg(F.sum("incomplete").alias("incomplete"), F.sum(F.col("_rate") * F.col("_risk")).alias("expected"))
    seen, rate = F.col("incomplete").cast("double"), F.col("expected")
    d = d.withColumn("_above", _tail(seen, rate + 0.5, True)).withColumn("_below", _tail(seen, rate, False)).withColumn("_all", F.lit(0))
    tests = F.count(F.lit(1)).over(W.partitionBy("_all"))  # a row per source
    for p, name in (("_above", "raised"), ("_below", "lowered")):
        d = _discoveries(d, p, name, ["_all"], tests, "source")
    return d.drop("_all", "_above", "_below")


#: The units in which lengths are measured.
UNITS = ("chars", "bytes", "room")


def grade_endings(docs: DataFrame, endings: Endings) -> DataFrame:
    """docs: _key, text, source. Columns: _key, source, h (the text's hash), the lengths in UNITS, grade. No text goes further.

    room: the bytes without dots and blanks at the end, up to the next multiple of a character's four; a limit in bytes that
    spares characters, or a mark behind it, leaves it the same.
    """
    held = docs.sparkSession.sparkContext.broadcast(endings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            bare = [len(t.rstrip().rstrip(_DOTS).encode("utf-8", "surrogatepass")) for t in texts]
            sizes = [[len(t) for t in texts], [len(t.encode("utf-8", "surrogatepass")) for t in texts], [-(-n // 4) * 4 for n in bare]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, type=pa.int32()) for x in sizes], pa.array([own.grade(t) for t in texts], type=pa.int32())], names=["_key", "source", "h", *UNITS, "grade"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.select("_key", "source", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"_key {kind}, source string, h long, chars int, bytes int, room int, grade int")


def judge_truncation(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Judge every text. Columns: key, source, chars, bytes, grade, unit and len (the significant length, if any), reason, truncated.

    Null, empty and blank texts are never truncated (grade 0); repeated texts each have their row, but are one text in every
    count; whole texts are read, twice: to learn what endings there are, and to grade.
    """
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(source).alias("source"))
    endings = learn_endings(docs.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s]")))
    graded = checkpoint(grade_endings(docs, endings))
    return decide(graded).withColumnRenamed("_key", key)


def decide(graded: DataFrame) -> DataFrame:
    """The result of judge_truncation, from graded endings."""
    texts = graded.where("room > 0").groupBy("source", "h").agg(F.first("grade").alias("grade"), *[F.first(u).alias(u) for u in UNITS])
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("len")) for u in UNITS]))
    incomplete = F.col("grade").isin(INCOMPLETE, BROKEN)
    lengths = texts.select("source", "grade", units.alias("u")).groupBy("source", "u.unit", "u.len").agg(F.count(F.lit(1)).alias("texts"), F.count_if(incomplete).alias("incomplete"))
    limits = checkpoint(length_hazards(lengths).where("significant").select(F.col("source").alias("_source"), F.col("unit").alias("_unit"), F.col("len").alias("_len")))

    def at_limits(rows: DataFrame) -> DataFrame:
        for u in UNITS:
            at = limits.where(F.col("_unit") == u).select("_source", "_len", F.lit(True).alias(f"_{u}"))
            rows = rows.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col(u) == F.col("_len")), "left").drop("_source", "_len")
        first = F.coalesce(*[F.when(F.col(f"_{u}"), F.struct(F.lit(u).alias("unit"), F.col(u).alias("len"))) for u in UNITS])
        return rows.withColumn("_limit", first).drop(*[f"_{u}" for u in UNITS])

    octaves = at_limits(texts).where("_limit IS NULL").groupBy("source", F.floor(F.log2("chars")).cast("int").alias("octave")).agg(F.count(F.lit(1)).alias("texts"), F.count_if(incomplete).alias("incomplete"))
    sources = transfer_hazards(octaves).select(F.col("source").alias("_source"), "raised", "lowered")
    rows = at_limits(graded).join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at, grade = F.col("_limit").isNotNull(), F.col("grade")
    reason = (
        F.when(at & (grade >= OPEN_QUESTION), "limit")
        .when(grade == BROKEN, F.when(F.col("raised"), "transfer").otherwise("structure"))
        .when(grade == INCOMPLETE, F.when(F.col("raised"), "transfer").when(~F.coalesce("lowered", F.lit(False)), "ending"))
    )
    return rows.select("_key", "source", "chars", "bytes", "grade", "_limit.unit", "_limit.len", reason.alias("reason"), reason.isNotNull().alias("truncated"))
