"""Rows that fail to parse: raw records are read permissively, and those that don't fit come out apart with the reason.

Every raw record is read permissively (``from_csv``, ``from_json`` in mode PERMISSIVE) under an explicit schema with a column that
keeps the raw text of what doesn't fit. Only records that are corrupt by that reading, or hold what its readers are lenient
about, are taken apart again: quoting (``broken_syntax``), field count (``column_count``). Casts (``invalid_value``) are
checked last, for all. CSV stays inside the JVM; of JSON only records that are neither corrupt nor flat objects by one
possessive pattern reach a strict decoder in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names under which a manifest may hold the audio path and the text, in order of precedence.
AUDIO_NAMES = ("audio_path", "audio_filepath", "path")
TEXT_NAMES = ("text", "transcript", "sentence")
AUDIO_SUFFIXES = r"(?i)\.(wav|pcm|flac)$"
#: The explicit schema of a record, as far as it could be read; all values as text.
VALUES = ("audio_path", "text", "id", "speaker", "sample_rate", "duration")
RECORD = T.StructType([T.StructField(x, T.BooleanType()) for x in ("ok", "odd_type")] + [T.StructField(x, T.StringType()) for x in VALUES])

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+$"
_BLANK = r"^[\s\u001c-\u001f\u0085 　]*+$"


#: What the permissive CSV reader is lenient about: quotes, line breaks, its comment character.
_LENIENT_CSV = "[\"\r\n\u0000]"
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\["\\/bfnrt])*+"'
_NAME = r'"[^"\\\x00-\x1f]*+"'
_SCALAR = rf"(?:{_STRING}|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null)"
_PAIR = rf"[ \t\r\n]*+{_NAME}[ \t\r\n]*+:[ \t\r\n]*+{_SCALAR}[ \t\r\n]*+"
#: A JSON object of RFC 8259 without nested values, escapes in names and escaped code points.
_FLAT = rf"\A[ \t\r\n]*+\{{(?:{_PAIR}(?:,{_PAIR})*+|[ \t\r\n]*+)\}}[ \t\r\n]*+\z"
_KEY = rf'"({"|".join(AUDIO_NAMES + TEXT_NAMES)}|id|speaker|sample_rate|duration)"[ \t\r\n]*+:'
#: One of these names with a value that is no string and not null; exact in a flat object.
_ODD = rf'"(?:{"|".join(AUDIO_NAMES + TEXT_NAMES)})"[ \t\r\n]*+:[ \t\r\n]*+(?!"|null)'
CORRUPT = "_corrupt"
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowNonNumericNumbers": "false"}


def without_return(raw: Column) -> Column:
    """The record without one trailing carriage return."""
    return F.regexp_replace(raw, r"\r\z", "")


def csv_well_formed(raw: Column) -> Column:
    """Whether a record is well-formed by RFC 4180 (comma separated, any characters); one pass without backtracking."""
    return raw.rlike(_RECORD.replace("^", r"\A", 1).removesuffix("$") + r"\z")


def csv_fields(raw: Column) -> Column:
    """The fields of a well-formed record, unquoted."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(f",({_FIELD})"), F.lit(1))
    return F.transform(quoted, lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


class _Number(str):
    """A JSON number as it was written."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


def read_json_record(raw: str) -> dict:
    """One JSON record under RECORD; ``ok`` is false unless it is exactly one object by RFC 8259."""
    out = dict.fromkeys(VALUES)
    try:
        row = _DECODER.decode(raw)
    except (ValueError, RecursionError):
        return out | {"ok": False, "odd_type": False}
    if type(row) is not dict:
        return out | {"ok": False, "odd_type": False}
    odd = False
    for name in AUDIO_NAMES + TEXT_NAMES:
        odd |= row.get(name) is not None and type(row[name]) is not str
    for field, names in (("audio_path", AUDIO_NAMES), ("text", TEXT_NAMES)):
        held = [row[x] for x in names if type(row.get(x)) is str]
        out[field] = next((x for x in held if x.strip()), held[0] if held else None)
    for field in ("id", "speaker", "sample_rate", "duration"):
        value = row.get(field)
        out[field] = None if value is None else str(value) if isinstance(value, str) else json.dumps(value)
    return out | {"ok": True, "odd_type": odd}


@F.pandas_udf(RECORD)
def json_record(raw: pd.Series) -> pd.DataFrame:
    """Vectorized read_json_record; nulls, which need no look, give nulls."""
    none = dict.fromkeys(RECORD.names)
    rows = [none if x is None else read_json_record(x) for x in raw]
    # lone surrogates, which an escape may give, have no UTF-8
    clean = [{k: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for k, v in r.items()} for r in rows]
    return pd.DataFrame(clean, columns=RECORD.names)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: Catalyst would otherwise write their expressions into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_filled(values: list[Column]) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[F.when(~v.rlike(_BLANK), v) for v in values])


def _csv_record(got: Column) -> Column:
    names = {"audio_path": AUDIO_NAMES, "text": TEXT_NAMES, "id": ("id",), "speaker": ("speaker",), "sample_rate": ("sample_rate",), "duration": ("duration",)}
    value = {f: first_filled([F.try_element_at(got, F.lit(n)) for n in own]) for f, own in names.items()}
    value["text"] = F.coalesce(value["text"], *[F.try_element_at(got, F.lit(n)) for n in TEXT_NAMES])
    return F.struct(F.lit(True).alias("ok"), F.lit(False).alias("odd_type"), *[value[f].alias(f) for f in names])


def permissive_csv(raw: Column, width: Column, widths: list[int]) -> Column:
    """The fields of a record of ``width`` columns by the permissive reader; null if it is corrupt by that."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": "1000000"}
    out = F.lit(None).cast("array<string>")
    for w in widths:
        names = [f"c{i}" for i in range(w)]
        row = F.array(F.from_csv(raw, ", ".join(f"{n} string" for n in [*names, CORRUPT]), options))
        fields = F.transform(row, lambda r: F.when(r[CORRUPT].isNull(), F.array(*[F.coalesce(r[n], F.lit("")) for n in names])))
        out = F.when(width == w, fields[0]).otherwise(out)
    return out


def permissive_json(raw: Column) -> Column:
    """A record under RECORD by the permissive reader; null if it is corrupt by that, or no flat object with each name once."""
    names = [*AUDIO_NAMES, *TEXT_NAMES, "id", "speaker", "sample_rate", "duration"]
    row = F.array(F.from_json(raw, ", ".join(f"`{n}` string" for n in [*names, CORRUPT]), _STRICT))
    seen = F.regexp_extract_all(raw, F.lit(_KEY), F.lit(1))

    def record(r: Column) -> Column:
        value = {f: F.coalesce(first_filled([r[n] for n in own]), *[r[n] for n in own]) for f, own in (("audio_path", AUDIO_NAMES), ("text", TEXT_NAMES))}
        value |= {f: r[f] for f in ("id", "speaker", "sample_rate", "duration")}
        return F.struct(F.lit(True).alias("ok"), raw.rlike(_ODD).alias("odd_type"), *[value[f].alias(f) for f in VALUES])

    sure = raw.rlike(_FLAT) & (F.size(seen) == F.size(F.array_distinct(seen)))
    return F.when(sure, F.transform(row, lambda r: F.when(r[CORRUPT].isNull(), record(r)))[0])


def classify_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Each raw record with its typed values or the reason why it fails.

    lines: line_id, file_name, raw_line. files: file_name, fmt, header_columns, n_columns, default_sample_rate; one row
    per file. Columns added: reason (null: loaded), audio_path, text, id, speaker, sample_rate, duration. Null and blank
    records are skipped. Records of a file that isn't listed are taken for what its suffix says; of such a CSV only the
    syntax can be checked, and without a header it has no audio path, so it fails with ``invalid_value``. The lines are read
    once. Widths of CSV files are gathered: at most as many as there are files.
    """
    own = files.select("file_name", "fmt", "header_columns", "n_columns", "default_sample_rate").dropDuplicates(["file_name"])
    widths = sorted(r[0] for r in own.where("fmt = 'csv' AND n_columns > 0").select("n_columns").distinct().collect())
    raw = lines.select("line_id", "file_name", without_return(F.col("raw_line")).alias("raw_record")).where(~F.col("raw_record").rlike(_BLANK))
    raw = raw.join(own, "file_name", "left")
    text, fields = F.col("raw_record"), F.col("fields")
    rows = held(raw, csv=F.coalesce(F.col("fmt") == "csv", F.col("file_name").endswith(".csv"), F.lit(False)))
    plain = F.when(F.col("csv") & ~text.rlike(_LENIENT_CSV), permissive_csv(text, F.col("n_columns"), widths))
    rows = held(rows, plain=plain, json=F.when(~F.col("csv"), permissive_json(text)))
    # what is corrupt or was read leniently, once more: quoting, then the count
    doubt = F.col("csv") & F.col("plain").isNull()
    rows = held(rows, well=F.when(doubt, csv_well_formed(text)).otherwise(F.col("csv")))
    rows = held(rows, fields=F.when(doubt & F.col("well"), csv_fields(text)).otherwise(F.col("plain")))
    counts = ~F.coalesce(F.size(fields) == F.col("n_columns"), F.lit(True))
    named = F.when(F.col("well") & ~counts & (F.size(fields) == F.size("header_columns")), F.map_from_arrays("header_columns", "fields"))
    rows = held(rows, named=named, again=json_record(F.when(~F.col("csv") & F.col("json").isNull(), text)))
    rows = held(rows, record=F.when(F.col("csv"), F.when(F.col("named").isNotNull(), _csv_record(F.col("named")))).otherwise(F.coalesce("json", "again")))
    broken = F.when(F.col("csv"), F.when(~F.col("well"), "broken_syntax").when(counts, "column_count")).when(~F.col("record.ok"), "broken_syntax")
    path, rate, length = (F.col(f"record.{x}") for x in ("audio_path", "sample_rate", "duration"))
    blank = lambda c: c.isNull() | c.rlike(_BLANK)
    trim = lambda c: F.regexp_replace(c, r"^[\s 　]++|[\s 　]++$", "")
    good_rate = trim(rate).rlike(r"\A0*+[1-9][0-9]*+\z")
    good_length = trim(length).rlike(r"\A[0-9]++(\.[0-9]++)?\z")
    invalid = F.col("record").isNull() | F.col("record.odd_type") | blank(path) | ~path.rlike(AUDIO_SUFFIXES) | (~blank(rate) & ~good_rate) | (~blank(length) & ~good_length)
    rows = held(rows, reason=F.coalesce(broken, F.when(invalid, "invalid_value")))
    return rows.withColumn("record", F.when(F.col("reason").isNull(), F.col("record"))).select(
        "line_id", "file_name", "raw_record", "reason", "record.audio_path", "record.text",
        F.when(~blank(F.col("record.id")), F.col("record.id")).alias("id"), F.when(~blank(F.col("record.speaker")), F.col("record.speaker")).alias("speaker"),
        F.coalesce(trim(F.col("record.sample_rate")).try_cast("int"), F.when(F.col("reason").isNull(), F.col("default_sample_rate"))).alias("sample_rate"),
        trim(F.col("record.duration")).try_cast("double").alias("duration"),
    )
