"""Problem 2: records of manifest_lines that can't be loaded, and the typed rows of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maldure.operators.badrows import AUDIO_NAMES, TEXT_NAMES, classify_records
from maldure.plans.registry import query
from maldure.tables import load


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_records(load(spark, sf_dir, "manifest_lines").select("line_id", "file_name", "raw_line"), load(spark, sf_dir, "manifest_files"))


_CELL = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{3000}]*"
_NAMES = (*AUDIO_NAMES, *TEXT_NAMES, "id", "speaker", "sample_rate", "duration")


def _blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, '{_SPACE}'))"


def _value(name: str) -> str:
    """SQL: a field of a CSV record by its header, or of a JSON object as text."""
    return f"CASE WHEN csv THEN CASE WHEN list_position(h, '{name}') > 0 THEN cells[list_position(h, '{name}')] END WHEN json_type(j, '$.{name}') <> 'NULL' THEN json_extract_string(j, '$.{name}') END"


_ODD = " OR ".join(f"coalesce(json_type(j, '$.{n}') NOT IN ('NULL', 'VARCHAR'), false)" for n in (*AUDIO_NAMES, *TEXT_NAMES))
_PATH = "coalesce(" + ", ".join(f"CASE WHEN NOT {_blank(n)} THEN {n} END" for n in AUDIO_NAMES) + ")"
#: A record without its strings, and what that engine's reader takes in it though it is no JSON.
_BARE = r"""regexp_replace(r, '"(?:[^"\\]|\\.)*"', '""', 'g')"""
_LAX = r"',\s*[}\]]|NaN|nan|[Ii]nf|/'"
#: SQL: every record taken apart (table judged, with the reason of those that fail).
CLASSIFIED = f"""
WITH raw AS (
  SELECT line_id, file_name, default_sample_rate, header_columns AS h, n_columns AS n, coalesce(fmt = 'csv', ends_with(file_name, '.csv')) AS csv, regexp_replace(raw_line, '\\r$', '') AS r
  FROM manifest_lines LEFT JOIN manifest_files USING (file_name) WHERE raw_line IS NOT NULL
), taken AS (
  SELECT *, csv AND regexp_full_match(r, '{_CELL}(?:,{_CELL})*') AS well, CASE WHEN NOT csv AND json_valid(r) AND NOT regexp_matches({_BARE}, {_LAX}) THEN r::JSON END AS j,
         CASE WHEN csv THEN list_transform(regexp_extract_all(',' || r, ',({_CELL})', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS cells
  FROM raw WHERE NOT {_blank("r")}
), broken AS (
  SELECT *, CASE WHEN csv AND NOT well THEN 'broken_syntax' WHEN csv AND len(cells) <> n THEN 'column_count' WHEN NOT csv AND (j IS NULL OR json_type(j) <> 'OBJECT') THEN 'broken_syntax' END AS b FROM taken
), named AS (
  SELECT *, {", ".join(f"{_value(n)} AS {n}" for n in _NAMES)} FROM broken WHERE b IS NULL
), judged AS (
  SELECT *, CASE WHEN (NOT csv AND ({_ODD})) OR {_PATH} IS NULL OR NOT regexp_matches({_PATH}, '(?i)\\.(wav|pcm|flac)$')
    OR (NOT {_blank("sample_rate")} AND NOT regexp_full_match(sample_rate, '{_SPACE}0*[1-9][0-9]*{_SPACE}'))
    OR (NOT {_blank("duration")} AND NOT regexp_full_match(duration, '{_SPACE}[0-9]+(\\.[0-9]+)?{_SPACE}'))
    OR (NOT csv AND regexp_matches(r, '"(?:duration|sample_rate)"\\s*:\\s*-?[0-9.]+[eE]')) THEN 'invalid_value' END AS reason FROM named
)"""
_SQL = f"""{CLASSIFIED}
SELECT line_id, b AS reason FROM broken WHERE b IS NOT NULL UNION ALL SELECT line_id, reason FROM judged WHERE reason IS NOT NULL
"""


@query(_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fail, with the first reason that applies."""
    return _classified(spark, sf_dir).where("reason IS NOT NULL").select("line_id", "reason")


_TEXT = "coalesce(" + ", ".join([*(f"CASE WHEN NOT {_blank(n)} THEN {n} END" for n in TEXT_NAMES), *TEXT_NAMES]) + ")"


@query(f"""{CLASSIFIED}
SELECT line_id, file_name, {_PATH} AS audio_path, {_TEXT} AS text, CASE WHEN NOT {_blank("id")} THEN id END AS id, CASE WHEN NOT {_blank("speaker")} THEN speaker END AS speaker,
  coalesce(TRY_CAST(trim(sample_rate) AS INT), default_sample_rate) AS sample_rate, TRY_CAST(trim(duration) AS DOUBLE) AS duration FROM judged WHERE reason IS NULL
""")
def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load, typed."""
    return _classified(spark, sf_dir).where("reason IS NULL").drop("reason", "raw_record")
