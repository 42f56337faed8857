"""Data quality: validation of leaderboard rows, and the search for secrets and local paths in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that a published row must have, and its metrics that must and may be there.
REQUIRED = ("run_id", "model", "model_repo", "dataset", "metrics", "total_samples", "dataset_total_samples", "evaluated_samples", "is_full_evaluation", "outlier_count", "outlier_policy")
REQUIRED_METRICS = ("wer", "cer", "mer", "jer")
OPTIONAL_METRICS = ("ser", "rtf", "latency")
# Patterns of secrets and of local paths.
SECRETS = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "github": r"ghp_[A-Za-z0-9_]{20,}",
    "github_fine": r"github_pat_[A-Za-z0-9_]{20,}",
    "hub": r"hf_[A-Za-z0-9]{20,}",
    "sk": r"sk-[A-Za-z0-9]{20,}",
    "slack": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "assigned": r"(?i)(?:api[_-]?key|secret|password|token)\s*=\s*['\"][^'\"]{8,}['\"]",
}
LOCAL_PATHS = {"windows_home": r"(?i)C:\\Users\\", "mount": r"(?i)/mnt/[a-z]/", "ide_projects": r"(?i)PycharmProjects"}


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def row_rules() -> dict[str, Column]:
    """The rules for typed rows; each is true where broken."""
    positive = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    rules = {
        "mock": F.coalesce(F.col("model") == "mock", F.lit(False)) | F.coalesce(F.col("dataset") == "mock", F.lit(False)),
        "is_full_evaluation": ~F.col("is_full_evaluation").eqNullSafe(F.lit(True)),
        "evaluated_samples": positive("evaluated_samples"),
        "dataset_total_samples": positive("dataset_total_samples"),
        "total_samples": positive("total_samples"),
        "evaluated_differs": F.coalesce(F.col("evaluated_samples") != F.col("dataset_total_samples"), F.lit(False)),
        "metrics": F.col("metrics").isNull(),
        "metrics.macro": F.col("metrics.macro").isNull(),
        "outlier_policy": F.col("outlier_policy").isNull(),
    }
    rules |= {f"metrics.macro.{m}": F.col(f"metrics.macro.{m}").isNull() for m in REQUIRED_METRICS}
    return rules | {f"command.{name}": F.coalesce(F.col("command").rlike(pattern), F.lit(False)) for name, pattern in LOCAL_PATHS.items()}


def validate_rows(rows: DataFrame, key: str = "entry_id") -> DataFrame:
    """A row for each problem of each row. Columns: key, problem."""
    return rows.select(key, F.explode(problems(row_rules())).alias("problem"))


def validate_json(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """The same for rows as JSON text, where types and presence count too. Columns: key, problem."""
    row = F.try_parse_json(F.col(raw))
    as_text = lambda path: F.try_variant_get(row, path, "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(row, path, "variant"))
    numeric = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    value = lambda path: F.when(numeric(path), F.try_variant_get(row, path, "double"))
    is_object = lambda path: F.coalesce(kind(path).startswith("OBJECT"), F.lit(False))
    present = F.coalesce(F.json_object_keys(F.col(raw)), F.array().cast("array<string>"))
    command = F.coalesce(as_text("$.command"), F.lit(""))
    rules = {f"missing.{name}": ~F.array_contains(present, name) for name in REQUIRED}
    rules |= {
        "mock": F.coalesce(as_text("$.model") == "mock", F.lit(False)) | F.coalesce(as_text("$.dataset") == "mock", F.lit(False)),
        "is_full_evaluation": ~(F.coalesce(kind("$.is_full_evaluation") == "BOOLEAN", F.lit(False)) & F.coalesce(as_text("$.is_full_evaluation") == "true", F.lit(False))),
        **{n: F.coalesce(value(f"$.{n}") <= 0, F.lit(True)) for n in ("evaluated_samples", "dataset_total_samples", "total_samples")},
        "evaluated_differs": F.coalesce(value("$.evaluated_samples") != value("$.dataset_total_samples"), F.lit(False)),
        "metrics": ~is_object("$.metrics"),
        "metrics.macro": ~is_object("$.metrics.macro"),
        **{f"metrics.macro.{m}": ~numeric(f"$.metrics.macro.{m}") for m in REQUIRED_METRICS},
        **{f"metrics.macro.{m}": F.coalesce(~kind(f"$.metrics.macro.{m}").isin("VOID"), F.lit(False)) & ~numeric(f"$.metrics.macro.{m}") for m in OPTIONAL_METRICS},
        "outlier_policy": kind("$.outlier_policy.metric").isNull() | kind("$.outlier_policy.threshold").isNull(),
        **{f"command.{n}": command.rlike(p) for n, p in LOCAL_PATHS.items()},
    }
    parsed = rows.select(key, F.when(F.col(raw).isNull() | row.isNull(), F.array(F.lit("invalid_json"))).when(~F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False)), F.array(F.lit("not_an_object"))).otherwise(problems(rules)).alias("p"))
    return parsed.select(key, F.explode("p").alias("problem"))


# Suffixes of files that aren't searched.
BINARY = r"\.(png|jpe?g|gif|ico|pdf|zip|gz|wav|pcm|flac|parquet|pyc)$"


def find_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every match of a secret or local-path pattern, with where it begins. Columns: keys, rule, start (from 0), match."""
    patterns = {**SECRETS, **LOCAL_PATHS}
    likely = F.col(text).rlike("|".join(f"(?:{p})" for p in patterns.values()))

    def spots(name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        # matches don't overlap and come in order: each is looked for behind the one before
        none = F.array().cast("array<struct<rule: string, start: int, match: string>>")
        behind = lambda done: F.when(F.size(done) > 0, F.element_at(done, -1)["start"] + F.length(F.element_at(done, -1)["match"])).otherwise(0)
        add = lambda done, x: F.concat(done, F.array(F.struct(F.lit(name).alias("rule"), (F.call_function("locate", x, F.col(text), behind(done) + 1) - 1).alias("start"), x.alias("match"))))
        return F.aggregate(found, none, add)

    return df.where(likely).select(*keys, F.explode(F.concat(*[spots(n, p) for n, p in patterns.items()])).alias("m")).select(*keys, "m.*")


def scan_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every match of a secret or local-path pattern. Columns: key, rule, hits (number of matches in the text).

    Texts are tested and counted inside the JVM; none is shortened.
    """
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("hits")) for n, p in {**SECRETS, **LOCAL_PATHS}.items()])
    likely = F.col(text).rlike("|".join(f"(?:{p})" for p in {**SECRETS, **LOCAL_PATHS}.values()))
    return df.where(likely).select(key, F.explode(each).alias("m")).select(key, "m.rule", "m.hits").where("hits > 0")
