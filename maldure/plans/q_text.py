"""Text functions over the recognition results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.functions import text as X
from maldure.plans.registry import SQL, query
from maldure.tables import load

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _squeeze(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '[{_WS}]+', ' ', 'g'))"


def _strict(c: str) -> str:
    return _squeeze(f"nfc_normalize(coalesce({c}, ''))")


def _agnostic(c: str) -> str:
    return _squeeze(f"regexp_replace(lower({_strict(c)}), '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g')")


def _texts(spark: SparkSession, sf_dir: str, function, *columns: str) -> DataFrame:
    rows = load(spark, sf_dir, "sample_results")
    return rows.select("row_id", *[function(F.col(c)).alias(c) for c in columns or ("reference", "prediction")])


@query("SELECT row_id, coalesce(reference, '') AS reference, coalesce(prediction, '') AS prediction FROM sample_results")
def norm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.raw)


@query(f"SELECT row_id, {_strict('reference')} AS reference, {_strict('prediction')} AS prediction FROM sample_results")
def norm_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.strict)


@query(f"SELECT row_id, {_agnostic('reference')} AS reference, {_agnostic('prediction')} AS prediction FROM sample_results")
def norm_punct_agnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.punctuation_agnostic)


@query()
def norm_kspon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual transcription, noise, fillers, units, numbers as words, basic punctuation only. Its SQL is below, by its steps."""
    return _texts(spark, sf_dir, X.spontaneous)


def _by_preset(c: str) -> str:
    return f"CASE normalization_preset WHEN 'raw' THEN coalesce({c}, '') WHEN 'strict' THEN {_strict(c)} WHEN 'punctuation_agnostic' THEN {_agnostic(c)} END"


@query(f"SELECT row_id, {_by_preset('reference')} AS normalized_reference, {_by_preset('prediction')} AS normalized_prediction FROM sample_results JOIN runs USING (run_id) WHERE normalization_preset <> 'kspon'")
def norm_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row under its run's preset; null where the run names none that is known.

    The SQL has no form for kspon and leaves such runs and those without a preset out: it holds for the other runs. Rows
    of these are tested against a plain Python version.
    """
    runs = load(spark, sf_dir, "runs").select("run_id", "normalization_preset")
    rows = load(spark, sf_dir, "sample_results").join(runs, "run_id")
    preset = F.col("normalization_preset")
    return rows.select("row_id", X.normalize_by(F.col("reference"), preset).alias("normalized_reference"), X.normalize_by(F.col("prediction"), preset).alias("normalized_prediction"))


def _dual(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\(\s*([A-Za-z&\-.](?:[A-Za-z\s&\-.]*[A-Za-z&\-.])?)\s*/[^)]+\)', '\1', 'g'), '\([^/]+/\s*([^) ][^)]*?)\s*\)', '\1', 'g')"


@query(f"SELECT row_id, {_dual('reference')} AS reference, {_dual('prediction')} AS prediction FROM sample_results")
def kspon_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.dual_transcription)


_noise = "text"
for _tag in X.NOISE_TAGS:
    _noise = f"replace({_noise}, '{_tag}', '')"


@query(f"SELECT row_id, {_noise} AS reference FROM (SELECT row_id, reference AS text FROM sample_results)")
def kspon_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.without_noise, "reference")


@query("SELECT row_id, regexp_replace(reference, '([가-힣])/', '\\1', 'g') AS reference FROM sample_results")
def kspon_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.without_filler_slash, "reference")


_units = "reference"
for _unit in X.UNITS:
    _units = f"regexp_replace({_units}, '([0-9]+)[{_WS}]*{_unit}', '\\1 {_unit}', 'g')"


@query(f"SELECT row_id, {_units} AS reference FROM sample_results")
def kspon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, X.units_apart, "reference")


@query("""
WITH d AS (SELECT row_id, ltrim(CAST(row_id AS VARCHAR), '0') AS n FROM sample_results),
p AS (SELECT row_id, n, CAST(ceil(length(n) / 4.0) AS INT) AS g, lpad(n, CAST(ceil(length(n) / 4.0) AS INT) * 4, '0') AS z FROM d),
w AS (SELECT row_id, i, g, substr(z, i * 4 + 1, 4) AS part FROM p, unnest(range(0, g)) t(i)),
s AS (SELECT row_id, i, part, g,
  concat(CASE WHEN part[1] <> '0' THEN concat(['','일','이','삼','사','오','육','칠','팔','구'][CAST(part[1] AS INT) + 1], '천') ELSE '' END,
         CASE WHEN part[2] <> '0' THEN concat(['','일','이','삼','사','오','육','칠','팔','구'][CAST(part[2] AS INT) + 1], '백') ELSE '' END,
         CASE WHEN part[3] <> '0' THEN concat(['','일','이','삼','사','오','육','칠','팔','구'][CAST(part[3] AS INT) + 1], '십') ELSE '' END,
         CASE WHEN part[4] <> '0' THEN ['','일','이','삼','사','오','육','칠','팔','구'][CAST(part[4] AS INT) + 1] ELSE '' END) AS word FROM w)
SELECT d.row_id, CASE WHEN n = '' THEN '공' ELSE (SELECT string_agg(CASE WHEN part = '0000' THEN '' ELSE concat(word, ['','만','억','조'][g - i]) END, '' ORDER BY i) FROM s WHERE s.row_id = d.row_id) END AS spoken FROM d
""")
def num_to_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's number as words."""
    return load(spark, sf_dir, "sample_results").select("row_id", X.number_words(F.col("row_id").cast("string")).alias("spoken"))


def _tokens(spark: SparkSession, sf_dir: str, function) -> DataFrame:
    rows = load(spark, sf_dir, "sample_results").where("normalized_reference IS NOT NULL")
    return rows.select("row_id", F.posexplode(function(F.col("normalized_reference"))).alias("place", "token"))


@query(f"""
SELECT row_id, CAST(i - 1 AS INT) AS place, t[i] AS token FROM (
  SELECT row_id, list_filter(string_split_regex(normalized_reference, '[{_WS}]+'), lambda x: x <> '') AS t FROM sample_results WHERE normalized_reference IS NOT NULL
), unnest(range(1, len(t) + 1)) u(i)
""")
def tokens_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, X.words)


@query("""
SELECT row_id, CAST(i - 1 AS INT) AS place, substr(normalized_reference, i, 1) AS token
FROM sample_results, unnest(range(1, length(normalized_reference) + 1)) u(i) WHERE normalized_reference IS NOT NULL
""")
def tokens_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, X.characters)


@query("""
WITH c AS (SELECT row_id, i, substr(normalized_reference, i, 1) AS c FROM sample_results, unnest(range(1, length(normalized_reference) + 1)) u(i)),
k AS (SELECT row_id, i, c, unicode(c) - 44032 AS k FROM c),
j AS (SELECT row_id, i, CASE WHEN k BETWEEN 0 AND 11171 THEN list_filter([chr(4352 + k // 588), chr(4449 + (k % 588) // 28), CASE WHEN k % 28 > 0 THEN chr(4519 + k % 28) END], lambda x: x IS NOT NULL) ELSE [c] END AS parts FROM k)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i, n) - 1 AS INT) AS place, parts[n] AS token FROM j, unnest(range(1, len(parts) + 1)) v(n)
""")
def tokens_jamo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir, X.jamo_tokens)


def _models(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return load(spark, sf_dir, "leaderboard_rows").select("entry_id", *[c.alias(n) for n, c in columns.items()])


@query("""
SELECT entry_id, CASE WHEN contains(lower(model), 'whisper') THEN 'whisper' WHEN contains(lower(model), 'qwen3-asr') OR contains(lower(model), 'qwen3_asr') THEN 'qwen3_asr'
  WHEN lower(model) = 'mock' OR lower(model) LIKE 'mock\\_%' ESCAPE '\\' THEN 'mock' END AS family FROM leaderboard_rows
""")
def model_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, family=X.model_family(F.col("model")))


@query("""
WITH n AS (SELECT entry_id, model, replace(lower(model), '_', '-') AS low FROM leaderboard_rows)
SELECT entry_id, CASE WHEN contains(model, '/') THEN model
  WHEN starts_with(low, 'whisper-') THEN concat('openai/', low)
  WHEN starts_with(low, 'whisper') AND ltrim(substr(low, 8), '-') <> '' THEN concat('openai/whisper-', ltrim(substr(low, 8), '-'))
  WHEN starts_with(low, 'qwen3-asr-') THEN concat('Qwen/Qwen3-ASR-', upper(replace(substr(low, 11), '-', '.')))
  WHEN starts_with(low, 'qwen3-asr') AND ltrim(substr(low, 10), '-') <> '' THEN concat('Qwen/Qwen3-ASR-', upper(replace(ltrim(substr(low, 10), '-'), '-', '.')))
  ELSE model END AS repo FROM n
""")
def repo_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, repo=X.repo_name(F.col("model")))


@query("""
WITH c AS (SELECT run_id, dataset_name, replace(command, '\\', '/') AS c FROM runs),
m AS (SELECT run_id, dataset_name, regexp_replace(c, '(python\\s+)?\\S*?(^|\\b)([A-Za-z0-9_]+)/main\\.py', 'python -m \\3.main', 'g') AS c FROM c),
a AS (SELECT run_id, dataset_name, c, strpos(c, '--dataset_rootpath ') AS p FROM m)
SELECT run_id, CASE WHEN p = 0 OR c IS NULL THEN c ELSE
  concat(substr(c, 1, p - 1), '--dataset_rootpath ', CASE dataset_name WHEN 'KsponSpeech' THEN '$KSPON_ROOT' WHEN 'AIHubLowQualityTelephone' THEN '$AIHUB_TELEPHONE_ROOT' ELSE '$DATASET_ROOT' END,
         coalesce(regexp_extract(substr(c, p + 19), '\\s--.*$'), '')) END AS command FROM a
""")
def sanitize_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "runs").select("run_id", X.sanitize_command(F.col("command"), F.col("dataset_name")).alias("command"))


@query("SELECT entry_id, replace(replace(model, '/', '-'), '_', '-') AS slug FROM leaderboard_rows")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, slug=X.slug(F.col("model")))


@query("""
SELECT entry_id, CASE WHEN coalesce(subset, '') <> '' THEN concat(d, ' ', CASE WHEN subset = 'default' THEN 'default' WHEN lower(subset) = 'all' THEN 'All' ELSE subset END) ELSE d END AS label
FROM (SELECT entry_id, subset, CASE WHEN dataset = 'AIHubLowQualityTelephone' THEN 'AIHub' ELSE coalesce(nullif(dataset, ''), '-') END AS d FROM leaderboard_rows)
""")
def dataset_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, label=X.slice_label(F.col("dataset"), F.col("subset")))


@query("""
SELECT entry_id, CASE WHEN regexp_matches(r, '^(?i)https?://') THEN r WHEN NOT contains(r, '/') THEN ''
  ELSE concat('https://huggingface.co/', array_to_string(list_transform(string_split(r, '/'), lambda x: url_encode(x)), '/')) END AS url
FROM (SELECT entry_id, trim(coalesce(model_repo, '')) AS r FROM leaderboard_rows)
""")
def repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir, url=X.card_url(F.col("model_repo")))


@query("SELECT row_id, replace(replace(replace(replace(replace(coalesce(prediction, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS html FROM sample_results")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sample_results").select("row_id", X.html_escape(F.col("prediction")).alias("html"))


@query(f"""
SELECT b.entry_id, lower(concat_ws(' ', nullif(model, ''), nullif(model_repo, ''), nullif(dataset, ''), nullif(subset, ''), l.label, nullif(gpu, ''), nullif(run_id, ''), nullif(command, ''), nullif(source, ''))) AS searched
FROM leaderboard_rows b JOIN ({SQL['dataset_label']}) l USING (entry_id)
""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = X.slice_label(F.col("dataset"), F.col("subset"))
    fields = [F.col(c) for c in ("model", "model_repo", "dataset", "subset")] + [label] + [F.col(c) for c in ("gpu", "run_id", "command", "source")]
    return _models(spark, sf_dir, searched=X.search_text(*fields))


@query("""
SELECT entry_id, CASE WHEN isfinite(c) THEN printf('%.4f', c) ELSE '-' END AS cer, CASE WHEN isfinite(l) THEN concat(printf('%.4f', l), 's') ELSE '-' END AS latency,
  CASE WHEN isfinite(o) THEN concat(printf('%.2f', o * 100), '%') ELSE '-' END AS outliers, CASE WHEN total_samples IS NULL THEN '-' ELSE format('{:,}', total_samples) END AS samples
FROM (SELECT entry_id, coalesce(metrics.macro.cer, 'nan'::DOUBLE) AS c, coalesce(metrics.macro.latency, 'nan'::DOUBLE) AS l, total_samples,
  coalesce(outlier_count, 0) / nullif(coalesce(nullif(evaluated_samples, 0), total_samples, 0), 0)::DOUBLE AS p, coalesce(p, 'inf'::DOUBLE) AS o FROM leaderboard_rows)
""")
def fmt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maldure.functions.metrics import outlier_rate

    share = outlier_rate(F.col("outlier_count"), F.col("evaluated_samples"), F.col("total_samples"))
    samples = F.coalesce(F.format_number("total_samples", 0), F.lit("-"))
    return _models(spark, sf_dir, cer=X.fixed(F.col("metrics.macro.cer")), latency=X.fixed(F.col("metrics.macro.latency"), "s"), outliers=X.fixed(share, "%", 100, 2), samples=samples)


@query("""
SELECT entry_id, CASE WHEN coalesce(outlier_policy.metric, '') = '' THEN '-' ELSE concat(outlier_policy.metric, ' > ', CAST(outlier_policy.threshold AS VARCHAR)) END AS policy,
  concat(format('{:,}', coalesce(nullif(evaluated_samples, 0), nullif(total_samples, 0), 0)), ' / ', format('{:,}', coalesce(nullif(dataset_total_samples, 0), nullif(total_samples, 0), 0))) AS samples FROM leaderboard_rows
""")
def row_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlier policy and the sample counts as a board shows them."""
    n = lambda a, b: F.format_number(F.coalesce(F.nullif(F.col(a), F.lit(0)), F.nullif(F.col(b), F.lit(0)), F.lit(0)), 0)
    policy = F.when(F.coalesce(F.col("outlier_policy.metric"), F.lit("")) == "", "-").otherwise(F.concat(F.col("outlier_policy.metric"), F.lit(" > "), F.col("outlier_policy.threshold").cast("string")))
    return _models(spark, sf_dir, policy=policy, samples=F.concat(n("evaluated_samples", "total_samples"), F.lit(" / "), n("dataset_total_samples", "total_samples")))


@query("SELECT entry_id, greatest(3.0, least(100.0, metrics.macro.cer * 100)) AS width FROM leaderboard_rows WHERE metrics.macro.cer IS NOT NULL")
def bar_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "leaderboard_rows").where("metrics.macro.cer IS NOT NULL")
    return rows.select("entry_id", F.greatest(F.lit(3.0), F.least(F.lit(100.0), F.col("metrics.macro.cer") * 100)).alias("width"))


def _number(x: str) -> str:
    """SQL: the words of digits, by their places among sixteen."""
    digits = f"ltrim(translate({x}, '０１２３４５６７８９', '0123456789'), '0')"
    place = lambda i: f"substr(lpad({digits}, 16, '0'), {i + 1}, 1)"
    groups = []
    for g in range(4):
        words = [f"CASE {place(4 * g + j)} {' '.join(f"WHEN '{d}' THEN '{X.DIGIT_WORDS[d]}{X.PLACE_WORDS[3 - j]}'" for d in range(1, 10))} ELSE '' END" for j in range(4)]
        groups.append(f"CASE WHEN substr(lpad({digits}, 16, '0'), {4 * g + 1}, 4) = '0000' THEN '' ELSE {' || '.join(words)} || '{X.GROUP_WORDS[3 - g]}' END")
    return f"CASE WHEN {digits} = '' THEN '{X.ZERO_WORD}' WHEN length({digits}) > 16 THEN {x} ELSE {' || '.join(groups)} END"


def _spontaneous(c: str) -> str:
    text = _dual(f"coalesce({c}, '')")
    for tag in X.NOISE_TAGS:
        text = f"replace({text}, '{tag}', '')"
    text = f"regexp_replace({text}, '([가-힣])/', '\\1', 'g')"
    for unit in X.UNITS:
        text = f"regexp_replace({text}, '([0-9]+)[{_WS}]*{unit}', '\\1 {unit}', 'g')"
    text = f"array_to_string(list_transform(regexp_extract_all({text}, '\\p{{Nd}}+|\\P{{Nd}}+'), lambda x: CASE WHEN regexp_matches(x, '^\\p{{Nd}}') THEN {_number('x')} ELSE x END), '')"
    return _squeeze(f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_{_WS},.?!]', '', 'g')")


SQL["norm_kspon"] = f"SELECT row_id, {_spontaneous('reference')} AS reference, {_spontaneous('prediction')} AS prediction FROM sample_results"
