"""Command line: evaluate a model on a dataset, run a matrix of evaluations, roll up domains, build and validate a board, scan texts.

    python -m maldure.cli evaluate | matrix | rollup | board | validate | scan --help
"""

from __future__ import annotations

import argparse
import json
import platform
import shlex
import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maldure.functions.text import DEFAULT_PRESET, PRESETS, TELEPHONE, model_family, sanitize_command
from maldure.operators import aggregate, inference, jobs, leaderboard, quality
from maldure.operators.order import ranked
from maldure.sources import datasets, files, sinks
from maldure.tables import checkpoint

EVERY_METRIC = ("wer", "cer", "mer", "jer", "ser", "rtf", "latency")


def run_id() -> str:
    """A UTC stamp with microseconds."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


def environment() -> dict[str, str | None]:
    """What a run ran on; without torch its fields are null."""
    held = {"python": platform.python_version(), "platform": platform.platform(), "torch": None, "cuda": None, "gpu": None}
    try:
        import torch
    except ImportError:
        return held
    on = torch.cuda.is_available()
    return held | {"torch": torch.__version__, "cuda": torch.version.cuda, "gpu": torch.cuda.get_device_name(0) if on else None, "gpu_count": str(torch.cuda.device_count() if on else 0)}


def _literal(value, kind: str):
    return F.lit(None).cast(kind) if value is None else F.lit(value).cast(kind)


def board_row(facts: DataFrame, known: dict, head: dict) -> DataFrame:
    """Board rows of aggregated runs. known: a model's repository and sizes; head: the row's other fields, as columns."""
    macro = F.struct(*[F.col(f"macro_{m}").alias(m) for m in aggregate.RATES])
    micro = F.struct(*[F.col(f"micro_{m}").alias(m) for m in (*aggregate.EDIT_RATES, "ser")])
    sizes = F.struct(*[_literal(known.get(x), "bigint" if x.endswith("parameters") else "string").alias(x) for x in inference.SIZES])
    own = {
        "run_id": F.col("run_id"), **head, "metrics": F.struct(macro.alias("macro"), micro.alias("micro"), F.struct("p50", "p90", "p95", "p99").alias("latency_percentiles")),
        "model_metrics": head.get("model_metrics", sizes), "total_samples": F.col("total_samples"), "valid_samples": F.col("valid_samples"), "outlier_count": F.col("outlier_count"),
    }
    return facts.select(*[c.alias(n) for n, c in own.items()])


def log_lines(samples: DataFrame, interval: int, outliers: bool) -> DataFrame:
    """The lines that an evaluation prints: the first sample, every ``interval``-th, and with ``outliers`` each outlier. Columns: index, line."""
    wanted = (F.col("index") == 0) | ((F.col("index") + 1) % max(1, interval) == 0)
    if outliers:
        wanted = wanted | F.col("is_outlier")
    rates = [F.concat(F.lit(f"{m}="), F.coalesce(F.format_string("%.4f", F.col(f"metrics.{m}")), F.lit("-"))) for m in EVERY_METRIC]
    line = F.concat_ws(" ", F.col("index").cast("string"), "sample_id", *rates, F.when(F.col("is_outlier"), "outlier"))
    return samples.where(wanted).select("index", line.alias("line"))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Evaluate a model and write the run's folder."""
    rows = datasets.load_dataset(spark, args.dataset_name, args)
    total = rows.select("place").count()
    if not total:
        raise ValueError(f"{args.dataset_name} has no rows")
    if args.limit:
        rows = rows.orderBy("place").limit(args.limit)
    if args.num_workers:
        rows = rows.repartition(args.num_workers)
    name, known, around = run_id(), inference.FACTS.get(args.model_name, {}), environment()
    facts = inference.evaluate_rows(inference.transcribe(rows, args.model_name, args.batch_size, args.warmup_samples), args.normalization_preset, args.outlier_metric, args.outlier_threshold)
    # inference must not run twice: the facts are written first, and everything else reads them
    staged = f"{args.output_dir}/.staged-{uuid.uuid4().hex}"
    try:
        facts.withColumn("run_id", F.lit(name)).write.parquet(staged)
        samples = ranked(spark.read.parquet(staged), [F.col("place").asc()], "_n").withColumn("index", (F.col("_n") - 1).cast("int")).drop("_n", "place")
        samples = samples.select("index", *[c for c in samples.columns if c != "index"])
        done = F.col("total_samples")
        full = F.lit(not args.limit) & (done == total)
        policy = {"metric": args.outlier_metric, "threshold": args.outlier_threshold}
        command = " ".join(["python -m maldure.cli", *map(shlex.quote, args.arguments)])
        head = {
            "model": F.lit(args.model_name), "model_repo": _literal(known.get("repo"), "string"), "dataset": F.lit(args.dataset_name), "subset": _literal(args.dataset_subset, "string"),
            **{k: _literal(around[k], "string") for k in ("gpu", "torch", "cuda")}, "dataset_total_samples": F.lit(total).cast("bigint"), "evaluated_samples": done,
            "is_full_evaluation": full, "outlier_policy": F.struct(*[F.lit(v).alias(k) for k, v in policy.items()]), "command": F.lit(command),
        }
        row = spark.createDataFrame(board_row(aggregate.aggregate_samples(samples, ["run_id"]), known, head).collect(), files.RUN_ROW)
        board = json.loads(sinks.as_json(row).first()[0])
        family = spark.range(1).select(model_family(F.lit(args.model_name))).first()[0]
        metadata = {
            "run_id": name, "dataset_name": args.dataset_name, "dataset_subset": args.dataset_subset, "model_name": args.model_name, "model_family": family, "model_repo": known.get("repo"), "metrics": list(EVERY_METRIC),
            "normalization_preset": args.normalization_preset, "outlier_policy": policy, "batch_size": args.batch_size, "num_workers": args.num_workers, "limit": args.limit, "dataset_total_samples": total,
            "evaluated_samples": board["evaluated_samples"], "is_full_evaluation": board["is_full_evaluation"], "warmup_samples": args.warmup_samples, "log_interval": args.log_interval, "command": command, "environment": around,
        }
        counts = {k: board[k] for k in ("total_samples", "valid_samples", "outlier_count")}
        summary = {"metadata": metadata, "aggregate": {**counts, "macro_average": board["metrics"]["macro"], "micro_average": board["metrics"]["micro"], "latency_percentiles": board["metrics"]["latency_percentiles"]}, "model_metrics": board["model_metrics"]}
        for r in log_lines(samples, args.log_interval, args.log_outliers).orderBy("index").toLocalIterator():
            print(r["line"])
        folder = f"{args.output_dir}/{name}"
        sinks.write_run(row, samples.drop("run_id"), folder, args.save_predictions, summary)
        print(folder)
    finally:
        sinks.remove(spark, staged)
    return 0


def matrix(spark: SparkSession, args: argparse.Namespace) -> int:
    """Evaluate every model on every slice, one job after another."""
    roots = {"KsponSpeech": args.kspon_root, TELEPHONE: args.aihub_telephone_root}
    subsets = {"KsponSpeech": args.kspon_subsets, TELEPHONE: args.aihub_subsets}
    planned = []
    for model in args.models:
        batch = args.qwen_batch_size if model.startswith("qwen3_asr") else args.whisper_batch_size
        for dataset, own in subsets.items():
            for subset in own:
                given = {
                    "dataset_name": dataset, "dataset_rootpath": roots[dataset], "dataset_subset": subset, "model_name": model, "normalization_preset": args.normalization_preset,
                    "output_dir": args.output_dir, "warmup_samples": args.warmup_samples, "log_interval": args.log_interval, "batch_size": batch, "num_workers": args.num_workers,
                }
                arguments = ["evaluate", *[x for k, v in given.items() for x in (f"--{k}", str(v))], *(["--log_outliers"] if args.log_outliers else [])]
                planned.append({"model": model, "dataset": dataset, "subset": subset, "arguments": arguments})
    done = set()
    if args.skip_existing and sinks.exists(spark, args.output_dir):
        rows = files.read_board_rows(spark, args.output_dir, tolerant=True).where("is_full_evaluation")
        done = {(r["model"], r["dataset"], r["subset"]) for r in rows.select("model", "dataset", "subset").distinct().toLocalIterator()}
    jobs.run_jobs(planned, lambda arguments: main(arguments, spark), done, args.dry_run)
    return 0


def rollup(spark: SparkSession, args: argparse.Namespace) -> int:
    """A run folder for every model whose full runs cover all domains of the telephone dataset, from their samples."""
    if not sinks.exists(spark, args.results_dir):
        print("0 models")
        return 0
    runs = files.read_board_rows(spark, args.results_dir, tolerant=True)
    runs = checkpoint(aggregate.eligible_runs(runs, TELEPHONE).withColumn("run_dir", F.regexp_replace("artifact", "/leaderboard_row.json(/.*)?$", "")))
    samples = files.read_samples(spark, args.results_dir).join(runs.select("run_dir", "run_id"), "run_dir").drop("run_dir")
    for r in aggregate.complete_groups(runs, ["model", "model_repo"]).where("NOT complete").orderBy("model").toLocalIterator():
        print(f"{r['model']}: without {', '.join(r['missing'])}")
    # a row per model, so few
    written = 0
    rolled = aggregate.roll_up(runs, samples)
    for row in rolled.toLocalIterator():
        one = spark.createDataFrame([row], rolled.schema)
        name = f"aggregate-aihub-all-{jobs.slug(row['model'])}-{run_id()}"
        facts = one.withColumn("run_id", F.lit(name))
        command = f"python -m maldure.cli evaluate --dataset_name {TELEPHONE} --dataset_rootpath $AIHUB_TELEPHONE_ROOT --dataset_subset all --model_name {row['model']} --normalization_preset kspon --output_dir results/full"
        first = runs.where(F.col("model").eqNullSafe(F.lit(row["model"])) & F.col("model_repo").eqNullSafe(F.lit(row["model_repo"]))).orderBy("subset", "run_id").first()
        board = json.loads(sinks.as_json(board_row(facts, {}, {k: F.col(k) for k in ("model", "model_repo", "subset", "gpu", "torch", "cuda", "dataset_total_samples", "evaluated_samples", "is_full_evaluation")})).first()[0])
        base = first.asDict(recursive=True)
        board |= {
            "dataset": TELEPHONE, "model_metrics": base["model_metrics"] or {}, "outlier_policy": base["outlier_policy"] or {"metric": "cer", "threshold": 1.0}, "command": command, "source": "aggregated from full runs of D01 to D04",
            "aggregation": {"subsets": list(aggregate.DOMAINS), "source_run_ids": list(row["source_run_ids"])},
        }
        sinks.write_json(spark, f"{args.output_dir}/{name}/leaderboard_row.json", board)
        sinks.write_json(spark, f"{args.output_dir}/{name}/summary.json", {"leaderboard_row": board})
        print(f"{args.output_dir}/{name}")
        written += 1
    print(f"{written} models")
    return 0


def board(spark: SparkSession, args: argparse.Namespace) -> int:
    """Build the board from run folders and a curated list."""
    runs = files.read_board_rows(spark, args.results_dir) if sinks.exists(spark, args.results_dir) else spark.createDataFrame([], files.BOARD_ROW)
    rows = leaderboard.union_rows(runs, files.read_curated(spark, args.curated)).where(F.lit(args.include_partial) | leaderboard.is_full())
    rows = rows.withColumn("command", sanitize_command(F.col("command"), F.col("dataset")))
    if "artifact" not in rows.columns:
        rows = rows.withColumn("artifact", F.lit(None).cast("string"))
    order = [F.col("arrival").asc(), F.asc_nulls_last("artifact"), F.asc_nulls_last("run_id")]
    sinks.write_page_data(leaderboard.dedupe(ranked(rows, order, "entry_id")), args.output_dir)
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Print each problem of a board file (a list), or of one run's row; the exit status says whether there are any."""
    if not sinks.exists(spark, args.path):
        print(f"{args.path}: missing file")
        return 1
    try:
        held = json.loads(sinks.read_text(spark, args.path))
    except ValueError:
        print(f"{args.path}: invalid JSON")
        return 1
    if not isinstance(held, list):
        print(f"{args.path}: expected a list")
        return 1
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(held)], "i long, raw string")
    found = quality.validate_json(rows, "i", "raw").orderBy("i", "problem").collect()
    for r in found:
        print(f"{args.path}[{r['i']}]: {r['problem']}")
    return int(bool(found))


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    """Print each secret and local path in the text files below a folder, with its line; the exit status says whether there are any."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    lines = reader.text(args.path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_id"), "value")
    lines = lines.where(~F.lower("file").rlike(quality.BINARY))
    found = quality.find_texts(lines, ["file", "line_id"], "value").orderBy("file", "line_id", "rule", "start")
    n = 0
    for r in found.toLocalIterator():
        print(f"{r['file']}: {r['rule']} at column {r['start'] + 1}")
        n += 1
    return int(n > 0)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="maldure.cli", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command_name", required=True)

    def command(name, function):
        own = commands.add_parser(name, help=function.__doc__)
        own.set_defaults(function=function)
        return own

    one = command("evaluate", evaluate)
    one.add_argument("--dataset_name", default="mock")
    one.add_argument("--dataset_subset")
    one.add_argument("--dataset_rootpath")
    one.add_argument("--manifest_path", "--manifest")
    one.add_argument("--model_name", default="mock")
    one.add_argument("--batch_size", type=int, default=8)
    one.add_argument("--num_workers", type=int, default=0)
    one.add_argument("--limit", type=int)
    one.add_argument("--normalization_preset", default=DEFAULT_PRESET, choices=sorted(PRESETS))
    one.add_argument("--outlier_metric", default="cer")
    one.add_argument("--outlier_threshold", type=float, default=1.0)
    one.add_argument("--warmup_samples", type=int, default=0)
    one.add_argument("--log_interval", type=int, default=1000)
    one.add_argument("--log_outliers", action="store_true")
    one.add_argument("--output_dir", default="results")
    one.add_argument("--save_predictions", action="store_true")
    many = command("matrix", matrix)
    many.add_argument("--kspon_root", required=True)
    many.add_argument("--aihub_telephone_root", required=True)
    many.add_argument("--output_dir", default="results/full")
    many.add_argument("--models", nargs="+", default=list(jobs.MODELS))
    many.add_argument("--kspon_subsets", nargs="+", default=list(jobs.SLICES["KsponSpeech"]))
    many.add_argument("--aihub_subsets", nargs="+", default=list(jobs.SLICES[TELEPHONE]))
    many.add_argument("--normalization_preset", default="kspon", choices=sorted(PRESETS))
    many.add_argument("--warmup_samples", type=int, default=1)
    many.add_argument("--log_interval", type=int, default=500)
    many.add_argument("--whisper_batch_size", type=int, default=8)
    many.add_argument("--qwen_batch_size", type=int, default=32)
    many.add_argument("--num_workers", type=int, default=0)
    for flag in ("--log_outliers", "--skip_existing", "--dry_run"):
        many.add_argument(flag, action="store_true")
    roll = command("rollup", rollup)
    roll.add_argument("--results_dir", default="results/full")
    roll.add_argument("--output_dir", default="results/aggregated")
    two = command("board", board)
    two.add_argument("--results_dir", default="results")
    two.add_argument("--curated", default="submitted.json")
    two.add_argument("--output_dir", default="board")
    two.add_argument("--include_partial", action="store_true")
    command("validate", validate).add_argument("path")
    command("scan", scan).add_argument("path")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.arguments = sys.argv[1:] if argv is None else argv
    spark = spark or SparkSession.builder.appName("maldure").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.function(spark, args)


if __name__ == "__main__":
    sys.exit(main())
