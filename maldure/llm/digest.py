"""Percentiles of very large numeric columns by merging centroid digests.

A digest is a sorted list of clusters. Every cluster keeps its mean, weight, least and greatest value. Values are
clustered under a size function that depends on the quantile (the arcsine scale), so clusters are small at both ends
and hold at most about ``pi/2/compression`` of the values in the middle. Digests of parts (partitions, days, files)
are merged by clustering their clusters again. Since clusters keep their ends, a digest bounds every order statistic
strictly; a second pass over the values counts what lies below that bracket and inside it, which certifies the rank
error of the estimate and, with the few distinct values inside the bracket, gives the exact percentile.

Scale: each task makes digests of what it holds, and these are merged in a tree, each node by a stream that holds one
digest; none is collected. The counting pass joins one row per group and reads each value once. Equal values are counted together; the values inside a bracket are a fixed small share of the distinct values, and
are added up over range partitions, so no task sorts a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maldure.operators.order import running_totals
from maldure.tables import checkpoint, small

PERCENTS = (0.5, 0.9, 0.95, 0.99)
#: Clusters per digest are at most about this many.
COMPRESSION = 400
#: A group that is shuffled as a whole has a part for each so many of its rows.
PART_ROWS = 500_000
#: Nodes of a tree's first level.
FAN = 64
#: Values buffered in a task before they are clustered.
BUFFER = 500_000


def cluster(mean, weight, low, high, compression: int = COMPRESSION):
    """Cluster (weighted) values; arrays in, arrays out, sorted by mean."""
    order = np.argsort(mean, kind="stable")
    mean, weight, low, high = mean[order], weight[order], low[order], high[order]
    total = weight.sum()
    if len(mean) <= 1 or total <= 0:
        return mean, weight, low, high
    middle = (np.cumsum(weight) - weight / 2) / total
    scale = np.floor(compression * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) / np.pi + 0.5))
    starts = np.flatnonzero(np.r_[True, scale[1:] != scale[:-1]])
    w = np.add.reduceat(weight, starts)
    return (
        np.add.reduceat(mean * weight, starts) / w,
        w,
        np.minimum.reduceat(low, starts),
        np.maximum.reduceat(high, starts),
    )


def digest_of(values: np.ndarray, compression: int = COMPRESSION):
    """The digest of plain values."""
    values = np.asarray(values, dtype="float64")
    return cluster(values, np.ones(len(values)), values, values, compression)


def merge(digests: Sequence[tuple], compression: int = COMPRESSION):
    """One digest of several, by clustering their clusters again."""
    return cluster(*(np.concatenate(x) for x in zip(*digests)), compression)


def bracket(digest, position: int) -> tuple[float, float]:
    """Strict bounds of the value at the 0-based ``position`` in sorted order."""
    _, weight, low, high = digest
    a, b = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    rank = position + 1
    last = len(low) - 1
    return (
        float(low[a][min(last, np.searchsorted(np.cumsum(weight[a]), rank - 0.5))]),
        float(high[b][min(last, np.searchsorted(np.cumsum(weight[b]), rank - 0.5))]),
    )


def estimate(digest, q: float) -> float:
    """The digest's own estimate of the quantile ``q``: interpolation between cluster means."""
    mean, weight, low, high = digest
    at = q * (weight.sum() - 1)
    centre = np.cumsum(weight) - weight / 2 - 0.5
    return float(np.interp(at, np.r_[0, centre, weight.sum() - 1], np.r_[low.min(), mean, high.max()]))


DIGEST_FIELDS = ("mean", "weight", "low", "high")
_LIST = pa.list_(pa.float64())


def _digest_batch(keys: Sequence[str], key_type: pa.DataType, parts: dict) -> pa.RecordBatch:
    rows = list(parts.items())
    columns = [pa.array([k[i] for k, _ in rows], type=t) for i, t in enumerate(key_type)]
    columns += [pa.array([d[i] for _, d in rows], type=_LIST) for i in range(4)]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, *DIGEST_FIELDS])


def partial_digests(df: DataFrame, keys: Sequence[str], value: str, compression: int = COMPRESSION) -> DataFrame:
    """A digest of each group in each task. Columns: keys and the four lists of a digest. Non-finite values are left out."""
    keys = list(keys)
    types = [df.select(k).schema[0].dataType.simpleString() for k in keys]
    schema = ", ".join([f"`{k}` {t}" for k, t in zip(keys, types)] + [f"{x} array<double>" for x in DIGEST_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        waiting: dict[tuple, list] = {}
        n, arrow = 0, None

        def settle():
            for k, arrays in waiting.items():
                d = digest_of(np.concatenate(arrays), compression)
                held[k] = merge([held[k], d], compression) if k in held else d
            waiting.clear()

        for batch in batches:
            arrow = arrow or [batch.schema.field(i).type for i in range(len(keys))]
            if not batch.num_rows:
                continue
            codes, names = np.zeros(batch.num_rows, dtype="int64"), []
            for i in range(len(keys)):
                coded = batch.column(i).dictionary_encode(null_encoding="encode")
                names.append(coded.dictionary.to_pylist())
                codes = codes * len(names[-1]) + coded.indices.to_numpy(zero_copy_only=False)
            values = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            for code, part in zip(codes[starts], np.split(values, starts[1:])):
                key = []
                for own in reversed(names):
                    code, k = divmod(int(code), len(own))
                    key.append(own[k])
                waiting.setdefault(tuple(reversed(key)), []).append(part)
            n += len(values)
            if n > BUFFER:
                settle()
                n = 0
        settle()
        if held:
            yield _digest_batch(keys, arrow, held)

    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return df.where(finite).select(*keys, F.col(value).cast("double").alias("v")).mapInArrow(run, schema)


def _equal(keys: Sequence[str], other: str = "_k") -> Column:
    """Whether the keys equal those that are called by their number; nulls are equal."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{other}{i}"))
    return same


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str = "_k") -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys])


def merge_digests(parts: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """One digest per group of ``keys``, merged one after another from rows in the order of their keys: a task holds one at a time."""
    keys = list(keys)
    schema = ", ".join([f"`{k}` {parts.select(k).schema[0].dataType.simpleString()}" for k in keys] + [f"{x} array<double>" for x in DIGEST_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, now, waiting, done = None, None, [], {}

        def settle():
            if waiting:
                d = merge(waiting, compression) if len(waiting) > 1 else waiting[0]
                waiting[:] = [d]

        for batch in batches:
            arrow = arrow or [batch.schema.field(i).type for i in range(len(keys))]
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys)))))
            for key, *lists in zip(names, *(batch.column(len(keys) + i).to_pylist() for i in range(4))):
                if key != now and waiting:
                    settle()
                    done[now] = waiting[0]
                    waiting.clear()
                now = key
                waiting.append(tuple(np.array(x) for x in lists))
                if len(waiting) > FAN:
                    settle()
                if len(done) > 1000:
                    yield _digest_batch(keys, arrow, done)
                    done = {}
        settle()
        if waiting:
            done[now] = waiting[0]
        if done:
            yield _digest_batch(keys, arrow, done)

    return parts.select(*keys, *DIGEST_FIELDS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_digests(rows: DataFrame, keys: Sequence[str], value: str, compression: int = COMPRESSION, tasks: int | None = None) -> DataFrame:
    """One digest per group, from what each task holds of it, wherever its rows are. tasks: how many there are, if that is known.

    Of more than FAN tasks the digests are first merged in FAN nodes.
    """
    keys = list(keys)
    if tasks is not None and tasks <= FAN:
        return merge_digests(partial_digests(rows, keys, value, compression), keys, compression)
    parts = partial_digests(rows.withColumn("_node", F.pmod(F.spark_partition_id(), F.lit(FAN))), [*keys, "_node"], value, compression)
    return merge_digests(merge_digests(parts, [*keys, "_node"], compression), keys, compression)


def brackets(digests: DataFrame, keys: Sequence[str], percents: Sequence[float] = PERCENTS) -> DataFrame:
    """What each group's digest says of each percentile. Columns: keys, n (values of the group), at (an array).

    at: of each percentile q, estimate, position and part (linear interpolation takes the values at ``position`` and the next one,
    weighted by ``part``), low and high (strict bounds of both values).
    """
    keys = list(keys)
    fields = ("q", "estimate", "position", "part", "low", "high")
    kinds = (pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    schema = ", ".join([f"`{k}` {digests.select(k).schema[0].dataType.simpleString()}" for k in keys] + ["n long, at array<struct<q: double, estimate: double, position: long, part: double, low: double, high: double>>"])
    entry = pa.list_(pa.struct(list(zip(fields, kinds))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for lists in zip(*(batch.column(len(keys) + i).to_pylist() for i in range(4))):
                d = tuple(np.array(x) for x in lists)
                n = int(round(d[1].sum()))
                counts.append(n)
                out.append([])
                for q in percents:
                    at = q * (n - 1)
                    first = min(int(np.floor(at)), n - 1)
                    low, high = bracket(d, first)[0], bracket(d, min(first + 1, n - 1))[1]
                    out[-1].append(dict(zip(fields, (q, estimate(d, q), first, at - first, low, high))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(counts, type=pa.int64()), pa.array(out, type=entry)], names=[*keys, "n", "at"])

    return digests.select(*keys, *DIGEST_FIELDS).mapInArrow(run, schema)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def spread(rows: DataFrame, keys: Sequence[str], salt: Column, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with ``_part``: a group of more than ``part_rows`` rows has a part for each so many; and the largest number of parts.

    Which groups those are is counted first. They are at most 1 / part_rows of the rows, and are sent out only if they are few.
    """
    keys = list(keys)
    hot = checkpoint(_renamed(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("_parts")).where("_parts > 1"), keys))
    width = hot.agg(F.max("_parts")).first()[0] or 1
    if width == 1:
        return rows.withColumn("_part", F.lit(0)), 1
    own = rows.join(small(hot), _equal(keys), "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return own.withColumn("_part", F.pmod(F.xxhash64(salt), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts"), width


def certified_percentiles(values: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float] = PERCENTS, compression: int = COMPRESSION, tasks: int | None = None) -> DataFrame:
    """Percentiles of ``value`` for each group of ``keys``, exact by linear interpolation, with the digest's certificate.

    values: one row per measurement, spread as they are; they aren't shuffled, but read three times, so pass a checkpoint of
    what is dear to compute (and its number of tasks). Nulls, NaN and infinities are left out; a group without a finite value has
    no row; null keys form a group. Columns: keys, q, n, estimate (by the merged digest alone), exact, rank_error (how many ranks
    the estimate is off at most, by the counting pass) and bracket_rows (values inside the bracket, which were sorted).
    """
    keys = list(keys)
    rows = values.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v"))
    known = checkpoint(brackets(group_digests(rows, keys, "_v", compression, tasks), keys, percents))
    joined = rows.join(small(_renamed(known, keys), written=True), _equal(keys))
    # the counting pass: what lies below each bracket and its estimate, and how often each value inside of one occurs
    v, at = F.col("_v"), lambda i: F.col("at")[i]
    tally = lambda i: F.struct(F.count_if(v < at(i)["low"]).alias("below"), F.count_if(v < at(i)["estimate"]).alias("under"), F.count_if(v <= at(i)["estimate"]).alias("upto"))
    counts = joined.groupBy(*keys).agg(F.array(*[tally(i) for i in range(len(percents))]).alias("counts"))
    facts = counts.join(_renamed(known, keys), _equal(keys)).select(*keys, "n", F.explode(F.arrays_zip("at", "counts")).alias("x")).select(*keys, "n", "x.at.*", "x.counts.*")
    hit = F.explode(F.filter("at", lambda x: (x["low"] <= v) & (v <= x["high"]))["q"])
    inside = running_totals(joined.select(*keys, hit.alias("q"), "_v").groupBy(*keys, "q", "_v").agg(F.count(F.lit(1)).alias("_c")), [*keys, "q"], ["_v"], "_c")
    inside = inside.join(_renamed(facts.select(*keys, "q", "below", "position"), [*keys, "q"]), _equal([*keys, "q"])).drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    place = lambda k: F.min(F.when(F.col("below") + F.col("_upto") > F.col("position") + k, v))
    found = inside.groupBy(*keys, "q").agg(place(0).alias("_first"), place(1).alias("_second"), F.sum("_c").alias("bracket_rows"))
    rows = found.join(_renamed(facts.drop("position", "below"), [*keys, "q"]), _equal([*keys, "q"]))
    one, two = F.col("_first"), F.when(F.col("part") > 0, F.col("_second")).otherwise(F.col("_first"))
    return rows.select(*keys, "q", "n", "estimate", (one + F.col("part") * (two - one)).alias("exact"), rank_error().alias("rank_error"), "bracket_rows")


def rank_error() -> Column:
    """By how many ranks the estimate is off at most, from the values counted under and up to it."""
    target = F.col("q") * (F.col("n") - 1)
    return F.greatest(F.lit(0.0), F.col("under") - target - 1, target - F.col("upto"))


def certify(values: DataFrame, keys: Sequence[str], value: str, known: DataFrame) -> DataFrame:
    """What a counting pass over the values says of estimates that were made without it. known: as from ``brackets``.

    Columns: keys, q, n, estimate, low, high, rank_error. Each task counts on its own, however large a group is.
    """
    keys, v = list(keys), F.col(value)
    rows = values.where(finite(v)).join(small(_renamed(known, keys)), _equal(keys))
    size = len(PERCENTS)
    tally = lambda i: F.struct(F.count_if(v < F.col("at")[i]["estimate"]).alias("under"), F.count_if(v <= F.col("at")[i]["estimate"]).alias("upto"))
    counts = rows.groupBy(*keys).agg(F.first("n").alias("n"), F.first("at").alias("at"), F.array(*[tally(i) for i in range(size)]).alias("counts"))
    out = counts.select(*keys, "n", F.explode(F.arrays_zip("at", "counts")).alias("x")).select(*keys, "n", "x.at.*", "x.counts.*")
    return out.select(*keys, "q", "n", "estimate", "low", "high", rank_error().alias("rank_error"))
