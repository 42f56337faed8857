"""Error rates, edit operations and performance figures.

Tokens become single characters (in Arrow batches), so that Spark's own ``levenshtein`` counts tokens. Counts of the four edit
operations need the table's path; they come from one Arrow-batched function that fills the tables of many rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maldure.functions.text import jamo

INF = float("inf")
#: Rows whose tables are filled together, and the most cells of a table that are held for all of them.
ROWS, CELLS = 4096, 4_000_000


def finite(value: Column) -> Column:
    """The value if it is finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INF)), value)


PAIR = T.StructType([T.StructField("p", T.StringType()), T.StructField("r", T.StringType())])


def coded(prediction: Column, reference: Column, tokenizer: Callable[[str], Sequence[str]]) -> Column:
    """Both texts with one character for each distinct token of the row, in Arrow batches; null texts stay null."""

    @F.pandas_udf(PAIR)
    def code(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(prediction, reference):
            codes: dict[str, str] = {}
            one = lambda t: codes.setdefault(t, chr(0x20000 + len(codes)))  # noqa: B023, E731
            rows.append([None if x is None else "".join(one(t) for t in tokenizer(x)) for x in (a, b)])
        return pd.DataFrame(rows, columns=["p", "r"])

    return code(prediction, reference)


def coded_words(prediction: Column, reference: Column) -> Column:
    """``coded`` for words between white space."""
    return coded(prediction, reference, str.split)


def rate(distance: Column, length: Column, other: Column) -> Column:
    """Distance over the reference's length; of an empty reference 0 if the prediction is empty too, else infinite."""
    return F.when(distance.isNotNull(), F.when(length > 0, distance / length).when(other > 0, F.lit(INF)).otherwise(F.lit(0.0)))


def cer(prediction: Column, reference: Column) -> Column:
    return rate(F.levenshtein(prediction, reference), F.length(reference), F.length(prediction))


def jer(prediction: Column, reference: Column) -> Column:
    p, r = jamo(prediction), jamo(reference)
    return rate(F.levenshtein(p, r), F.length(r), F.length(p))


def mer(prediction: Column, reference: Column, tokenizer: Callable[[str], Sequence[str]]) -> Column:
    """Morpheme error rate with the given tokenizer (text to tokens), which is not part of this package."""

    both = coded(prediction, reference, tokenizer)
    return rate(F.levenshtein(both.p, both.r), F.length(both.r), F.length(both.p))


def wer(prediction: Column, reference: Column) -> Column:
    both = coded_words(prediction, reference)
    return rate(F.levenshtein(both.p, both.r), F.length(both.r), F.length(both.p))


def ser(prediction: Column, reference: Column) -> Column:
    return (prediction != reference).cast("double")


def edit_table(u: np.ndarray, v: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distance, substitutions, deletions and insertions of many pairs at once.

    u, v: codes, a row per pair, filled up beyond the lengths n, m. Of equal costs a substitution (or match) is preferred to
    a deletion from u, and that to an insertion.
    """
    rows, width = u.shape[0], v.shape[1]
    deletion, insertion = 1 << 20, 1 << 40  # the three counts of a cell are one number
    out = np.zeros((rows, 4), dtype="int32")
    every = np.arange(rows)
    cost = np.repeat(np.arange(width + 1, dtype="int32")[:, None], rows, axis=1)
    path = cost.astype("int64") * insertion

    def take(done):
        held = path[m[done], every[done]]
        out[done] = np.stack([cost[m[done], every[done]], held % deletion, held // deletion % deletion, held // insertion], axis=1)

    take(n == 0)
    for x in range(1, u.shape[1] + 1):
        differ = u[:, x - 1][None, :] != v.T
        sub, dele = cost[:-1] + differ, cost[1:] + 1
        diagonal = sub <= dele
        base, base_path = np.where(diagonal, sub, dele), np.where(diagonal, path[:-1] + differ, path[1:] + deletion)
        cost, path = np.empty_like(cost), np.empty_like(path)
        cost[0], path[0] = x, x * deletion
        for y in range(1, width + 1):
            ins = cost[y - 1] + 1
            keep = base[y - 1] <= ins
            cost[y] = np.where(keep, base[y - 1], ins)
            path[y] = np.where(keep, base_path[y - 1], path[y - 1] + insertion)
        take(n == x)
    return out


def edit_counts(left: Sequence[Sequence], right: Sequence[Sequence]) -> np.ndarray:
    """edit_table of token sequences (strings count as sequences of characters), in batches of like size; equal ones need no table."""
    out = np.zeros((len(left), 4), dtype="int32")
    order = sorted((i for i in range(len(left)) if left[i] != right[i]), key=lambda i: (len(left[i]), len(right[i])))
    start = 0
    while start < len(order):
        end, wide = start, 1
        while end < len(order) and end - start < ROWS:
            wide = max(wide, len(right[order[end]]) + 1)
            if end > start and (wide * (end - start + 1) > CELLS or len(left[order[end]]) > 2 * len(left[order[start]]) + 16):
                break
            end += 1
        part = order[start:end]
        codes: dict = {}
        n, m = (np.array([len(side[i]) for i in part]) for side in (left, right))
        u, v = np.full((len(part), max(1, n.max())), -1), np.full((len(part), max(1, m.max())), -2)
        for k, i in enumerate(part):
            u[k, : n[k]] = [codes.setdefault(t, len(codes)) for t in left[i]]
            v[k, : m[k]] = [codes.setdefault(t, len(codes)) for t in right[i]]
        out[part] = edit_table(u, v, n, m)
        start = end
    return out


EDIT_OPS = T.StructType([T.StructField(x, T.IntegerType()) for x in ("distance", "substitutions", "deletions", "insertions")])


@F.pandas_udf(EDIT_OPS)
def edit_ops(u: pd.Series, v: pd.Series) -> pd.DataFrame:
    """Edit operations that turn the tokens (or characters) of u into those of v; nulls count as empty."""
    empty = lambda x: () if x is None else x
    return pd.DataFrame(edit_counts([empty(x) for x in u], [empty(x) for x in v]), columns=EDIT_OPS.names)


def measured(name: str, prediction: Column, reference: Column, tokenizer: Callable[[str], Sequence[str]] | None = None) -> Column:
    """Rate, hits, substitutions, deletions and insertions of ``wer``, ``cer``, ``jer`` or (with a tokenizer) ``mer``, by one comparison.

    Words are compared from the reference to the prediction, so that ``wer``'s insertions and deletions are
    the other way round than those of the others, and its hits are counted in the prediction.
    """
    if name == "wer":
        both = coded_words(prediction, reference)
        u, v, total, other = both.r, both.p, F.length(both.r), F.length(both.p)
    else:
        u, v = (prediction, reference) if name == "cer" else (jamo(prediction), jamo(reference))
        if name == "mer":
            both = coded(prediction, reference, tokenizer)
            u, v = both.p, both.r
        total, other = F.length(v), F.length(u)
    ops = edit_ops(u, v)
    return F.struct(
        rate(ops.distance, total, other).alias("rate"), (F.length(v) - ops.substitutions - ops.insertions).alias("hits"),
        ops.substitutions.alias("substitutions"), ops.insertions.alias("deletions"), ops.deletions.alias("insertions"),
    )


def counts(name: str, prediction: Column, reference: Column) -> Column:
    """Hits, substitutions, deletions and insertions, as ``measured`` has them."""
    own = measured(name, prediction, reference)
    return F.struct(*[own[x].alias(x) for x in ("hits", "substitutions", "deletions", "insertions")])


RATES: dict[str, Callable[[Column, Column], Column]] = {"wer": wer, "cer": cer, "jer": jer, "ser": ser}


def evaluate(prediction: Column, reference: Column, metrics: Sequence[str]) -> dict[str, Column]:
    """The named metrics as columns; unknown names are passed over."""
    return {name: RATES[name](prediction, reference) for name in metrics if name in RATES}


def rtf(time: Column, duration: Column) -> Column:
    """Processing time over audio length; infinite for no audio."""
    return F.when(duration == 0, F.lit(INF)).otherwise(time / duration)


def audio_duration(samples: Column, rate_: Column) -> Column:
    return F.when(rate_ <= 0, F.lit(0.0)).otherwise(samples / rate_)


def sample_rate(given: Column, default: int = 16000) -> Column:
    return F.coalesce(F.nullif(given, F.lit(0)), F.lit(default))


def is_outlier(value: Column, threshold: Column | float) -> Column:
    """Strictly above the threshold; missing values and NaN are not."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))


def outlier_rate(outliers: Column, evaluated: Column, total: Column) -> Column:
    """Outliers over evaluated (else all) samples; infinite if there are none."""
    n = F.coalesce(F.nullif(evaluated, F.lit(0)), F.nullif(total, F.lit(0)))
    return F.when(n > 0, F.coalesce(outliers, F.lit(0)) / n).otherwise(F.lit(INF))
