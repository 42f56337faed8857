"""Which words and characters differ between reference and prediction, as blocks of the longest-match comparison."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maldure.functions.text import characters, words

BLOCKS = T.ArrayType(T.StructType([T.StructField("operation", T.StringType()), T.StructField("reference", T.ArrayType(T.StringType())), T.StructField("prediction", T.ArrayType(T.StringType()))]))


def difference(reference: list[str], prediction: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """The blocks that differ, in order."""
    codes = SequenceMatcher(None, reference, prediction).get_opcodes()
    return [(kind, list(reference[a:b]), list(prediction[c:d])) for kind, a, b, c, d in codes if kind != "equal"]


@F.pandas_udf(BLOCKS)
def blocks(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([difference(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(reference, prediction)], dtype="object")


def error_blocks(rows: DataFrame, key: str, reference: Column, prediction: Column) -> DataFrame:
    """A row per differing block. Columns: key, level (word or char), place, operation, reference, prediction. Equal texts have none."""
    own = rows.where(reference != prediction).select(key, blocks(words(reference), words(prediction)).alias("w"), blocks(characters(reference), characters(prediction)).alias("c"))
    both = F.array(F.struct(F.lit("word").alias("level"), F.col("w").alias("b")), F.struct(F.lit("char").alias("level"), F.col("c").alias("b")))
    return own.select(key, F.explode(both).alias("x")).select(key, "x.level", F.posexplode("x.b").alias("place", "o")).select(key, "level", "place", "o.operation", "o.reference", "o.prediction")
