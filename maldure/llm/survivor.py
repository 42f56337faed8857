"""Best representative of each duplicate group, by skyline selection.

Records of a group are compared by completeness, recency and trust. One record dominates another if it is at least as complete,
as recent and as trusted, and comes first if all is equal. The skyline is the first dominance layer; what is left after taking
it away has the next, and so on. The survivor is the skyline's first record by the lexicographic policy (trust, recency, order
of arrival); fields that it lacks are filled from the layers in turn, within a layer by the same policy.

Completeness is either of two:

- ``fields``: a record is as complete as another if it has at least its fields. The first record by the policy that has a
  field is then never dominated, so a field's best value is always in the first layer, and fills follow the policy alone.
- ``count``: the number of fields with a real value. A record is dominated by fuller ones that lack the very field it has; so
  fields are filled from later layers too, and a fuller record of less trust goes before a poorer one of the first order.

Scale: among records with the same trust and the same fields the first by the policy dominates all others, so a partial
aggregate keeps one champion per (group, trust, set of fields), and the layers are those of the champions. A group of any
size is thereby at most 2 x 2^fields rows before it is gathered; no group is held by one task and no hot group needs salting.
Further fields, of any number and type, aren't compared: each keeps the first record by the policy that has it, in the same
aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What stands for a missing value.
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nan", "unknown", "tbd")
MOST_FIELDS = 10


def real(value: Column) -> Column:
    """The value if it is real: not null, blank or a placeholder."""
    return F.when(~F.lower(F.trim(F.regexp_replace(value, r"[\s 　]+", " "))).isin(*PLACEHOLDERS), value)


def column(path: str) -> Column:
    """The column of a path as ``leaves`` gives it."""
    return F.col(".".join(f"`{x}`" for x in path.split(".")))


def leaves(kind: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """The path (names joined by dots) and type of each field; the fields of a struct stand for it."""
    out: list[tuple[str, T.DataType]] = []
    for f in kind:
        path = prefix + f.name
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def nested(kind: T.StructType, leaf: Callable[[str], Column], prefix: str = "") -> list[Column]:
    """The fields of ``kind``, put together from their leaves; a struct without any is null."""
    out = []
    for f in kind:
        path = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            some = F.coalesce(*[F.when(leaf(p).isNotNull(), True) for p, _ in leaves(f.dataType, f"{path}.")])
            out.append(F.when(some, F.struct(*nested(f.dataType, leaf, f"{path}."))).alias(f.name))
        else:
            out.append(leaf(path).alias(f.name))
    return out


def real_of(value: Column, kind: T.DataType) -> Column:
    """The value if it is real: of a text as ``real`` has it, else not null or NaN."""
    if isinstance(kind, T.StringType):
        return real(value)
    return F.nanvl(value, F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def spelled(value: Column) -> Column:
    """One spelling for a name: letters and digits in lower case; null if there are none or it is a placeholder."""
    name = F.regexp_replace(F.lower(real(value)), r"[^\p{L}\p{N}]+", "")
    return F.when(name != "", name)


def best_representatives(df: DataFrame, keys: Sequence[str], row: str, trust: Column, recency: Column, fields: Sequence[str], others: Sequence[str] = (), completeness: str = "fields") -> DataFrame:
    """One row per group of ``keys``: what survives, and where each field's value comes from.

    row: a unique number, in order of arrival. Rows with a null in any key are in no group. Columns: keys, rows, survivor,
    skyline (records of the first layer), layers, and for each field a struct with value, donor and layer (nulls where
    no record of the group has a real value). Nulls, blanks and placeholders are no values; of repeated rows the
    first to arrive counts; a null recency is the least. fields are strings; by ``fields`` of them any number, of which the
    first MOST_FIELDS are compared (fills of the others are the same without: see above), by ``count`` at most MOST_FIELDS.
    others: any number of further fields of any type, by their paths from ``leaves``; each becomes a struct
    with value and donor, the first record by the policy that has it.
    """
    if completeness not in ("fields", "count"):
        raise ValueError(f"completeness is 'fields' or 'count', not {completeness!r}")
    if not fields or (completeness == "count" and len(fields) > MOST_FIELDS):
        raise ValueError(f"between 1 and {MOST_FIELDS} fields, not {len(fields)}")
    every, fields = list(fields), list(fields)[:MOST_FIELDS]
    wider = every[MOST_FIELDS:]
    others = [*wider, *others]
    types = dict(leaves(df.schema)) if others else {}
    mask = sum((F.when(real(F.col(f)).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fields)), F.lit(0))
    rows = df.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(trust, F.lit(False)).cast("int").alias("_trust"), mask.alias("_mask"),
        F.struct(F.coalesce(recency, F.lit("")).alias("recency"), (-F.col(row)).alias("late"), F.struct(*[real(F.col(f)).alias(f) for f in fields]).alias("value")).alias("_at"),
        *[F.struct(real_of(column(f), types[f]).alias("value"), F.col(row).alias("donor")).alias(f"_o{j}") for j, f in enumerate(others)],
    )
    own = [f"_k{i}" for i in range(len(keys))]
    place = F.struct("_trust", "_at.recency", "_at.late")
    kept = [F.max_by(F.struct(place.alias("place"), F.col(f"_o{j}").alias("at")), F.when(F.col(f"_o{j}.value").isNotNull(), place)).alias(f"_o{j}") for j in range(len(others))]
    champions = rows.where(F.concat(*[F.col(k).cast("string") for k in own]).isNotNull()).groupBy(*own, "_trust", "_mask").agg(F.max("_at").alias("_at"), F.count(F.lit(1)).alias("_n"), *kept)
    record = F.struct(F.col("_trust").alias("trust"), F.col("_at.recency").alias("recency"), F.col("_at.late").alias("late"), F.col("_mask").alias("mask"), F.col("_at.value").alias("value"))
    # in the policy's order every record comes after those that dominate it
    groups = champions.groupBy(*own).agg(F.sum("_n").alias("rows"), F.sort_array(F.collect_list(record), asc=False).alias("_all"), *[F.max_by(f"_o{j}.at", f"_o{j}.place").alias(f"_o{j}") for j in range(len(others))])

    def layered(acc: Column, x: Column) -> Column:
        fuller = (lambda y: F.bit_count(y["mask"]) >= F.bit_count(x["mask"])) if completeness == "count" else (lambda y: y["mask"].bitwiseAND(x["mask"]) == x["mask"])
        over = F.filter(acc, lambda y: fuller(y) & (y["recency"] >= x["recency"]))
        layer = F.coalesce(F.array_max(F.transform(over, lambda y: y["layer"])), F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(layer.alias("layer"), F.size(acc).alias("place"), x["mask"].alias("mask"), x["recency"].alias("recency"), (-x["late"]).alias("row"), x["value"].alias("value"))))

    kind = dict(groups.select(F.element_at("_all", 1)["value"].alias("v")).dtypes)["v"]
    late = dict(groups.select((-F.element_at("_all", 1)["late"]).alias("v")).dtypes)["v"]
    start = F.from_json(F.lit("[]"), f"array<struct<layer:int,place:int,mask:int,recency:string,row:{late},value:{kind}>>")
    groups = groups.withColumn("_all", F.aggregate("_all", start, layered))
    def having(bit: int) -> Column:
        have = F.filter("_all", lambda x: x["mask"].bitwiseAND(F.lit(bit)) != 0)
        return F.try_element_at(F.sort_array(have), F.lit(1))  # by layer, then by the policy

    groups = groups.withColumns({f"_best{i}": having(1 << i) for i in range(len(fields))})
    donors = [F.struct(F.col(f"_best{i}.value").getField(f).alias("value"), F.col(f"_best{i}.row").alias("donor"), F.col(f"_best{i}.layer").alias("layer")).alias(f) for i, f in enumerate(fields)]
    first = F.filter("_all", lambda x: x["layer"] == 1)
    return groups.select(
        *[F.col(o).alias(k) for o, k in zip(own, keys)], "rows",
        F.element_at("_all", 1)["row"].alias("survivor"), F.size(first).alias("skyline"), F.array_max(F.transform("_all", lambda x: x["layer"])).alias("layers"), *donors,
        *[F.struct(F.col(f"_o{j}.value").alias("value"), F.col(f"_o{j}.donor").alias("donor"), F.when(F.col(f"_o{j}.donor").isNotNull(), 1).alias("layer")).alias(f) for j, f in enumerate(wider)],
        *[F.struct(F.col(f"_o{j}.value").alias("value"), F.col(f"_o{j}.donor").alias("donor")).alias(f) for j, f in enumerate(others) if j >= len(wider)],
    )
