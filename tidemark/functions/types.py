"""Declared scalar types, schema reconciliation and lossless casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared item types and the Spark types that hold all their values (Spark has no unsigned types).
SCALARS: dict[str, T.DataType] = {
    "float64": T.DoubleType(), "float32": T.FloatType(),
    "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(),
    "uint64": T.DecimalType(20, 0), "uint32": T.LongType(), "uint16": T.IntegerType(), "uint8": T.ShortType(),
    "string": T.StringType(), "str": T.StringType(), "utf8": T.StringType(), "categorical": T.StringType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(),
}

WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
MANTISSA = {T.FloatType: 24, T.DoubleType: 53}
FLOATS = (T.FloatType, T.DoubleType)


class SchemaError(ValueError):
    """Columns whose types can't be reconciled, or a cast that would lose a value."""


def scalar_type(name: str) -> T.DataType:
    """The Spark type of a declared name; time zones and other units than microseconds are refused."""
    key = name.strip().lower()
    if key not in SCALARS:
        raise ValueError(f"Unsupported DataItem dtype: {name}")
    return SCALARS[key]


def is_integer(t: T.DataType) -> bool:
    return type(t) in WIDTH or isinstance(t, T.DecimalType) and t.scale == 0


def is_numeric(t: T.DataType) -> bool:
    return is_integer(t) or isinstance(t, (*FLOATS, T.DecimalType))


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The one type both columns take: equal types stay, null gives way, integers widen, other numbers become
    double, text takes the number's type, and anything else is refused."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if is_integer(a) and is_integer(b):
        if type(a) in WIDTH and type(b) in WIDTH:
            return a if WIDTH[type(a)] >= WIDTH[type(b)] else b
        return T.DecimalType(38, 0)
    if is_numeric(a) and is_numeric(b):
        return T.DoubleType()
    for text, number in ((a, b), (b, a)):
        if isinstance(text, T.StringType) and is_numeric(number):
            return number
    raise SchemaError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def reconcile(schemas: list[T.StructType]) -> T.StructType:
    """Columns in first-seen order, each with the common type of those schemas that have it."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            try:
                found[f.name] = supertype(found[f.name], f.dataType) if f.name in found else f.dataType
            except SchemaError as error:
                raise SchemaError(f"{f.name}: {error}") from error
    return T.StructType([T.StructField(n, t) for n, t in found.items()])


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly these columns: cast strictly where types differ, typed nulls where absent."""
    own = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
    return df.select([(F.col(f"`{f.name}`").cast(f.dataType) if own[f.name] != f.dataType else F.col(f"`{f.name}`")) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union of all rows under the reconciled schema."""
    schema = reconcile([f.schema for f in frames])
    return reduce(DataFrame.unionByName, [align_to(f, schema) for f in frames])


def lossless_key(a: T.DataType, b: T.DataType) -> bool:
    """Whether every value of the narrower key type survives in the common type."""
    if a == b or isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True
    to = supertype(a, b) if is_numeric(a) and is_numeric(b) else None
    if to is None:
        return False

    def fits(t: T.DataType) -> bool:
        if t == to:
            return True
        if type(to) in MANTISSA:
            return type(t) in WIDTH and WIDTH[type(t)] <= MANTISSA[type(to)] or type(t) in MANTISSA and MANTISSA[type(t)] <= MANTISSA[type(to)]
        return is_integer(t) and is_integer(to)

    # a small integer beside a 32-bit float needs no double
    pair = {type(a), type(b)}
    if T.FloatType in pair and pair & {T.ByteType, T.ShortType}:
        return True
    return fits(a) and fits(b)


def key_schema(schemas: list[T.StructType], keys: list[str]) -> T.StructType:
    """Common types of the keys; a key whose casts could lose a value is refused."""
    out = []
    for key in keys:
        kinds = [f.dataType for s in schemas for f in s if f.name == key]
        for a, b in zip(kinds, kinds[1:], strict=False):
            if not lossless_key(a, b):
                raise SchemaError(f"key {key}: {a.simpleString()} and {b.simpleString()} have no lossless common type")
        out.append(T.StructField(key, reduce(supertype, kinds)))
    return T.StructType(out)


def lossless_cast(col: Column, source: T.DataType, to: T.DataType) -> Column:
    """Cast that raises where the value doesn't survive the way there and back (signs of zero included)."""
    if source == to:
        return col
    there = col.cast(to)
    back = there.try_cast(source)
    same = back.eqNullSafe(col)
    if isinstance(source, FLOATS):
        same = same & back.cast("string").eqNullSafe(col.cast("string"))
    return F.when(same, there).otherwise(F.raise_error(F.lit(f"value doesn't survive the cast to {to.simpleString()}")).cast(to))


def drop_all_null_types(df: DataFrame) -> DataFrame:
    """Columns that hold nothing but nulls become null-typed, so that they never decide a common type."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select([F.col(f"`{c}`") if counts[c] else F.lit(None).alias(c) for c in df.columns])
