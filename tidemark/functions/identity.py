"""Identity of rows and frames: typed row tokens, multiset digests, null-safe differences."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import FLOATS


def _tagged(text: Column) -> Column:
    return F.concat(F.char_length(text).cast("string"), F.lit(":"), text)


def token(col: Column, kind: T.DataType) -> Column:
    """Text that two values of the type share only if they are the same value: null, NaN and the signs of zero differ."""
    if isinstance(kind, T.StructType):
        body = F.concat(F.lit("{"), *[token(col.getField(f.name), f.dataType) for f in kind], F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: token(x, kind.elementType)), ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return token(F.array_sort(F.map_entries(col)), entries)
    elif isinstance(kind, T.BinaryType):
        body = _tagged(F.hex(col))
    elif isinstance(kind, T.NullType):
        return F.lit("n")
    else:
        body = _tagged(col.cast("string"))
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), body))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """sha256 over the columns' names, types and values."""
    kinds = {f.name: f.dataType for f in df.schema}
    header = ",".join(f"{c}={kinds[c].simpleString()}" for c in columns)
    return F.sha2(F.concat(F.lit(header + ";"), *[token(F.col(f"`{c}`"), kinds[c]) for c in columns]), 256)


def frame_digest(df: DataFrame) -> str:
    """Digest of the rows as a multiset and of the schema: order doesn't matter, repetition does (H2)."""
    columns = sorted(df.columns)
    hashed = df.select(row_hash(df, columns).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(38,0)"))
    n, a, b = hashed.agg(F.count(F.lit(1)), part(1), part(20)).first()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return record_hash({"schema": [[c, kinds[c]] for c in columns], "rows": n, "sums": [str(a), str(b)]})


def grouped_digests(df: DataFrame, by: str, drop: tuple[str, ...] = ()) -> dict:
    """(rows, ``frame_digest``) of each group's rows, in one job; groups are few."""
    columns = sorted(c for c in df.columns if c not in drop)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(38,0)"))
    found = df.select(F.col(by).alias("g"), row_hash(df, columns).alias("h")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(20).alias("b"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = [[c, kinds[c]] for c in columns]
    return {r["g"]: (r["n"], record_hash({"schema": schema, "rows": r["n"], "sums": [str(r["a"]), str(r["b"])]})) for r in found.collect()}


def record_hash(value) -> str:
    """Stable hash of a JSON value (H3, H5)."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def comparable(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Columns as compared by differences: floats as text, so that NaN equals NaN and -0.0 isn't 0.0 (H4)."""
    kinds = {f.name: f.dataType for f in df.schema}
    return {c: F.col(f"`{c}`").cast("string") if isinstance(kinds[c], FLOATS) else F.col(f"`{c}`") for c in columns}


def rows_not_in(left: DataFrame, right: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of left whose identity no row of right has; nulls equal nulls."""
    probe = left.select("*", *[c.alias(f"__l{i}") for i, c in enumerate(comparable(left, identity).values())])
    build = right.select(*[c.alias(f"__r{i}") for i, c in enumerate(comparable(right, identity).values())]).distinct()
    same = reduce(Column.__and__, [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) for i in range(len(identity))])
    return probe.join(build, same, "left_anti").select(*[F.col(f"`{c}`") for c in left.columns])


def withdrawn(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of previous whose key is gone."""
    return previous.join(current.select(*keys).distinct(), keys, "left_anti")


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Tuples whose multiplicity differs: columns, left_count, right_count (J19). One pass over both sides."""
    side = lambda df, a, b: df.select(*columns, F.lit(a).alias("__l"), F.lit(b).alias("__r"))
    both = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*columns)
    return both.agg(F.sum("__l").alias("left_count"), F.sum("__r").alias("right_count")).where("left_count <> right_count")
