"""Fixed tables as part of the plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _plain(value, kind: T.DataType):
    """Structs as dicts, which is how Arrow takes them."""
    if isinstance(kind, T.StructType) and value is not None and not isinstance(value, dict):
        return {f.name: _plain(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_plain(v, kind.elementType) for v in value]
    return value


def small_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A local relation: Spark knows its size, so a join ships it and leaves the large side where it is."""
    struct = T.StructType.fromDDL(schema)
    columns = {f.name: pa.array([_plain(r[i], f.dataType) for r in rows], _arrow(f.dataType)) for i, f in enumerate(struct.fields)}
    return spark.createDataFrame(pa.table(columns), schema=struct)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind.simpleString()]
