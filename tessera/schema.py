"""Column contracts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.DoubleType())])
PARTITION = T.StructType([T.StructField("node", T.LongType()), T.StructField("cluster", T.LongType())])
PATCHES = T.StructType(
    [T.StructField("patch_id", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("coords", T.ArrayType(T.DoubleType()))]
)
TRANSFORMS = T.StructType(
    [
        T.StructField("patch_id", T.IntegerType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("rot", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("shift", T.ArrayType(T.DoubleType())),
    ]
)
EMBEDDING = T.StructType([T.StructField("node", T.LongType()), T.StructField("coords", T.ArrayType(T.DoubleType()))])

EDGE_KEYS = ("timestamp", "src", "dst")
NODE_KEYS = ("timestamp", "id")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The table itself, if it has all the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}, there are {df.columns}")
    return df


def feature_columns(df: DataFrame, keys: tuple[str, ...]) -> list[str]:
    """Every column that is no key, in its order."""
    return [c for c in df.columns if c not in keys]


def numbered_columns(df: DataFrame) -> DataFrame:
    """The table with its columns renamed by position, so that no two names clash."""
    return df.toDF(*[f"_c{k}" for k in range(len(df.columns))])


def column_position(df: DataFrame, name: str) -> int:
    """Where a column stands: the first of exactly this name, else the first that differs in case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [c.lower() for c in names]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"missing column {name}, there are {names}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever other columns the table has, clashing ones included."""
    by_position = numbered_columns(df)
    return by_position.select(*[F.col(f"_c{column_position(df, n)}").alias(n) for n in dict.fromkeys(names)])
