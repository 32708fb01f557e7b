"""Vector columns as arrays of doubles, built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vec_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_distance(a: Column, b: Column) -> Column:
    return vec_norm(vec_sub(a, b))


def mat_vec(matrix: Column, vector: Column) -> Column:
    """``matrix @ vector`` of a matrix given as an array of rows."""
    return F.transform(matrix, lambda row: vec_dot(row, vector))


def vec_mat(vector: Column, matrix: Column) -> Column:
    """``vector @ matrix`` of a row vector and an array of rows."""
    columns = F.sequence(F.lit(0), F.size(F.get(matrix, F.lit(0))) - 1)
    return F.transform(columns, lambda j: vec_dot(vector, F.transform(matrix, lambda row: F.get(row, j))))


def vec_mean(column: Column, dim: int) -> Column:
    """Aggregate: element-wise mean."""
    return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(dim)])


def vec_median(column: Column, dim: int) -> Column:
    """Aggregate: element-wise median, the mean of the middle two."""
    return F.array(*[F.median(F.get(column, F.lit(i))) for i in range(dim)])


def vec_round(column: Column, digits: int) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.transform(column, lambda x: F.round(x, digits) + F.lit(0.0))


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of the same names; they run in the JVM."""
    bodies = {
        "vec_add": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x + y)"),
        "vec_sub": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
        "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
        "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
        "mat_vec": (
            "m ARRAY<ARRAY<DOUBLE>>, v ARRAY<DOUBLE>",
            "ARRAY<DOUBLE>",
            "transform(m, r -> aggregate(zip_with(r, v, (x, y) -> x * y), 0D, (s, x) -> s + x))",
        ),
    }
    for name, (arguments, result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(bodies)
