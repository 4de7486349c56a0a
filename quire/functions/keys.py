"""Keys of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, column: str, found: DataFrame, *scope: str, salt: str = "id") -> DataFrame:
    """rows left joined with found (scope ..., column, ...) on scope and column.

    Rows whose column is null find nothing. They are dealt by ``salt``, a column of rows, since equal keys,
    nulls among them, would all meet in one task. Salts are small numbers: every row is shuffled with its own.
    """
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    d = rows.withColumn("__salt", F.when(F.col(column).isNull(), dealt(salt, 1024)).otherwise(dealt(column, 4)))
    return d.join(found.where(F.col(column).isNotNull()).withColumn("__salt", dealt(column, 4)), [*scope, column, "__salt"], "left").drop("__salt")
