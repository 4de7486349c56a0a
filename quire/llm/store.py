"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.functions.tables import shared_dir, written  # noqa: F401


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint() of a narrow table: later stages survive lost executors and plans stay short."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
