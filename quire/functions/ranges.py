"""Page ranges such as ``5-8, 2, 10-``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = r"^ *0*[1-9][0-9]* *(- *(0*[1-9][0-9]*)? *)?$"


def _bounds(p: Column) -> tuple[Column, Column]:
    """(first, last) of one part; last is null where it is open."""
    a = F.regexp_extract(p, r"^\s*(\d+)", 1)
    b = F.regexp_extract(p, r"-\s*(\d+)", 1)
    return a.try_cast("long"), F.when(F.contains(p, F.lit("-")), F.when(b != "", b.try_cast("long"))).otherwise(a.try_cast("long"))


def range_valid(expr: Column) -> Column:
    """Whether a range is well formed; empty is."""
    good = lambda p: F.rlike(p, F.lit(PART)) & F.coalesce(_bounds(p)[1] >= _bounds(p)[0], F.lit(True))
    return (F.trim(F.coalesce(expr, F.lit(""))) == "") | F.forall(F.split(expr, ","), good)


def parse_range(expr: Column, total: Column) -> Column:
    """Sorted distinct page numbers of a range within 1 .. total; all where it is empty or invalid, none without pages."""

    def numbers(p: Column) -> Column:
        a, b = _bounds(p)
        last = F.least(F.coalesce(b, total.cast("long")), total.cast("long"))
        return F.when(a <= last, F.sequence(a, last)).otherwise(F.array().cast("array<long>"))

    every = F.sequence(F.lit(1).cast("long"), total.cast("long"))
    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(expr, ","), numbers))))
    empty = F.trim(F.coalesce(expr, F.lit(""))) == ""
    return F.when(total < 1, F.array().cast("array<long>")).when(empty | ~range_valid(expr), every).otherwise(chosen)


def in_range(expr: Column, number: Column, total: Column) -> Column:
    """Whether a page number is among those of parse_range, without building them."""
    held = lambda p: (number >= _bounds(p)[0]) & (number <= F.coalesce(_bounds(p)[1], total))
    chosen = F.exists(F.split(expr, ","), lambda p: F.coalesce(held(p), F.lit(False)))
    empty = F.trim(F.coalesce(expr, F.lit(""))) == ""
    return number.between(1, total) & (empty | ~range_valid(expr) | chosen)


def compact_range(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """(key, pages): the numbers of each key as ``1-3, 5``."""
    w = Window.partitionBy(key).orderBy(number)
    runs = numbers.select(key, number).distinct().withColumn("run", F.col(number) - F.row_number().over(w))
    ends = runs.groupBy(key, "run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return ends.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("pages"))
