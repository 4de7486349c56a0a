"""Decisions on scanned pages from pixel or profile rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.tables import small_batches


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def column_profile(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """pixels (page, x, y, lum) -> (page, x, lum, ink): mean luminance and share of dark pixels per column."""
    return pixels.groupBy("page", "x").agg(F.avg("lum").alias("lum"), F.avg((F.col("lum") < dark).cast("int")).alias("ink"))


def row_profile(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """(page, y, ink): share of dark pixels per row, taken as what the others leave of 1."""
    return pixels.groupBy("page", "y").agg((1 - F.avg((F.col("lum") >= dark).cast("int"))).alias("ink"))


def _runs(profile: DataFrame, flag: Column, at: str) -> DataFrame:
    """(page, first, last) of maximal runs of consecutive flagged places."""
    w = Window.partitionBy("page").orderBy(at)
    marked = profile.where(flag).withColumn("__g", F.col(at) - F.row_number().over(w))
    return marked.groupBy("page", "__g").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("__g")


def empty_band(profile: DataFrame, least_ink: float = 0.005, least_side: float = 0.5) -> DataFrame:
    """(page, center): middle of the longest run of columns under ``least_ink`` between two and three fifths of the width, both ends included.

    profile (page, x, ink). The run is 1 % wide at least, the first of equals; the ink shares of the
    columns before two fifths, and of those from three fifths on, each sum up to more than ``least_side``.
    """
    n = F.max("x").over(Window.partitionBy("page")) + 1
    d = profile.select("page", "x", "ink", n.alias("n")).withColumn("lo", F.expr("2 * n div 5")).withColumn("hi", F.expr("3 * n div 5"))
    sides = d.groupBy("page").agg(F.sum(F.when(F.col("x") < F.col("lo"), F.col("ink"))).alias("left"), F.sum(F.when(F.col("x") >= F.col("hi"), F.col("ink"))).alias("right"), F.first("n").alias("n"))
    runs = _runs(d.where("x BETWEEN lo AND hi"), F.col("ink") < least_ink, "x").join(sides, "page")
    runs = runs.where((F.col("left") > least_side) & (F.col("right") > least_side)).where("last - first + 1 >= 0.01 * n")
    best = runs.groupBy("page").agg(F.min_by(F.struct("first", "last"), F.struct((F.col("first") - F.col("last")).alias("d"), "first")).alias("b"))
    return best.select("page", F.floor((F.col("b.first") + F.col("b.last")) / 2).cast("long").alias("center"))


def shadow_valley(profile: DataFrame, depth: float = 25.0) -> DataFrame:
    """(page, x): darkest column between two and three fifths of the width, both included, if it lies more than ``depth`` under the median element; profile (page, x, lum)."""
    n = profile.groupBy("page").agg((F.max("x") + 1).alias("n"), F.element_at(F.array_sort(F.collect_list("lum")), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"))
    d = profile.join(n, "page").where("x BETWEEN 2 * n div 5 AND 3 * n div 5")
    low = d.groupBy("page").agg(F.min(F.struct("lum", "x")).alias("low"), F.first("median").alias("median"))
    return low.where(F.col("low.lum") < F.col("median") - depth).select("page", F.col("low.x").alias("x"))


def text_columns(profile: DataFrame, least_ink: float = 0.004) -> DataFrame:
    """(page, column_no, first, last): regions of more than ``least_ink``, gaps under 2 % closed, regions over 10 % kept, where there are two at least."""
    n = profile.groupBy("page").agg((F.max("x") + 1).alias("n"))
    runs = _runs(profile, F.col("ink") > least_ink, "x").join(n, "page")
    w = Window.partitionBy("page").orderBy("first")
    far = F.coalesce(F.col("first") - F.lag("last").over(w) - 1 >= 0.02 * F.col("n"), F.lit(True))
    runs = runs.withColumn("g", far.cast("int"))
    runs = runs.withColumn("g", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("page", "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("n").alias("n")).where("last - first + 1 > 0.1 * n")
    v = Window.partitionBy("page")
    return merged.withColumn("c", F.count("*").over(v)).where("c >= 2").select("page", F.row_number().over(v.orderBy("first")).alias("column_no"), "first", "last")


def column_boxes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(page, column_no, x, y, w, h): boxes of text columns in page units, with a little room around.

    columns (page, column_no, first, last, width) in pixels; rows (page, y, ink): from the first to the last row with
    ink, of the page's height of rows. Boxes lie inside the page.
    """
    inked = F.when(F.col("ink") > 0, F.col("y"))
    r = rows.groupBy("page").agg(F.min(inked).alias("top"), F.max(inked).alias("bottom"), (F.max("y") + 1).alias("height"))
    d = columns.join(r, "page").where("top IS NOT NULL")
    w, h = F.col("width"), F.col("height")
    x, y = F.greatest(F.lit(0.0), (F.col("first") - 2) / w), F.greatest(F.lit(0.0), (F.col("top") - 4) / h)
    return d.select("page", "column_no", x.alias("x"), y.alias("y"), F.least(1 - x, (F.col("last") + 1 - F.col("first") + 4) / w).alias("w"), F.least(1 - y, (F.col("bottom") - F.col("top") + 8) / h).alias("h"))


def border_box(profile: DataFrame, at: str = "x", dark: float = 0.6) -> DataFrame:
    """(page, first, last): what is left without the border at both ends of a profile, places whose ink is over ``dark``.

    At either end at most a fifth goes, rounded up; where all is border both fifths go.
    """
    n = profile.groupBy("page").agg((F.max(at) + 1).alias("n"), F.min(F.when(F.col("ink") <= dark, F.col(at))).alias("a"), F.max(F.when(F.col("ink") <= dark, F.col(at))).alias("b"))
    first = F.least(F.col("a"), F.expr("(n + 4) div 5"))  # least and greatest skip null
    return n.select("page", first.cast("long").alias("first"), F.greatest(F.col("b"), F.expr("4 * n div 5")).cast("long").alias("last"))


def skew(points: DataFrame, least: int = 50) -> DataFrame:
    """(page, angle): of -5 to 5 degrees by quarters the angle whose line bins are fullest; the smallest of equals, 0 with few points.

    points (page, x, y) are dark pixels, sampled by the caller to a bounded number for each page; a page's points meet
    in one row, whose bins are counted under 41 angles.
    """
    angles = np.arange(-20, 21) / 4
    rad = np.radians(angles)

    @F.pandas_udf("double")
    def fullest(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            if len(x) < least:
                out.append(0.0)
                continue
            v = np.asarray(y, float)[None] * np.cos(rad)[:, None] - np.asarray(x, float)[None] * np.sin(rad)[:, None]
            bins = (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)  # halves go away from zero
            scores = [int((np.unique(b, return_counts=True)[1].astype(np.int64) ** 2).sum()) for b in bins]
            out.append(float(angles[int(np.argmax(scores))]))
        return pd.Series(out, dtype=float)

    per = points.groupBy("page").agg(F.collect_list("x").alias("__x"), F.collect_list("y").alias("__y"))
    return per.select("page", fullest("__x", "__y").alias("angle"))


def tile_background(pixels: DataFrame, size: int = 48) -> DataFrame:
    """(page, tx, ty, bg): the 90 % element of each tile's luminances, 40 at least. A tile has a bounded number of pixels."""
    n = F.count("*")
    at = (F.floor(F.least(n * 0.9, n - 1)) + 1).cast("int")
    return pixels.groupBy("page", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty")).agg(F.greatest(F.lit(40), F.element_at(F.array_sort(F.collect_list("lum")), at)).alias("bg"))


def without_shadow(pixels: DataFrame, background: DataFrame, size: int = 48) -> DataFrame:
    """pixels with lum * 255 / background, the background being bilinear between tile centres, at most 255.

    The four tiles around a place are put side by side on the grid of tiles, which has size * size times fewer rows, so
    that each pixel is joined once.
    """
    ends = Window.partitionBy("page")
    tiles = background.select("page", "tx", "ty", "bg", F.max("tx").over(ends).alias("mx"), F.max("ty").over(ends).alias("my"))
    # a tile is corner i of the cells to its right (0) and left (1); at the edges it stands for the tile outside as well
    cells = lambda t, m: F.array_compact(F.array(F.struct(F.lit(0).alias("c"), F.col(t).alias("q")), F.struct(F.lit(1).alias("c"), (F.col(t) - 1).alias("q")), F.when(F.col(t) == 0, F.struct(F.lit(0).alias("c"), F.lit(-1).cast("long").alias("q"))), F.when(F.col(t) == F.col(m), F.struct(F.lit(1).alias("c"), F.col(t).alias("q")))))
    d = tiles.withColumn("a", F.explode(cells("tx", "mx"))).withColumn("b", F.explode(cells("ty", "my")))
    corner = lambda i, j: F.max(F.when((F.col("a.c") == i) & (F.col("b.c") == j), F.col("bg"))).alias(f"__b{i}{j}")
    quads = d.groupBy("page", F.col("a.q").alias("__x"), F.col("b.q").alias("__y")).agg(*[corner(i, j) for i in (0, 1) for j in (0, 1)])
    fx, fy = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    p = pixels.select("page", "x", "y", "lum", F.floor(fx).alias("__x"), F.floor(fy).alias("__y")).join(quads, ["page", "__x", "__y"])
    u, v = fx - F.col("__x"), fy - F.col("__y")
    bg = (F.col("__b00") * (1 - u) + F.col("__b10") * u) * (1 - v) + (F.col("__b01") * (1 - u) + F.col("__b11") * u) * v
    return p.select("page", "x", "y", F.least(F.lit(255), F.floor(F.col("lum") * 255 / bg)).cast("int").alias("lum"))


def _flat(page: np.ndarray, y: np.ndarray, lum: np.ndarray, size: np.ndarray, tile: int) -> np.ndarray:
    """lum of rows of pixels (page number, y, size) without the shadow, as without_shadow has it."""
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    x = np.arange(len(lum)) - start[row]
    p, yy = page[row], y[row]
    tx, ty = x // tile, yy // tile
    ends = np.zeros((2, int(page.max()) + 1), np.int64)  # last tile of each page
    np.maximum.at(ends[0], p, tx)
    np.maximum.at(ends[1], p, ty)
    base = np.cumsum((ends[0] + 1) * (ends[1] + 1))
    place = lambda a, b: (base[p] - (ends[0] + 1)[p] * (ends[1] + 1)[p]) + b * (ends[0] + 1)[p] + a
    own = place(tx, ty)
    order = np.lexsort((lum, own))
    at = own[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    known, bg = at[first], np.maximum(40, lum[order][first + np.floor(np.minimum(n * 0.9, n - 1)).astype(np.int64)]).astype(float)
    if base[-1] <= 4 * len(lum) + 4096:
        grid = np.full(int(base[-1]), np.nan)
        grid[known] = bg
        found = grid.__getitem__
    else:  # few of the tiles have pixels
        def found(key: np.ndarray) -> np.ndarray:
            k = np.minimum(np.searchsorted(known, key), len(known) - 1)
            return np.where(known[k] == key, bg[k], np.nan)

    fx, fy = x / tile - 0.5, yy / tile - 0.5
    qx, qy = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    u, v = fx - qx, fy - qy
    x0, x1, y0, y1 = np.maximum(qx, 0), np.minimum(qx + 1, ends[0][p]), np.maximum(qy, 0), np.minimum(qy + 1, ends[1][p])
    back = (found(place(x0, y0)) * (1 - u) + found(place(x1, y0)) * u) * (1 - v) + (found(place(x0, y1)) * (1 - u) + found(place(x1, y1)) * u) * v
    out = np.floor(lum * 255 / back)
    return np.where(np.isnan(out), 255, np.minimum(255, out)).astype(np.int32)  # next to tiles without pixels there is no background


def rows_without_shadow(rows: DataFrame, size: int = 48, pixels: int = 1 << 17) -> DataFrame:
    """rows (page, y, lum: array<int> from x = 0 on, without nulls) as tile_background and without_shadow make their pixels.

    A row of pixels is shuffled as one row, once; a task holds whole pages, as many as have ``pixels`` at least. Rows of no page go.
    """
    small_batches(rows.sparkSession)

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        lum, key = t.column(2), t.column(0).to_numpy(zero_copy_only=False)
        n = np.diff(lum.offsets.to_numpy())
        number = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        flat = lum.flatten().to_numpy()
        flat = _flat(number, t.column(1).to_numpy(), flat.astype(np.int64), n, size) if len(flat) else flat.astype(np.int32)
        return pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat, pa.int32()))], ["page", "y", "lum"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            if held and n >= pixels:  # the held pages end where another begins
                last = held[-1].column(0)[-1].as_py()
                k = int(np.argmax(key != last)) if (key != last).any() else len(key)
                held.append(b.slice(0, k))
                n += len(b.slice(0, k).column(2).flatten())
                if k == len(key):
                    continue
                yield done(held)
                held, n, b = [], 0, b.slice(k)
            held.append(b)
            n += len(b.column(2).flatten())
        if held:
            yield done(held)

    d = rows.where("page IS NOT NULL").select(F.col("page").cast("long").alias("page"), F.col("y").cast("long").alias("y"), F.col("lum").cast("array<int>").alias("lum"))
    return d.repartition("page").sortWithinPartitions("page", "y").mapInArrow(flat, "page long, y long, lum array<int>")


def covered_pixels(pixels: DataFrame, masks: DataFrame, size: int = 64) -> DataFrame:
    """pixels under a mask (page, x0, y0, x1, y1 in pixels, end exclusive): both sides meet in grid cells, so the join stays an equi-join."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))
    m = masks.where("x1 > x0 AND y1 > y0").select("*", F.explode(cells("x0", "x1")).alias("cx")).select("*", F.explode(cells("y0", "y1")).alias("cy"))
    p = pixels.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    return p.join(m, ["page", "cx", "cy"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").select(*[p[c] for c in pixels.columns]).distinct()


def paper_mean(samples: DataFrame) -> DataFrame:
    """(box, lum): mean of the brighter half of a box's border samples (box, no, lum)."""
    w = Window.partitionBy("box")
    d = samples.withColumn("r", F.row_number().over(w.orderBy(F.desc("lum"), "no"))).withColumn("n", F.count("*").over(w))
    return d.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).groupBy("box").agg(F.avg("lum").alias("lum"))


def split_spreads(pages: DataFrame, gutters: DataFrame, new_id: int) -> DataFrame:
    """(documentid, id, part, x0, x1): landscape pages without lock or spread as a left and a right half, cut at the gutter (id, x) or the middle."""
    wide = pages.where("width > height AND NOT landscapelock AND spreadid IS NULL").join(gutters.select("id", F.col("x").alias("__x")), "id", "left")
    at = F.coalesce("__x", F.floor(F.col("width") / 2))
    halves = F.explode(F.array(F.struct(F.lit("left").alias("part"), F.lit(0).cast("long").alias("x0"), at.cast("long").alias("x1")), F.struct(F.lit("right").alias("part"), at.cast("long").alias("x0"), F.col("width").cast("long").alias("x1"))))
    d = wide.select("documentid", "id", halves.alias("h")).select("documentid", "id", "h.*")
    return d.withColumn("new_id", F.when(F.col("part") == "left", F.col("id")).otherwise(F.col("id") + new_id))


def cleaned_pages(pages: DataFrame, gutters: DataFrame, splitting: bool = True) -> DataFrame:
    """(documentid, id, half, width, landscapelock, spreadid, spreadside, new) of pages after the cleanup of their images; gutters (id, x) where one was found.

    A page without lock or spread is cut at its gutter: the left half keeps the page, the right half is a new row
    (``new``, under the same id until it gets its own). Other wide pages without a lock get it, since they are meant to be wide.
    """
    d = pages.join(gutters.groupBy("id").agg(F.min("x").alias("__x")), "id", "left")
    cut = F.lit(splitting) & F.col("__x").isNotNull() & ~F.col("landscapelock") & F.col("spreadid").isNull()
    d = d.withColumn("__cut", F.coalesce(cut, F.lit(False)))
    row = lambda half, width, lock, spread, side, new: F.struct(F.lit(half).alias("half"), width.cast("long").alias("width"), lock.alias("landscapelock"), spread.cast("long").alias("spreadid"), side.alias("spreadside"), F.lit(new).alias("new"))
    left = row("left", F.col("__x"), F.col("landscapelock"), F.col("id"), F.lit("left"), False)
    right = row("right", F.col("width") - F.col("__x"), F.col("landscapelock"), F.col("id"), F.lit("right"), True)
    whole = row("whole", F.col("width"), F.col("landscapelock") | (F.col("width") > F.col("height")), F.col("spreadid"), F.col("spreadside"), False)
    return d.select("documentid", "id", F.explode(F.when(F.col("__cut"), F.array(left, right)).otherwise(F.array(whole))).alias("r")).select("documentid", "id", "r.*")
