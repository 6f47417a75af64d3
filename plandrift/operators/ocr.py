"""Recognised words to lines: confidence, rows by vertical overlap, splits at gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Code, failing
from .folds import ddl, fold


def box_of(points: Column) -> Column:
    """The box of a quad, an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def confident(words: DataFrame, least: float = 0.4) -> DataFrame:
    """Words that have text and are sure enough; confidences over 1 are percents."""
    share = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return words.withColumn("confidence", share).filter((F.col("confidence") >= least) & (F.trim("text") != ""))


def bounded(words: DataFrame, page: list[str], most: int) -> DataFrame:
    """words; those of a page that has more than ``most`` can't be read without an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*page))
    over = failing(Code.LIMIT, F.concat(n.cast("string"), F.lit(" words on a page")))
    return words.withColumn("_fits", F.when(n > most, over).otherwise("")).filter("_fits = ''").drop("_fits")


def rows(words: DataFrame, key: list[str]) -> DataFrame:
    """words with row_no: each in reading order joins the first row that it overlaps by more than half of the lower height.

    A row grows with its words, so a page's words go through one fold; a page has a bounded number of words.
    """

    def numbered(page: list[dict]) -> list[dict]:
        held: list[list[float]] = []
        for word in page:
            y0, y1 = word["y0"], word["y1"]
            k = next((n for n, (a, b) in enumerate(held) if min(b, y1) - max(a, y0) > 0.5 * min(b - a, y1 - y0)), None)
            if k is None:
                k = len(held)
                held.append([y0, y1])
            held[k] = [min(held[k][0], y0), max(held[k][1], y1)]
            word["row_no"] = k
        return page

    return fold(words, key, ["y0", "x0", "x1", "y1"], ddl(words, "row_no int"), numbered)


def split_at_gaps(words: DataFrame, row: list[str], gap: Column, tie: list[str] = []) -> DataFrame:
    """words with line_no within each row: a new line where the gap to the word before is too wide."""
    order = Window.partitionBy(*row).orderBy("x0", *tie)
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(order) > gap).cast("int"), F.lit(0))
    return words.withColumn("_wide", wide).withColumn("line_no", F.sum("_wide").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_wide")


def lines(split: DataFrame, row: list[str], tie: list[str] = []) -> DataFrame:
    """(row, line_no, text, confidence, box) of each line's words from left to right."""
    word = F.struct("x0", *tie, "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return split.groupBy(*row, "line_no").agg(joined.alias("text"), F.avg("confidence").alias("confidence"), *box)
