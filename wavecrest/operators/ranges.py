"""Scans of long sequences in ranges of their order: within a range by a window, across ranges by one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a range; a sequence of a thousand million has some 15,000 ranges.
RANGE = 65_536


def numbered(rows: DataFrame, by: list[str], place: Column, order: list, into: str) -> DataFrame:
    """Adds ``into``, a row's number in its sequence ``by``, from 0.

    ``place`` is a whole number that grows with ``order``: rows are numbered within ranges of it, and the counts of the ranges before
    are added, so a long sequence is many tasks' work. Rows whose place is null come first.
    """
    marked = rows.withColumn("_range", F.floor(place / F.lit(RANGE)).cast("long"))
    counts = marked.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = before_ranges(counts, by, {"_before": F.sum("_n")})
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    return match(marked.withColumn("_own", own), before.drop("_n"), [*by, "_range"]).withColumn(into, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def before_ranges(summaries: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds each of ``sums`` over the rows of the ranges before, 0 for the first; a summary is one row a range."""
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return summaries.withColumns({name: F.coalesce(x.over(ahead), F.lit(0)) for name, x in sums.items()})


def match(rows: DataFrame, summaries: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of the summary that has the same ``on``, nulls being equal."""
    names = {c: f"_match_{c}" for c in on}
    other = summaries.withColumnsRenamed(names)
    found = rows.join(other, [F.col(c).eqNullSafe(F.col(names[c])) for c in on])
    return found.drop(*names.values())


def with_margins(rows: DataFrame, place: Column, back: int, ahead: int, size: int = RANGE) -> DataFrame:
    """Rows with ``_range`` and ``_inside``: each row of its range, and again, outside, of the ranges that begin within ``back`` places
    behind or end within ``ahead`` places before it, so that a frame of so many places can be read within a range.

    A frame as long as several ranges repeats a row as often.
    """
    size = max(size, back + ahead)
    low, high = (F.floor((place + F.lit(x)) / F.lit(size)).cast("long") for x in (-ahead, back))
    each = rows.withColumn("_range", F.explode(F.sequence(low, high)))
    return each.withColumn("_inside", F.col("_range") == F.floor(place / F.lit(size)))
