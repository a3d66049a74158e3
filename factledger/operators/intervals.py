"""An index of closed windows for many instants: dyadic cells, joined on equality.

Time is cut into cells of 2^UNIT ms, pairs of these into cells of the next level, and so on. A window is the disjoint union of at most two
cells of each level, whatever its length; an instant lies in one cell of each level. So windows and instants meet on (level, cell), once
each, and the exact bounds are only a filter for the outermost cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.asof import as_of_join

#: Cells begin at about a minute; instants further off than 2^SPAN ms (some 278 years) from the epoch share the outermost cell.
UNIT, SPAN = 16, 43
LEVELS = SPAN - UNIT + 2


def _cell(at: Column) -> Column:
    inside = F.greatest(F.least(at.cast("long"), F.lit((1 << SPAN) - 1)), F.lit(-(1 << SPAN)))
    return F.shiftright(inside, UNIT)


def cover(low: Column, high: Column) -> Column:
    """The cells whose union is the window, as array<struct<level, cell>>; none for one that is backwards or null."""
    a, b = _cell(low), _cell(high) + 1

    def cells(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left, right = F.call_function("shiftright", a + width - 1, k), F.call_function("shiftright", b, k)
        some = left < right
        return F.array_compact(F.array(
            F.when(some & (left.bitwiseAND(1) == 1), F.struct(k.alias("level"), left.alias("cell"))),
            F.when(some & (right.bitwiseAND(1) == 1), F.struct(k.alias("level"), (right - 1).alias("cell"))),
        ))

    return F.when(low <= high, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), cells)))


def ancestors(at: Column) -> Column:
    """The cells that an instant lies in, one a level; none for null."""
    c = _cell(at)
    return F.when(at.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", c, k).alias("cell"))))


def stab(points: DataFrame, windows: DataFrame, keys: list[str], at_col: str, low: str = "from_ms", high: str = "until_ms") -> DataFrame:
    """points x the windows of their keys that cover them, both ends included. Points whose keys have no window go before the join."""
    cells = lambda df, c: df.withColumn("_c", F.explode(c)).withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell")}).drop("_c")
    near = points.join(windows.where(F.col(low) <= F.col(high)).select(*keys).distinct(), keys, "left_semi")
    met = cells(near, ancestors(F.col(at_col))).join(cells(windows, cover(F.col(low), F.col(high))), [*keys, "_level", "_cell"])
    return met.where((F.col(low) <= F.col(at_col)) & (F.col(high) >= F.col(at_col))).drop("_level", "_cell")


def overlaps(rows: DataFrame, windows: DataFrame, keys: list[str], begin: str, end: str, name: str, low: str = "from_ms", high: str = "until_ms") -> DataFrame:
    """rows with the number of windows of their keys that touch [begin, end), end null: without end. Those that began before the end, less those
    that ended before the beginning: two running counts, read as of an instant, so windows and rows are never paired."""
    w = windows.where(F.col(low) <= F.col(high))

    def counted(col: str, as_name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(col)).cast("long")
        return w.select(*keys, F.col(col).cast("long").alias("boundary"), n.alias("id")).withColumn(as_name, F.col("id"))

    last = F.lit((1 << 63) - 1)
    out = rows.withColumns({"_end": F.coalesce(F.col(end) - 1, last).cast("long"), "_begin": (F.col(begin) - 1).cast("long")})
    out = as_of_join(out, counted(low, "_begun"), keys, "_end", ["_begun"])
    out = as_of_join(out, counted(high, "_ended"), keys, "_begin", ["_ended"])
    n = F.coalesce("_begun", F.lit(0)) - F.coalesce("_ended", F.lit(0))
    return out.withColumn(name, n.cast("long")).drop("_end", "_begin", "_begun", "_ended")
