"""Boxes that overlap by half or more, found on a grid.

If two boxes' intersection over union is above one half, their widths
differ by less than two times, as do their heights, and their centres are
nearer than half the lesser width and height. So each box of one side
stands in one cell, that of its centre (the pair's reference point), in a
grid for its class of width and height, a power of two each; a box of the
other side looks into the classes beside its own and into the cells that
its centre's surroundings touch. Pairs meet once and boxes that cannot
overlap enough mostly never, however crowded a frame is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are this many times as wide as the narrowest box of their class.
CELL = 4


def _classed(size: Column) -> Column:
    """The largest ``k`` with ``2 ** k <= size``."""
    k = F.floor(F.log2(size)).cast("int")
    return F.when(F.pow(F.lit(2.0), k) > size, k - 1).when(F.pow(F.lit(2.0), k + 1) <= size, k + 1).otherwise(k)


def _cell(at: Column, k: Column) -> Column:
    return F.floor(at / (CELL * F.pow(F.lit(2.0), k)))


def _looks(low: str, high: str) -> Column:
    """Class and cell on one axis of all boxes that a box may match."""
    size, middle = F.col(high) - F.col(low), (F.col(high) + F.col(low)) / 2
    k = _classed(size)

    def cells(of: Column) -> Column:
        far = F.least(size, F.pow(F.lit(2.0), of + 1)) / 2
        return F.transform(F.sequence(_cell(middle - far, of), _cell(middle + far, of)), lambda c: F.struct(of.alias("k"), c.alias("c")))

    return F.flatten(F.transform(F.array(k - 1, k, k + 1), cells))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], box: list[str], other: list[str], least: float = 0.5) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows of equal keys among which are all whose intersection over union is above ``least``.

    ``least`` is one half or more. Boxes without width or height overlap
    nothing and are left out.
    """
    if least < 0.5:
        raise ValueError("the grid holds for an overlap of one half or more")
    x1, y1, x2, y2 = box
    l = left.where((F.col(x2) > F.col(x1)) & (F.col(y2) > F.col(y1)))
    l = l.withColumn("at_x", F.explode(_looks(x1, x2))).withColumn("at_y", F.explode(_looks(y1, y2)))
    p1, q1, p2, q2 = other
    r = right.where((F.col(p2) > F.col(p1)) & (F.col(q2) > F.col(q1)))
    for name, low, high in (("at_x", p1, p2), ("at_y", q1, q2)):
        k = _classed(F.col(high) - F.col(low))
        r = r.withColumn(name, F.struct(k.alias("k"), _cell((F.col(high) + F.col(low)) / 2, k).alias("c")))
    near = [F.abs(F.col(a) + F.col(b) - F.col(c) - F.col(d)) < F.least(F.col(b) - F.col(a), F.col(d) - F.col(c)) for a, b, c, d in ((x1, x2, p1, p2), (y1, y2, q1, q2))]
    # both sides grow with the input, and their expanded rows are far larger than estimates tell: neither may pass the driver
    return l.join(r.hint("merge"), [*keys, "at_x", "at_y"]).where(near[0] & near[1]).drop("at_x", "at_y")
