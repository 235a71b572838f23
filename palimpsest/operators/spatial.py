"""Joins of boxes on pages by a grid, so that only boxes near each other meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width and height of a cell, and the cells on each side of the origin; what lies beyond shares the outermost ones.
CELL, OUTER = (256.0, 64.0), (64, 256)


def envelope(box: Column, width: Column | float, height: Column | float) -> Column:
    """The box grown by so much on each side, but not beyond 0."""
    low = lambda x, by: F.greatest(x - by, F.lit(0.0))
    return F.struct(low(box.x0, width).alias("x0"), low(box.y0, height).alias("y0"), (box.x1 + width).alias("x1"), (box.y1 + height).alias("y1"))


def touches(a: Column, b: Column) -> Column:
    """Whether two boxes share area."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def _cell(x: Column, axis: int) -> Column:
    return F.greatest(F.least(F.floor(x / CELL[axis]), F.lit(OUTER[axis])), F.lit(-OUTER[axis])).cast("int")


def box_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, axes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose boxes, columns ``a`` of ``left`` and ``b`` of ``right``, share area, once each.

    Other columns must not share names.  Both sides are written to the cells that their boxes cover and joined on keys and
    cell; a pair that meets in several cells counts in that of its shared area's corner.  A box covers some cells, and
    16,000 or so at most, however wrong its numbers are; boxes that are null, empty, turned or not a number meet none.
    Boxes that reach down a whole page would cover all of its cells: with ``axes`` (0,) cells are whole columns.
    """

    def laid(df: DataFrame, box: str) -> DataFrame:
        c = F.col(box)
        sound = c.isNotNull() & ~(F.isnan(c.x0) | F.isnan(c.y0) | F.isnan(c.x1) | F.isnan(c.y1)) & (c.x0 < c.x1) & (c.y0 < c.y1)
        df = df.filter(sound)
        for i in axes:
            df = df.withColumn(f"_{i}", F.explode(F.sequence(_cell(c[f"{'xy'[i]}0"], i), _cell(c[f"{'xy'[i]}1"], i))))
        return df

    cells = [f"_{i}" for i in axes]
    # Both sides grow with the pages, whatever their sizes are taken to be: neither goes to the driver.
    met = laid(left, a).join(laid(right, b).hint("merge"), [*keys, *cells])
    p, q = F.col(a), F.col(b)
    met = met.filter(touches(p, q))
    for i in axes:
        met = met.filter(F.col(f"_{i}") == _cell(F.greatest(p[f"{'xy'[i]}0"], q[f"{'xy'[i]}0"]), i))
    return met.drop(*cells)
