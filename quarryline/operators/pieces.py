"""Hot keys cut into pieces along an order, so that windows over a key go to many tasks.

A key of more than ``HOT_ROWS`` rows is cut at approximate quantiles of its own
values. The cuts are written to the shared folder before they are used, so
every use of them, and every task that is run again, sees the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.names import fresh
from quarryline.sources.stored import written

#: A key with more rows is cut, into so many pieces (a square number).
HOT_ROWS, PIECES = 1_000_000, 256


def hot_cuts(rows: DataFrame, key: list[str], at: str, name: str, *, hot_rows: int = HOT_ROWS, pieces: int = PIECES) -> DataFrame:
    """key and ``name`` (the values of ``at`` that end the pieces) of each key with more than ``hot_rows`` rows, written. Keys and values are not null."""
    n = fresh("n", rows)
    hot = rows.groupBy(*key).agg(F.count("*").alias(n)).where(F.col(n) > hot_rows).select(*key)
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    return written(rows.select(*key, at).join(hot, key).groupBy(*key).agg(F.percentile_approx(at, shares, F.lit(100 * pieces)).alias(name)), "hot-cuts")


def piece_of(at: Column, cuts: Column, pieces: int = PIECES) -> Column:
    """The number of the piece that ``at`` lies in, from 0; equal values lie in one piece. Searched in two steps of the root's size."""
    side = round(pieces**0.5)
    coarse = F.size(F.filter(cuts, lambda c, i: (i % side == side - 1) & (c < at)))
    fine = F.size(F.filter(F.slice(cuts, coarse * side + 1, side), lambda c: c < at))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(coarse * side + fine)


def numbered(rows: DataFrame, *, by: str, at: str, ties: str, name: str, hot_rows: int = HOT_ROWS, pieces: int = PIECES) -> DataFrame:
    """Adds ``name``: the number of each row within its key, from 1, the latest ``at`` first, the larger ``ties`` first among equals, rows without a time last.

    Each piece is numbered by itself, and the rows of the later pieces are
    added, which are counted before. Rows without a key are left out.
    """
    from pyspark.sql import Window

    cuts, piece, n, before = (fresh(x, rows) for x in ("cuts", "piece", "n", "before"))
    keyed = rows.where(F.col(by).isNotNull())
    cut = hot_cuts(keyed.where(F.col(at).isNotNull()), [by], at, cuts, hot_rows=hot_rows, pieces=pieces)
    placed = keyed.join(cut, by, "left").withColumn(piece, F.when(F.col(at).isNull(), -1).otherwise(piece_of(F.col(at), F.col(cuts), pieces))).drop(cuts)
    later = Window.partitionBy(by).orderBy(F.col(piece).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(by, piece).agg(F.count("*").alias(n)).select(by, piece, F.coalesce(F.sum(n).over(later), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(by, piece).orderBy(F.col(at).desc_nulls_last(), F.col(ties).desc()))
    return placed.join(counts, [by, piece]).withColumn(name, (F.col(before) + own).cast("int")).drop(piece, before)
