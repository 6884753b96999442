"""Interval joins: pairs of one key whose half-open intervals overlap.

An interval lies in bins of its own width class, two at most: the class is the
smallest power of two, times ``unit``, that is not shorter. Each pair is met at
the wider of its two classes: there the wider interval stands in its own bins
and the narrower is looked up in the bins of that class that it touches, two at
most again. So an interval has a bounded number of copies, however long it is,
joins are equalities on key, class and bin, and long intervals do not meet
every short one. A pair comes out in the last of the bins that both begin in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.names import fresh


def overlaps(left: DataFrame, right: DataFrame, *, by: tuple[str, ...], start: tuple[str, str], end: tuple[str, str], unit: int = 1) -> DataFrame:
    """All columns of both for each pair with equal ``by`` and start_left < end_right, start_right < end_left.

    start, end: names of long columns of the left and the right side, which share no name
    but ``by``. Empty intervals and nulls meet nothing.
    """
    classes = 62 - unit.bit_length()  # the widest bins still are longs
    level, bin_, own, n = (fresh(x, left, right) for x in ("level", "bin", "own", "n"))
    key = list(by)

    def classed(df: DataFrame, a: str, b: str) -> DataFrame:
        length = (F.col(b) - F.col(a)).cast("double") / unit
        return df.where(F.col(a) < F.col(b)).withColumn(own, F.least(F.greatest(F.ceil(F.log2(length)), F.lit(0)), F.lit(classes)).cast("int"))

    def binned(df: DataFrame, levels: Column, a: str, b: str) -> DataFrame:
        width = F.lit(unit).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level))
        first, last = F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)
        return df.withColumn(level, F.explode(levels)).drop(own).withColumn(bin_, F.explode(F.sequence(first, last)))

    def met(wide: DataFrame, narrow: DataFrame, wide_ends: tuple[str, str], narrow_ends: tuple[str, str], least: int) -> DataFrame:
        """Pairs in which the wide interval's class is larger than the narrow one's by ``least`` or more."""
        wide, narrow = classed(wide, *wide_ends), classed(narrow, *narrow_ends)
        # some 60 numbers at most; counted, as Spark takes the grouping of session windows away below a set alone
        there = wide.groupBy(own).agg(F.count("*").alias(n)).where(F.col(n) > 0).agg(F.collect_set(own)).scalar()
        a = binned(wide, F.array(F.col(own)), *wide_ends)
        b = binned(narrow, F.array_intersect(F.slice(F.sequence(F.col(own), F.lit(classes)), 1 + least, 1 + classes), there), *narrow_ends)
        pairs = a.join(b, [*key, level, bin_]).where((F.col(wide_ends[0]) < F.col(narrow_ends[1])) & (F.col(narrow_ends[0]) < F.col(wide_ends[1])))
        width = F.lit(unit).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level))
        once = F.col(bin_) == F.greatest(F.floor(F.col(wide_ends[0]) / width), F.floor(F.col(narrow_ends[0]) / width))
        return pairs.where(once).drop(level, bin_)

    l_ends, r_ends = (start[0], end[0]), (start[1], end[1])
    columns = [*key, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by]]
    one = met(left, right, l_ends, r_ends, 0)  # the left interval's class is not smaller
    two = met(right, left, r_ends, l_ends, 1)
    return one.select(*columns).unionByName(two.select(*columns))
