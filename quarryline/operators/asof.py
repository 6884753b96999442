"""As-of joins: to each row the last event of its key at or before its time.

The join is a union. Events and rows of a key are put in one order of time, and
the last event is carried forward. A key with very many rows is cut by time
into pieces of about equal size (at approximate quantiles of its own times), so
its rows go to many tasks; what each piece begins with is the last event of
the pieces before it, which comes from one small row for each piece. So no key
is sorted in one task, nothing is joined by inequality, and an event is sent
once whatever the number of rows after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.names import fresh
from quarryline.operators.pieces import HOT_ROWS, PIECES, hot_cuts, piece_of


def as_of(rows: DataFrame, events: DataFrame, *, by: tuple[str, ...], at: str, carried: tuple[str, ...], hot_rows: int = HOT_ROWS, pieces: int = PIECES) -> DataFrame:
    """``rows`` with the columns ``carried`` of the last of ``events`` of the same ``by`` whose ``at`` is not later.

    They are null where there is none, and for rows whose key or time is null.
    Of events of one key and time the one with the largest carried values
    counts. The columns carried are not among those of ``rows``. Rows of one
    key and one instant lie in one piece.
    """
    tag, value, row, piece, cuts, before = (fresh(x, rows, events) for x in ("tag", "value", "row", "piece", "cuts", "before"))
    key, known = list(by), F.lit(True)
    for c in (*by, at):
        known &= F.col(c).isNotNull()
    last = events.where(known).groupBy(*key, at).agg(F.max(F.struct(*carried)).alias(value))
    none = F.lit(None).cast(last.schema[value].dataType)
    sent = rows.where(known).select(*key, at, F.lit(1).alias(tag), none.alias(value), F.struct(*rows.columns).alias(row))
    both = last.select(*key, at, F.lit(0).alias(tag), value, F.lit(None).cast(sent.schema[row].dataType).alias(row)).unionByName(sent)

    times = both.select(*key, at)
    cut = hot_cuts(times, key, at, cuts, hot_rows=hot_rows, pieces=pieces)
    number = piece_of(F.col(at), F.col(cuts), pieces)
    placed = both.join(cut, key, "left").withColumn(piece, number).drop(cuts)

    ends = times.join(cut, key).select(*key, number.alias(piece)).distinct()
    of_piece = last.join(cut, key).select(*key, number.alias(piece), at, value).groupBy(*key, piece).agg(F.max_by(value, at).alias(value))
    earlier = Window.partitionBy(*key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.join(of_piece, [*key, piece], "left").select(*key, piece, F.last(value, ignorenulls=True).over(earlier).alias(before))

    forward = Window.partitionBy(*key, piece).orderBy(at, tag).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(value, ignorenulls=True).over(forward)
    found = placed.join(carry, [*key, piece], "left").select(tag, row, F.coalesce(own, before).alias(value)).where(F.col(tag) == 1)
    out = found.select(f"{row}.*", *[F.col(f"{value}.{c}").alias(c) for c in carried])
    rest = rows.where(~known).select("*", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in carried])
    return out.unionByName(rest)
