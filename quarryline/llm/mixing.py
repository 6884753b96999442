"""Operator 10: mixing sources to target weights by capped water-filling.

Every source gets a share of the total number of words by its weight. A source
can be repeated ``max_epochs`` times at most; what it cannot take is shared
again among the others by weight, until no target is above its cap. A document
is then taken whole ``floor(target / size of the source)`` times, and a seeded
sample of whole documents makes up the rest.

The sample is a prefix of the source in the order of a seeded hash. Its cut is
found by a histogram over 4,096 ranges of the hash, refined within the one
range that holds the cut, 12 bits of the hash at a time, until that range has
``SORTED_ROWS`` rows of any source at most; these are sorted. So no source is
ever sorted or gathered as a whole. Equal rows have equal hashes: where the
cut falls among them, as many of them are taken as bring the source nearest
to its target, the first by their place in the table. Those at the cut are
numbered by counts of each partition and, within the one partition that holds
the last, by a sort.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; of equal rows at the cut some are taken once more than others,
the same number in every run; documents of size 0 take 0; an empty table gives
an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 42
#: Bits of the hash that a histogram's ranges go by; each refinement takes so many more.
RANGE_BITS = 12
#: Rows of a source that are sorted to find its cut.
SORTED_ROWS = 10_000


def _hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _key(source: str) -> Column:
    """Equal for equal sources, null included, so that plain equality joins."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def sized(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", seed=SEED) -> DataFrame:
    """id, key (of the source), h (the seeded hash), size, place (in the table): one narrow row for each document."""
    return docs.select(
        F.col(id_col).alias("id"),
        _key(source_col).alias("key"),
        _hash(id_col, text_col, seed).alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("place"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Water-filling over one row for each source (key, source_size): adds ``target``.

    Weights repeat over the sources by code point, null last. In the order of
    cap / weight, the first source that is not filled at the level which the
    sources before it leave gives the level of all that follow.
    """
    every = Window.partitionBy()
    by_name = every.orderBy(F.col("key").startswith("n").asc(), F.col("key"))
    by_room = every.orderBy("room", "key")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("n", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.first(F.when(F.col("room") > F.col("level"), F.col("level")), ignorenulls=True).over(whole))
        .select("key", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """key, source_size, target, whole, and the cut of the sample: hashes below ``last``, and the first ``ties`` rows of that hash."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    running = lambda by: Window.partitionBy("key").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def holding(found: DataFrame, by: str) -> DataFrame:
        """Of the sums and counts of each source's values of ``by``, the value that holds the cut, and what is needed of it."""
        upto = found.withColumn("upto", F.sum("sum").over(running(by))).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("sum") < F.col("need")))
        return upto.withColumn("need", F.col("need") - F.col("upto") + F.col("sum")).drop("upto")

    open_ = goals.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need")).where("need > 0")
    inside = rows.select("key", "h", "size").join(open_, "key")
    for bits in range(RANGE_BITS, 64, RANGE_BITS):
        sums = inside.groupBy("key", "need", F.shiftright("h", 64 - bits).alias("range")).agg(F.sum("size").alias("sum"), F.count("*").alias("rows"))
        cut = written(holding(sums, "range"), "mix-cuts")
        inside = rows.select("key", "h", "size").join(cut.select("key", "need", "range"), "key").where(F.shiftright("h", 64 - bits) == F.col("range")).drop("range")
        if (cut.agg(F.max("rows")).first()[0] or 0) <= SORTED_ROWS:
            break
    last = holding(inside.groupBy("key", "need", "h").agg(F.sum("size").alias("sum"), F.count("*").alias("rows")), "h")
    last = last.select("key", F.col("h").alias("last"), F.round(F.col("need") * F.col("rows") / F.col("sum")).cast("long").alias("ties"))
    return goals.join(last, "key", "left").select("key", "source_size", "target", "whole", "last", "ties")


def plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(sized rows, one row of decision for each source); both written to the shared folder."""
    rows = written(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed), "mix-sizes")
    goals = written(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-targets")
    return rows, written(cuts(rows, goals), "mix-plan")


def _copied(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds the columns of ``goals`` and ``copies`` to ``rows`` (key, h, place): how often each is taken."""
    joined = rows.join(goals, "key")
    tied = F.coalesce(F.col("h") == F.col("last"), F.lit(False))
    sure = joined.where(~tied).withColumn("copies", F.col("whole") + F.coalesce(F.col("h") < F.col("last"), F.lit(False)).cast("long"))
    ties = written(joined.where(tied), "mix-ties")
    part = F.shiftright("place", 33)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = ties.groupBy("key", part.alias("part"), "ties").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = written(counts.withColumn("left", F.col("ties") - F.col("before")), "mix-tie-counts").select("key", "part", "n", "left")
    placed = ties.withColumn("part", part).join(counts, ["key", "part"])
    split = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    whole = placed.where(~split).withColumn("extra", F.col("left") > 0)
    cut = placed.where(split).withColumn("extra", F.row_number().over(Window.partitionBy("key").orderBy("place")) <= F.col("left"))
    taken = whole.unionByName(cut).withColumn("copies", F.col("whole") + F.col("extra").cast("long")).select(*sure.columns)
    return sure.unionByName(taken)


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """id, size, source_size, target, copies, taken for every document."""
    out = _copied(*plan(docs, **options))
    return out.select(F.col("id").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken, with the columns of ``docs``."""
    _, goals = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    keyed = docs.select(F.struct("*").alias("row"), _key(source_col).alias("key"), _hash(id_col, text_col, options.get("seed", SEED)).alias("h"), F.monotonically_increasing_id().alias("place"))
    times = _copied(keyed, goals.drop("source_size", "target")).where("copies > 0")
    return times.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies")
