"""Operator 4: quality rules with risk-controlled thresholds. DataFrame operations only.

Fixed rules reject a text that is too short or mostly repeats itself. Beyond
them, each rule of ``_rules`` rejects texts whose measure lies above a cutoff,
and the cutoffs are chosen per stratum (language) so that few good documents
are rejected by mistake, with a guarantee:

* the labelled good documents of a stratum are a holdout of n draws;
* a cutoff whose rule rejects k of them is safe if P(Bin(n, ALPHA) <= k) is at
  most the test's level: the exact binomial (Clopper-Pearson) bound of the
  false rejection rate then lies below ALPHA;
* that holds for all k up to some k*(n), so the safe cutoffs are those values
  that at most k* good documents exceed. Cutoffs are tested from lax to strict
  and their rejections are nested (fixed-sequence testing), so the search over
  cutoffs costs nothing and any safe cutoff may be used. The one with the most
  labelled bad documents rejected, less GOOD_WEIGHT for each good one, is; a
  rule that gains nothing that way is left out of the stratum;
* strata and rules are corrected for together (Bonferroni): with R rules in S
  strata each test has the level DELTA / (R S). With probability 1 - DELTA no
  rule in any stratum rejects over ALPHA of its good documents, so together
  they reject at most R * ALPHA of a stratum's.

A stratum with too few good documents for any safe cutoff gets none, and keeps
everything that the fixed rules keep.

Measures are rounded down to a grid that ends at ``TOP``, so that a stratum's
holdout is a histogram of bounded size; counts are aggregated before they are shuffled, and
no stratum is gathered. Everything about one text is computed within its row.

Defined results: a null or empty text has no words and fails the fixed rules;
a null language is a stratum of its own; labels without a document, and null
labels, count nowhere; of labels that differ for one id, good counts; rows
that share an id are one draw of the holdout, the largest by stratum and
counts; an empty table of either kind works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import WORD, written

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
ALPHA, DELTA = 0.02, 0.05
GRID, GOOD_WEIGHT = 1000, 10
#: Measures end here: eight marks for each word and more are one value.
TOP = 8 * GRID


def _rules() -> dict[str, Column]:
    """Each rule's measure of a row of ``measures``; higher is worse. All are whole numbers of the grid."""
    per_word = lambda c: F.least(F.floor(F.lit(GRID) * F.col(c) / F.greatest(F.col("n_words"), F.lit(1))), F.lit(TOP))
    return {
        "symbols": per_word("n_symbols"),
        "dup_lines": per_word("n_dup_lines"),
        "repeats": per_word("n_repeat_words"),
    }


def _window_hashes(words: Column, window: int) -> Column:
    """The 64-bit hash of each window of words, null where there are too few words."""
    n = F.size(words)
    places = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, window)))
    return F.when(n < window, F.lit(None).cast("array<bigint>")).otherwise(hashes)


def _covered_by_repeats(hashes: Column, window: int) -> Column:
    """The number of words under windows whose hash is not alone, the first of equals included.

    Hashes are sorted with their places; the places of equal neighbours cover the words.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    with_next = F.zip_with(pairs, F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("next")))
    marked = F.zip_with(with_next, F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(False).alias("next"))), with_next), lambda a, b: F.when(F.coalesce(a["next"], F.lit(False)) | F.coalesce(b["next"], F.lit(False)), a["i"]))
    places = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + window).alias("upto"), (acc["n"] + i + window - F.greatest(acc["upto"], i)).alias("n"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def measures(docs: DataFrame, *, id_col="doc_id", text_col="text", stratum_col="lang") -> DataFrame:
    """doc_id, stratum, and the counts of each text as narrow rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    worded = base.select(
        "doc_id",
        "stratum",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = worded.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _window_hashes(F.col("words"), WINDOW).alias("hashes")
    )
    repeats = F.when(F.col("hashes").isNull() | (F.size(F.array_distinct("hashes")) == F.size("hashes")), F.lit(0)).otherwise(_covered_by_repeats(F.col("hashes"), WINDOW))
    return hashed.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def most_rejections(n: Column, alpha: float, level: Column) -> Column:
    """The largest k with P(Bin(n, alpha) <= k) <= level, -1 if there is none.

    A fold over k adds up the binomial's terms by their logarithms, up to the
    mean, beyond which the sum is over a third. It begins at 0, or for a large
    holdout 12 standard deviations below the mean, where the terms left out
    come to less than 1e-30; so it has a number of steps that grows with the
    root of n.
    """
    import math

    odds = math.log(alpha / (1 - alpha))
    low = F.floor(n * F.lit(alpha) - 12 * F.sqrt(n * F.lit(alpha * (1 - alpha))))
    low = F.when(low >= 100, low).otherwise(0).cast("bigint")

    def log_factorial(x: Column) -> Column:  # Stirling's series, exact to the last bits from 100 on
        x = x.cast("double")
        return x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    at_low = log_factorial(n) - log_factorial(low) - log_factorial(n - low) + low * F.lit(math.log(alpha)) + (n - low) * F.lit(math.log1p(-alpha))
    first = F.when(low > 0, at_low).otherwise(n * F.lit(math.log1p(-alpha)))
    zero = F.struct(first.cast("double").alias("log_p"), F.lit(float("-inf")).alias("log_sum"), F.lit(-1).cast("bigint").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        high = F.greatest(acc["log_sum"], acc["log_p"])
        total = high + F.log(F.exp(acc["log_sum"] - high) + F.exp(acc["log_p"] - high))
        following = acc["log_p"] + F.log((n - k).cast("double") / (k + 1)) + F.lit(odds)
        return F.struct(following.alias("log_p"), total.alias("log_sum"), F.when(total <= F.log(level), k).otherwise(acc["k"]).alias("k"))

    last = F.least(F.ceil(n * F.lit(alpha)), n - 1)
    return F.aggregate(F.sequence(low, F.greatest(last, low).cast("bigint")), zero, step, lambda acc: acc["k"])


def thresholds(rows: DataFrame, labels: DataFrame, *, alpha=ALPHA, delta=DELTA) -> DataFrame:
    """stratum, rule, cutoff, n, k: a text is rejected where its measure is above the cutoff; no row, no rejection.

    rows: of ``measures``; labels: doc_id, quality (1 good, 0 bad). Texts that
    fail the fixed rules are not the rules' to reject and count nowhere.
    """
    rules = _rules()
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("__good"))
    measured = [c for c in rows.columns if c != "doc_id"]
    held = rows.where(~base_failed()).join(marks, "doc_id").groupBy("doc_id", "__good").agg(F.max(F.struct(*measured)).alias("m")).select("doc_id", "__good", "m.*")
    long = held.select("stratum", "__good", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), value.cast("long").alias("value")) for name, value in rules.items()])).alias("r"))
    bins = written(long.groupBy("stratum", "r.rule", "r.value").agg(F.sum("__good").cast("long").alias("good"), F.sum(1 - F.col("__good")).cast("long").alias("bad")), "rule-bins")
    strata = bins.groupBy("stratum").agg((F.sum("good") / len(rules)).cast("bigint").alias("n")).where("n > 0")
    level = F.lit(delta) / (len(rules) * F.count("*").over(Window.partitionBy()))  # one row for each stratum
    limits = strata.withColumn("level", level).select(F.col("stratum").alias("__stratum"), "n", most_rejections(F.col("n"), alpha, F.col("level")).alias("k")).where("k >= 0")
    above = Window.partitionBy("stratum", "rule").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each value on the grid
    summed = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    found = bins.select("stratum", "rule", "value", summed("good").alias("good"), (summed("bad") - GOOD_WEIGHT * summed("good")).alias("gain"))
    safe = found.join(limits, F.col("stratum").eqNullSafe(F.col("__stratum"))).where((F.col("good") <= F.col("k")) & (F.col("gain") > 0))
    return safe.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "value"))["value"].alias("cutoff"), F.first("n").alias("n"), F.first("k").alias("k"))


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the rows of ``measures``."""
    rules = _rules()
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"__{name}") for name in rules]).withColumnRenamed("stratum", "__stratum")
    joined = rows.join(wide, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    bad = F.lit(False)
    for name, value in rules.items():
        bad = bad | F.coalesce(value > F.col(f"__{name}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)


def quality_rules(docs: DataFrame, labels: DataFrame, *, alpha=ALPHA, delta=DELTA, stratum_col="lang") -> DataFrame:
    rows = written(measures(docs, stratum_col=stratum_col), "rule-measures")
    cutoffs = written(thresholds(rows, labels, alpha=alpha, delta=delta), "rule-cutoffs")
    return judged(rows, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
