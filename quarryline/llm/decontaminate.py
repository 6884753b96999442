"""Operator 7: benchmark decontamination by a prefix-filtered set join. DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (an item of fewer
words is one window). A document contains a window if all its one-word
shingles are there, one after the other, so by the prefix principle one
shingle is a necessary prefix: whichever stands first in the order by rarity
over all documents. The join then is

1. count the benchmark's words over all documents, and order each window's
   shingles by that count, rarest first;
2. join the words of the documents with the windows on the rarest shingle;
3. bound by position and length: a match at position p of a shingle at offset
   o of the window needs p >= o and room for the rest of the window;
4. verify the window word by word at the one place left.

Steps 2 to 4 run in one pass over the texts: positions that miss never leave
the generated code, and no text is shuffled. Each document also sends one row
of its own, so documents without hits need no second pass. A hit is its place
and the number of its window's set of items (windows of the same items share
one set); the items themselves are joined when each document has each set but
once.

The windows are broadcast in pieces of ``PIECE_ROWS`` rows, each a bounded
number of bytes but for the length of its words, counted before; a larger
benchmark takes one pass for each piece, with the same result.

Defined results: a null or empty text has no words and is clean; an item
without words has no windows; a null item id is the empty string; rows that
repeat an item id are one item; each row of a repeated document has its own
result; an empty table of either kind works; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import ascii_lower, written

WINDOW = 10
#: A word after lower-casing A-Z: digits, a-z and everything beyond ASCII. Java takes a tenth of the time for it that the same class by what is not in it takes.
PATTERN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: Windows, and words to be counted, that are broadcast at once.
PIECE_ROWS, COUNTED_ROWS = 100_000, 2_000_000
OWN = -1  # the window id of a document's own row


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PATTERN), F.lit(0))


def benchmark_windows(items: DataFrame, *, id_col="item_id", text_col="text", window=WINDOW) -> DataFrame:
    """window_words, items: each distinct window with the ids of its items, in order."""
    worded = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    cut = F.when(F.size("words") < window, F.array("words")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))), lambda i: F.slice("words", i, window)))
    return worded.select("item", F.explode(cut).alias("window_words")).groupBy("window_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def rarest_first(docs_text: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``h`` and ``offset`` of each window's rarest shingle, by its count over all texts."""
    known = written(windows.select(F.explode("window_words").alias("w")).select(F.xxhash64("w").alias("h")).distinct(), "decon-words")
    seen = docs_text.select(F.explode(words_of(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("h"))
    counted = lambda rows: rows.groupBy("h").agg(F.count("*").alias("n"))
    # words that cannot be broadcast meet the corpus's counts, which are summed in each task before they are shuffled, not its words
    counts = counted(seen.join(F.broadcast(known), "h")) if known.count() <= COUNTED_ROWS else counted(seen).join(known, "h")
    shingles = windows.select("wid", F.posexplode("window_words").alias("offset", "w")).select("wid", "offset", F.xxhash64("w").alias("h"))
    first = shingles.join(counts, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("h"))).alias("rare"))
    return windows.join(first, "wid").select("wid", "window_words", "set", F.col("rare.h").alias("h"), F.col("rare.offset").alias("offset"))


def _hits(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, set, span for each verified window, and each document's own row."""
    size, start, length = F.size("words"), F.col("pos") - F.col("offset"), F.size("window_words")
    whole = F.when((start >= 0) & (start + length <= size), F.slice("words", start + 1, length) == F.col("window_words")).otherwise(F.lit(False))
    placed = rows.select("rid", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "w"))
    joined = placed.withColumn("h", F.xxhash64("w")).join(F.broadcast(keys), "h")
    own = F.col("wid") == OWN
    return joined.where(F.when(own, F.col("pos") == size).otherwise(whole)).select(
        "rid", "doc_id", size.alias("n_words"), F.when(~own, F.col("set")).alias("set"), F.when(~own, F.struct(start.alias("start"), length.alias("len"))).alias("span")
    )


def _covered(spans: Column) -> Column:
    """Words in the union of (start, len) spans."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["start"] + s["len"]).alias("upto"), (acc["n"] + F.greatest(s["start"] + s["len"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window=WINDOW, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    texts = docs.select(F.col(text_col).alias("text"))
    found = written(benchmark_windows(items, id_col=item_col, text_col=item_text, window=window).select(F.monotonically_increasing_id().alias("wid"), "window_words", "items"), "decon-windows")
    sets = written(found.groupBy("items").agg(F.min("wid").alias("set")), "decon-sets")
    windows = written(found.join(sets, "items").select("wid", "window_words", "set"), "decon-windows")
    keys = written(rarest_first(texts, windows), "decon-keys")
    own = keys.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.lit(OWN).cast("long").alias("wid"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("window_words"), F.lit(None).cast("long").alias("set"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    total, found = keys.count(), None
    pieces = max(1, -(-total // PIECE_ROWS))
    for piece in range(pieces):
        part = keys if pieces == 1 else keys.where(F.pmod(F.xxhash64("wid"), F.lit(pieces)) == piece)
        part = part.select("h", "wid", "offset", "window_words", "set")
        hits = _hits(rows, part.unionByName(own) if piece == 0 else part)
        found = hits if found is None else found.unionByName(hits)
    by_set = found.groupBy("rid", "set").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"))
    by_row = (
        by_set.join(sets, "set", "left")
        .groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").cast("long").alias("n_words"),
            _covered(F.array_distinct(F.flatten(F.collect_list("spans")))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    return by_row.select(*(["rid"] if keep_row else []), "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
