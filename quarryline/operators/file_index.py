"""A stored index of files for top-k retrieval by term frequency.

Postings lie in folders by segment and by the hash of their token, in blocks: a
block holds files of similar length, some ``BLOCK_FILES`` of them and less if
they are long, and a row has one token's entries of one block with the highest
term frequency among them. An entry is a file's number in its block; what file
that is stands in a table of the blocks, once for all its tokens. Files are
short or long block by block because term frequencies are large in short files,
so most blocks of long files are out of reach of a good match.

The words of the files are shuffled once, by block, and a block's postings are
made from them within its task and written from there; no entry is shuffled.

A search reads the folders of its own tokens. The highest frequencies alone
give a bound for each block and query; the most promising block of each query
is scored first, its k-th score is the least that matters, and of the other
blocks only those whose bound reaches it are read. The result is that of a
scan over all files.

An ingestion writes a segment of its own and the file's row in the table of
files (``sources.stored``), with its version. Entries of older versions are
left where they are and meet no row any more; ``compact`` writes one segment
without them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.reports import runs
from quarryline.sources.stored import Stored, exists, written

BUCKETS, BLOCK_FILES = 64, 512
#: A block's files have some so many tokens at most, with repeats; a file is never cut.
BLOCK_TOKENS = 1 << 21
#: Length classes are so many to a doubling.
CLASSES = 4
#: Tokens of a search that are also given to the reader as a list, to skip row groups.
LISTED = 1000
#: A search of so many rows of query and token is broadcast, so that sums stay with their block.
SENT = 100_000
#: An entry is a file's number in its block times this, plus how often the file has the token.
ENTRY = 1 << 32
ROW = "token string, block string, highest double, entries array<bigint>"
POSTINGS = f"{ROW}, segment int, bucket int"
BLOCKS = "block string, file int, repo_id string, file_id string, version bigint, total bigint, mark bigint, segment int"


def _file(entry: str) -> Column:
    return F.shiftright(entry, 32).cast("int")


def _n(entry: str) -> Column:
    return F.col(entry).bitwiseAND(F.lit(ENTRY - 1))


def _rows(block: str, tokens: pa.Array, file: np.ndarray, n: np.ndarray | None, totals: np.ndarray) -> pa.Table:
    """A row for each token of a block. ``n``: how often the token is in the file, or None if it comes as often as it is there."""
    coded = tokens.dictionary_encode()
    pair = coded.indices.to_numpy().astype(np.int64) * len(totals) + file
    if n is None:
        pair, n = np.unique(pair, return_counts=True)
    else:
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
    code, file = np.divmod(pair, len(totals))
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(file * ENTRY + n))
    token = coded.dictionary.take(pa.array(code[starts])).cast(pa.string())
    highest = np.maximum.reduceat(n / totals[file], starts) if len(starts) else np.zeros(0)
    return pa.table({"token": token, "block": pa.array([block] * len(starts), pa.string()), "highest": highest, "entries": entries})


def _of_words(given: pa.Table, files: pa.Table) -> pa.Table:
    """The postings of a block from its files' words; what was given twice counts once, and other versions not at all."""
    names = ("repo_id", "file_id", "version", "mark")
    key = lambda t: zip(*(t[x].to_pylist() for x in names))
    numbers, at = dict(zip(key(files), files["file"].to_pylist())), {}
    for i, k in enumerate(key(given)):
        if k in numbers:
            at.setdefault(numbers[k], i)
    lists = pc.split_pattern(given["words"].take(pa.array(list(at.values()), pa.int64())).cast(pa.large_string()).combine_chunks(), " ")
    sizes = pc.list_value_length(lists).to_numpy()
    totals = np.ones(max(numbers.values(), default=-1) + 1, np.int64)
    totals[files["file"].to_numpy()] = files["total"].to_numpy()
    return _rows(files["block"][0].as_py() if len(files) else "", lists.flatten(), np.repeat(np.array(list(at), np.int64), sizes), None, totals)


def _of_counts(counts: pa.Table) -> pa.Table:
    """The postings of a block from the counts of its files' tokens."""
    file = counts["file"].to_numpy().astype(np.int64)
    totals = np.ones(file.max() + 1, np.int64)
    totals[file] = counts["total"].to_numpy()
    return _rows(counts["block"][0].as_py(), counts["token"].cast(pa.large_string()).combine_chunks(), file, counts["n"].to_numpy().astype(np.int64), totals)


@dataclass(frozen=True)
class FileIndex:
    """The index at ``path``. Files have repo_id and file_id (strings), content, version (a long, larger for later ones) and place (a long, for ties)."""

    path: str
    buckets: int = BUCKETS
    block_files: int = BLOCK_FILES
    files: Stored = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "files", Stored(f"{self.path}/files", ("repo_id", "file_id"), (("version", "long"), ("place", "long")), self.buckets))

    @property
    def postings_path(self) -> str:
        return f"{self.path}/postings"

    @property
    def blocks_path(self) -> str:
        return f"{self.path}/blocks"

    def _bucket(self):
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def _segments(self, spark: SparkSession) -> list[int]:
        if not exists(spark, self.postings_path):
            return []
        at = spark._jvm.org.apache.hadoop.fs.Path(self.postings_path)
        listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
        return sorted(int(x.getPath().getName().split("=")[1]) for x in listed if x.getPath().getName().startswith("segment="))

    def _block(self, rows: DataFrame, segment: int) -> Column:
        """The block of a row with repo_id, file_id, version, total, of such sizes that ``rows`` fill them. All versions count, as their words come by too."""
        length = F.floor(F.log2(F.greatest("total", F.lit(1)).cast("double")) * CLASSES).cast("int")
        needed = F.greatest(F.count("*") / self.block_files, F.sum("total") / BLOCK_TOKENS)
        sizes = dict(rows.groupBy(length).agg(F.ceil(needed).cast("long")).collect())  # a row for each length class
        blocks = F.get(F.array(*[F.lit(sizes.get(i, 1)) for i in range(max(sizes, default=0) + 1)]), length)
        return F.format_string("%d-%d-%d", F.lit(segment), length, F.pmod(F.xxhash64("repo_id", "file_id", "version"), blocks))

    def _number(self, rows: DataFrame, segment: int, *more: str) -> DataFrame:
        """The files of the blocks with their numbers, from 0. ``rows``: block, repo_id, file_id, version, total, mark."""
        order = Window.partitionBy("block").orderBy("repo_id", "file_id")
        return rows.withColumn("file", F.row_number().over(order) - 1).select("block", "file", "repo_id", "file_id", "version", "total", "mark", *more)

    def _write(self, rows: DataFrame, segment: int) -> None:
        rows.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket", "token", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.postings_path}/segment={segment}")

    def ingest(self, files: DataFrame) -> int:
        """Add files, or new versions of files; returns the number of the segment. ``files``: repo_id, file_id, content, version, place.

        Of the rows of a file the last version counts, and the file keeps the
        place of its first ingestion. A row that is given twice counts once.
        Contents are never in an aggregate or a join; their words are shuffled once.
        """
        spark = files.sparkSession
        segment = max(self._segments(spark), default=-1) + 1
        mark = F.xxhash64("content").alias("mark")  # of two contents of one version, one counts
        given = written(files.select("repo_id", "file_id", F.col("version").cast("long").alias("version"), "place", F.size(runs(F.col("content"))).cast("long").alias("total"), mark), "given")
        block = self._block(given, segment)
        last = given.groupBy("repo_id", "file_id").agg(F.max(F.struct("version", "total", "mark")).alias("last"), F.min("place").alias("place")).select("repo_id", "file_id", "last.*", "place")
        kept = last.where("total > 0 AND repo_id IS NOT NULL AND file_id IS NOT NULL AND version IS NOT NULL").withColumn("block", block)
        self._number(kept, segment).write.mode("overwrite").parquet(f"{self.blocks_path}/segment={segment}")
        # no filter here: it would be repeated below, with the runs of each row
        found = files.select("repo_id", "file_id", F.col("version").cast("long").alias("version"), mark, runs(F.col("content")).alias("runs"))
        counted = found.select("repo_id", "file_id", "version", "mark", F.lower(F.array_join("runs", " ")).alias("words"), F.size("runs").cast("long").alias("total"))
        words = counted.select(block.alias("block"), "repo_id", "file_id", "version", "mark", "words")
        numbered = self.blocks(spark).where(F.col("segment") == segment).select("block", "file", "repo_id", "file_id", "version", "total", "mark")
        self._write(words.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_of_words, ROW), segment)
        # as changes of the stored table: a later version wins, an earlier place stays
        unset = F.lit(None).cast("long")
        places = last.select("repo_id", "file_id", unset.alias("version"), "place", (-F.col("place")).alias("seq"))
        self.files.apply(last.select("repo_id", "file_id", "version", unset.alias("place"), F.col("version").alias("seq")).unionByName(places), "seq")
        return segment

    def compact(self, spark: SparkSession) -> int:
        """All current entries in one new segment; the older ones go once it is written."""
        old = self._segments(spark)
        segment = max(old, default=-1) + 1
        alive = written(self.current(spark).where("alive").select("repo_id", "file_id", "version", "total", "mark", F.col("block").alias("old_block"), F.col("file").alias("old_file")), "alive")
        numbered = written(self._number(alive.withColumn("block", self._block(alive, segment)), segment, "old_block", "old_file"), "numbered")
        numbered.drop("old_block", "old_file").write.mode("overwrite").parquet(f"{self.blocks_path}/segment={segment}")
        each = self.postings(spark).select(F.col("block").alias("old_block"), "token", F.explode("entries").alias("entry"))
        counts = each.select("old_block", _file("entry").alias("old_file"), "token", _n("entry").alias("n")).join(numbered, ["old_block", "old_file"]).select("block", "file", "token", "n", "total")
        self._write(counts.groupBy("block").applyInArrow(_of_counts, ROW), segment)
        for n in old:
            for path in (self.postings_path, self.blocks_path):
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment={n}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return segment

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).option("basePath", self.postings_path).parquet(self.postings_path)

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCKS).option("basePath", self.blocks_path).parquet(self.blocks_path)

    def current(self, spark: SparkSession) -> DataFrame:
        """The files of the blocks with their place and ``alive``: of each file the current version, in the last segment that has it."""
        rows = self.blocks(spark).where(F.col("segment").isin(self._segments(spark)))
        now = self.files.read(spark).select("repo_id", "file_id", F.col("version").alias("now"), "place")
        last = F.max("segment").over(Window.partitionBy("repo_id", "file_id", "version"))
        return rows.join(now, ["repo_id", "file_id"]).withColumn("alive", (F.col("version") == F.col("now")) & (F.col("segment") == last))

    def _of(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        """The postings in the folders of the queries' tokens; of few tokens, theirs alone."""
        wanted = asked.select("token").distinct().withColumn("bucket", self._bucket())
        rows = rows.where(F.col("bucket").isin([r[0] for r in wanted.select("bucket").distinct().collect()]))  # ``buckets`` numbers at most
        few = wanted.select("token").limit(LISTED + 1).collect()
        return rows.where(F.col("token").isin([r[0] for r in few])) if len(few) <= LISTED else rows

    def bounds(self, asked: DataFrame) -> DataFrame:
        """key, block, bound: what a file of the block can score at most. ``asked``: key, token, qn."""
        spark = asked.sparkSession
        rows = self._of(asked, self.postings(spark).select("token", "block", "highest", "bucket"))
        return rows.join(asked, "token").groupBy("key", "block").agg((F.sum(F.col("qn") * F.col("highest")) * (1 + 1e-9)).alias("bound"))

    def scored(self, asked: DataFrame, blocks: DataFrame, repo: str | None = None) -> DataFrame:
        """key, block, file, place, score of the current files (of one repository or all) in the given blocks (key, block)."""
        spark = asked.sparkSession
        total = F.when(F.col("alive") if repo is None else F.col("alive") & (F.col("repo_id") == repo), F.col("total")).alias("total")  # null: not to be scored
        open_ = blocks.groupBy("block").agg(F.collect_set("key").alias("keys"))
        files = self.current(spark).join(open_.select("block"), "block", "left_semi").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("file", "place", total))).alias("files"))
        each = open_.join(files, "block").select("block", "keys", F.col("files.place").alias("places"), F.col("files.total").alias("totals"))
        # postings are shuffled once, by block and not for each query; a file's sums are then made where its block is
        rows = self._of(asked, self.postings(spark).select("token", "block", "bucket", "entries")).drop("bucket")
        rows = rows.join(asked.select("token").distinct(), "token", "left_semi").join(open_.select("block"), "block", "left_semi").repartition("block")
        asked = F.broadcast(asked) if asked.limit(SENT + 1).count() <= SENT else asked
        found = rows.join(each, "block").join(asked, "token").where(F.array_contains("keys", F.col("key")))
        found = found.select("block", "key", "qn", "places", "totals", F.explode("entries").alias("entry"))
        at = _file("entry")
        found = found.select("block", "key", at.alias("file"), (F.col("qn") * _n("entry")).alias("n"), F.get("places", at).alias("place"), F.get("totals", at).alias("total"))
        sums = found.where("total IS NOT NULL").groupBy("block", "key", "file").agg((F.sum("n") / F.first("total")).alias("score"), F.first("place").alias("place"))
        return sums.select("key", "block", "file", "place", "score")

    def open_blocks(self, asked: DataFrame, k: int, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(the scores of the first blocks, the other blocks that can still matter): the bound of each reaches the k-th score so far."""
        bounds = written(self.bounds(asked), "bounds")  # a row for each query and block, used three times
        best = Window.partitionBy("key").orderBy(F.col("bound").desc(), "block")
        first = bounds.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("key", "block")
        seeds = written(self.scored(asked, first, repo), "seeds")  # a block's files for each query, used twice
        ranked = Window.partitionBy("key").orderBy(F.col("score").desc(), "place")
        least = seeds.withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") == k).select("key", F.col("score").alias("least"))
        rest = bounds.join(first, ["key", "block"], "left_anti").join(least, "key", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0))).select("key", "block")
        return seeds, written(rest, "rest")

    def search(self, asked: DataFrame, k: int, repo: str | None = None) -> DataFrame:
        """key, rank, repo_id, file_id, score: the k best files of each query, of one repository or all. ``asked``: key, token, qn (``retrieval.query_counts``)."""
        seeds, rest = self.open_blocks(asked, k, repo)
        best = Window.partitionBy("key").orderBy(F.col("score").desc(), "place")
        every = seeds.unionByName(self.scored(asked, rest, repo)).where("score > 0")
        ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return self.blocks(asked.sparkSession).join(ranked, ["block", "file"]).select("key", "rank", "repo_id", "file_id", "score")
