"""Operator 13: spelling variants by two-dimensional range reporting.

Words of one length class are sorted forward and by their reversals. Two words
are one edit apart exactly if for some position the first has the second's
prefix before it and the second's suffix after it, so the partners of a word at
a position are the points (forward rank, reverse rank) of a rectangle: the
interval of words with that prefix by the interval of words with that suffix. A
wavelet tree over the reverse ranks in forward order reports the points of
each rectangle; all rectangles of a tile go down the tree together.

Replaced code points pair words of one length; inserted and deleted ones pair a
word with one that is longer by one, looked up from the shorter. An inserted
code point equal to the one before it counts at the first place of its run
only, so each pair is found once.

A tile is the words of length L as the shorter ones and those of length L + 1,
with a range of positions [p, q] and one text before p and after q, which all
its words share. Each class begins with its two halves of positions. A tile of
more than ``CELLS`` letters is halved again, which makes what its words share
longer, until it is small or has one position left; then its words differ in
two letters at most, so their number is bounded by the alphabet. No tile is
cut by a cap, and a hot prefix or suffix costs a few further tiles. Small tiles
of one class and range are dealt by their shared text to bins of about
``CELLS`` letters, and a bin's tiles go through one tree: as every rectangle lies
within the shared text of its tile, no pair joins two tiles.

Each bin sends, for each of its words, the number of partners and the best of
them; these are summed by word, so pairs are never written. Forms lead to
words ten times as frequent, so the chains to the roots are short; they are
followed by doubling, in as many joins as the logarithm of their bound.

Defined results: null and empty texts have no words; a null id counts as empty
text before the colon; repeated rows count each; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import discard, written

MIN_LENGTH, MIN_COUNT, FACTOR, DELETED = 7, 2, 10, 31
#: Letters of a tile, beyond which it is halved, and of a bin, about.
CELLS = 500_000


def observed_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters with the contract's deletions, counted over all rows. Shorter runs cannot become words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.when(F.col("h") % DELETED == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    words = lowered.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))).withColumn("at", at).select(cut.alias("word"))
    return words.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- one tile


class Wavelet:
    """A wavelet tree over a permutation: for many rectangles at once, the values within them."""

    def __init__(self, values):
        import numpy as np

        self.height = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.ones, self.zeros = [], []
        for level in range(self.height - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left, right, low, high):
        """(rectangle, value) of every value in [low, high) at the places [left, right)."""
        import numpy as np

        which, prefix = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.height - 1, -1, -1), strict=True):
            a, b = ones[left], ones[right]
            which, prefix = np.concatenate([which, which]), np.concatenate([prefix, prefix | (1 << level)])
            left, right = np.concatenate([left - a, zeros + a]), np.concatenate([right - b, zeros + b])
            keep = (left < right) & (prefix < high[which]) & (prefix + (1 << level) > low[which])
            which, prefix, left, right = which[keep], prefix[keep], left[keep], right[keep]
        return which, prefix


def _intervals(ranks, common, size: int):
    """For the words at ``ranks`` of an order: the interval of words that have ``size`` code points in common with each."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], common < size]))
    ends = np.concatenate([starts[1:], [len(common) + 1]])
    group = np.searchsorted(starts, ranks, side="right") - 1
    return starts[group], ends[group]


def _common(codes, order):
    """How many leading columns each row of ``codes`` has in common with the one before it in ``order``."""
    import numpy as np

    found = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    for a in range(0, len(found), 4096):  # so that a comparison stays small
        x, y = codes[order[a : a + 4096][: len(found) - a]], codes[order[a + 1 : a + 4097]]
        differ = x != y
        found[a : a + len(y)] = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
    return found


def pairs_of_tile(words: list[str], shorter: int, low: int, high: int):
    """(i, j): the pairs of ``words`` one edit apart, at a position in [low, high], of which one at least has ``shorter`` code points."""
    import numpy as np

    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), shorter + 1), dtype=np.uint32)
    backwards = np.zeros_like(codes)
    for size in (shorter, shorter + 1):
        at = np.flatnonzero(lengths == size)
        if len(at):
            own = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), dtype="<u4").reshape(len(at), size)
            codes[at, :size], backwards[at, :size] = own, own[:, ::-1]
    tables = []
    for table in (codes, backwards):
        order = np.lexsort(table.T[::-1])  # a shorter word's 0 sorts before every letter
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        tables.append((order, rank, _common(table, order)))
    (order, rank, before), (r_order, r_rank, after) = tables
    is_short = lengths == shorter
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for longer in (False, True):
        target = ~is_short if longer else is_short
        if not target.any() or not is_short.any():
            continue
        # the points: targets in forward order, with their ranks among the targets in reverse order
        at, r_at = np.concatenate([[0], np.cumsum(target[order])]), np.concatenate([[0], np.cumsum(target[r_order])])
        tree = Wavelet(r_at[r_rank[order[target[order]]]])
        r_names = r_order[target[r_order]]
        query = np.flatnonzero(is_short)
        first = max(low, shorter - (not longer) - int(after.max(initial=0)))  # elsewhere no two words share enough
        for position in range(first, min(high, shorter if longer else shorter - 1, int(before.max(initial=0))) + 1):
            a, b = _intervals(rank[query], before, position)
            c, d = _intervals(r_rank[query], after, shorter - position - (not longer))
            left, right, bottom, top = at[a], at[b], r_at[c], r_at[d]
            least = 1 if longer else 2  # a word is in its own rectangle
            use = (right - left >= least) & (top - bottom >= least)
            if not use.any():
                continue
            mine = query[use]
            which, value = tree.report(left[use], right[use], bottom[use], top[use])
            i, j = mine[which], r_names[value]
            if longer:
                ok = codes[j, position] != codes[i, position - 1] if position else np.ones(len(i), dtype=bool)
            else:
                ok = i < j
            found_i.append(i[ok])
            found_j.append(j[ok])
    return np.concatenate(found_i), np.concatenate(found_j)


# ---------------------------------------------------------------- Spark


def _shared(low: Column, high: Column) -> Column:
    """What a word of a tile has before position ``low`` and after ``high``; a longer word has one code point more between."""
    tail = F.col("shorter") - 1 - high
    return F.concat_ws("\x00", F.expr("substring(word, 1, low)"), F.when(tail > 0, F.right("word", tail)).otherwise(F.lit("")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each word in both halves of its range, with what it shares there."""
    middle = F.expr("(low + high) div 2")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.cast("int").alias("high")), F.struct((middle + 1).cast("int").alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "shorter", F.explode(halves).alias("half")).select("word", "n", "shorter", "half.*").withColumn("shared", _shared(F.col("low"), F.col("high")))


def near_words(words: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """word, n_near, best (minus, word): the number of words one edit away and the most frequent of them, for each word that has one."""
    size, letters = F.char_length("word"), F.count("*") * (F.col("shorter") + 1)
    classes = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("shorter"))
    todo, done, kept = _halves(classes.withColumns({"low": F.lit(0), "high": F.col("shorter")})), None, []
    while True:
        now = written(todo, "variants-tiles")
        key = ["shorter", "low", "high", "shared"]
        large = written(now.where("low < high").groupBy(*key).agg(letters.alias("__n")).where(F.col("__n") > cells).select(*key), "variants-large")
        kept += [now, large]
        more = large.limit(1).count() > 0
        small = now.join(large, key, "left_anti") if more else now
        done = small if done is None else done.unionByName(small)
        if not more:
            break
        todo = _halves(now.join(large, key, "left_semi"))
    sizes = written(done.groupBy("shorter", "low", "high").agg(F.ceil(letters / cells).alias("__bins")), "variants-bins")  # a row for each length and range
    binned = done.join(sizes, ["shorter", "low", "high"]).withColumn("bin", F.pmod(F.xxhash64("shared"), F.col("__bins"))).select("word", "n", "shorter", "low", "high", "bin")
    binned = binned.repartition("shorter", "low", "high", "bin")  # else a join's partitions, by class, would do for the groups
    kept.append(sizes)

    def run(tile_key, table):
        import numpy as np
        import pyarrow as pa

        shorter, low, high = (tile_key[k].as_py() for k in range(3))
        names = table.column("word").to_pylist()
        by_rank = sorted(range(len(names)), key=names.__getitem__)  # code-point order
        names = [names[i] for i in by_rank]
        n = table.column("n").to_numpy()[by_rank]
        i, j = pairs_of_tile(names, shorter, low, high)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.concatenate([first, [len(a)]]))
        return pa.table({"word": [names[k] for k in a[first]], "n": pa.array(n[a[first]], pa.int64()), "partners": pa.array(size, pa.int64()), "best": [names[k] for k in b[first]], "best_n": pa.array(n[b[first]], pa.int64())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("partners", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())]))

    found = binned.groupBy("shorter", "low", "high", "bin").applyInArrow(run, "word string, n long, partners long, best string, best_n long")
    near = found.groupBy("word").agg(F.sum("partners").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best"))
    out = written(near, "variants-near")
    discard(*kept)
    return out


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root for rows (word, form): the end of each chain. ``most``: the largest count; each step multiplies it by FACTOR at least."""
    now, kept = forms.select("word", F.col("form").alias("root")), []
    for _ in range(max(1, math.ceil(math.log2(math.log(max(most, 2), FACTOR) + 1)))):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variants-roots")
        kept.append(now)
    discard(*kept[:-1])
    return now


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents."""
    words = written(observed_words(docs, id_col=id_col, text_col=text_col), "variants-words")
    near = near_words(words, cells=cells)
    best = near.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))
    met = words.join(best, "word", "left")
    found = F.col("form_n") >= FACTOR * F.col("n")
    judged = written(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("form")).alias("form"), F.when(found, F.col("form_n")).alias("form_n")), "variants-forms")
    discard(words, near)
    ends = roots(judged.where("form IS NOT NULL"), judged.agg(F.max("n")).first()[0] or 0)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 is linear: a message's is the exclusive or of what each byte gives at its distance from the end, and of what the start value gives over the length.
ORACLE = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT b, v FROM bits WHERE k = 8),
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, sum(times) AS times
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, 1 AS times FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents)) GROUP BY 1, 2
), messages AS (SELECT id, run, times, hex(id || ':' || run) AS h FROM runs),
longest AS (SELECT coalesce(max(length(h)) // 2, 0) AS most FROM messages),
start(n, z) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL SELECT n + 1, xor(v, z >> 8) FROM start JOIN tab ON b = z & 255, longest WHERE n < most),
gives(d, b, v) AS (SELECT 0, b, v FROM tab UNION ALL SELECT d + 1, g.b, xor(t.v, g.v >> 8) FROM gives g JOIN tab t ON t.b = g.v & 255, longest WHERE d + 1 < most),
bytes AS (SELECT id, run, times, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS k, h FROM messages),
hashed AS (
  SELECT id, run, any_value(times) AS times, xor(xor(any_value(z), bit_xor(v)), 4294967295) AS crc
  FROM bytes JOIN gives ON gives.d = bytes.n - 1 - k AND gives.b = CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT) JOIN start ON start.n = bytes.n GROUP BY id, run
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2
), cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON w.word = a.rest
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, min(near) FILTER (near_n = most) AS best FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS most FROM pairs) GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, upto, steps) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.upto WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(upto, steps) AS root FROM chain GROUP BY 1) USING (word)
"""
