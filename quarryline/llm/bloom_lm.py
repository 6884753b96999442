"""Operator 1: language-model scores from a log-frequency Bloom filter.

Training counts words and word pairs. Each count is quantised on a logarithmic
scale (``level``), and an n-gram goes into the filter once for every level up
to its own, so its count is read back by probing level 1, 2, ... until a probe
misses. Probabilities are smoothed from the counts c read back, that of a pair
clamped to the counts of its two words:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + MU p(w)) / (c(h) + F V + MU)

Every pair of the training texts is in the filter, those seen once too, so
with exact counts and no false hits (F = 0) the p(w | h) of a history add up to
1. Quantised counts are off by 4 % at most above EXACT. A filter has false
hits: F, the share of absent pairs that are found, some 3 in 100,000, follows
from how many bits each word of the filter has set (``false_hits``) and from how
many pairs of a bucket may have the same key. Over a vocabulary of V words a known history has F V of them, of count
1 nearly always, so that mass is taken out in the denominator, and the sums
stay near 1 at any V: what is left is chance, sqrt(F V) / (c(h) + F V + MU),
2.5 % of the sum at the worst V. MU is the best of a grid by the likelihood of
held-out texts (README). The add-one base score needs exact word counts; these
ride along as sorted arrays beside the filter.

The texts are read and tokenised once. Each task gathers documents into groups
and writes, for each group, the numbers of its words in order and, for each of
its *buckets* (ranges of the n-gram's hash, a fixed amount of text for each),
the group's distinct n-grams with their training counts. From these rows

* a bucket's counts are summed in one task, which writes the bucket's part of
  the filter to a file of the shared folder;
* buckets are joined into shards of ``SHARD_BYTES`` at most (one bucket where
  it alone is larger), and shard after shard is read into one buffer of the
  driver, broadcast, probed with those rows alone that belong to it, and
  destroyed;
* the levels found meet the group's word numbers again and give the scores.

So every n-gram is probed once whatever the number of shards, no task holds
more than a bucket, a shard and a group, and no frequent n-gram weighs more
than one entry for each group. The result does not depend on the number of
shards. Within a bucket a pair goes by KEY_BITS further bits of its hash: among
the million pairs or so of a bucket, one lookup in 60,000 meets another
pair's entry, at every size of the input, as buckets do not grow. Words go by
64 bits.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as empty text for the fold; equal rows have equal scores; with no
training rows every probability is 1 / 1; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import discard, fold_of, new_folder, open_fs, written

FOLDS, HELD_OUT = 7, 2
#: Pseudo-counts that the word distribution adds to each history.
MU = 400.0
#: Levels 1 to EXACT are counts; above, each level is RATIO times the one before.
EXACT, RATIO = 16, 1.08
TOP_LEVEL = 250
#: Bits of filter for each entry, and bits that an entry sets in each of two 64-bit words, so that a probe reads memory twice at most.
BITS, PROBES = 32, 7
#: Text bytes for each bucket, and tokens of a group.
BUCKET_BYTES, GROUP_TOKENS = 8_000_000, 1_400_000
#: What is broadcast at once, and read into the driver's buffer at once.
SHARD_BYTES, STRIP_BYTES = 32 << 20, 4 << 20
#: N-grams that are probed together.
PROBED = 500_000
#: Buckets whose rows share a folder.
STRIPE = 8
#: Bits of a pair's hash that it goes by within its bucket.
KEY_BITS = 36

WORD, PAIR = 1, 2
END = b"\n"  # no word has white space
#: Rows of a group: with bucket -1 its tokens, else the n-grams of one bucket.
GROUPED = "stripe int, bucket int, gid long, words binary, word_counts binary, pairs binary, pair_counts binary, ids array<long>, held array<boolean>, lengths array<long>"
ANSWER = "bucket int, gid long, counts binary, word_levels binary, pair_levels binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


# ---------------------------------------------------------------- tokens and hashes


def tokens(datas: list[bytes]):
    """Hashes of all tokens of some texts, each text followed by the end token, and the number of tokens of each."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    end, lengths, parts = np.array([xxh3_64_intdigest(END)], dtype=np.uint64), [], []
    for data in datas:
        words = data.lower().split()
        parts += [np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)), end]
        lengths.append(len(words) + 1)
    return np.concatenate(parts) if parts else end[:0], np.array(lengths, dtype=np.int64)


def mix(x):
    """splitmix64's finaliser."""
    import numpy as np

    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def before(of_words):
    """Of each token the one before it; a text's first follows the end token, which is also the last of all."""
    import numpy as np

    return np.concatenate([of_words[-1:], of_words[:-1]])


def pairs(words):
    """The key of each token with the token before it."""
    import numpy as np

    return mix(before(words) * np.uint64(0x9E3779B97F4A7C15) + words)


def bucket_cuts(keys, bucket_bits: int):
    """The buckets of sorted keys, by their top bits: where each begins, and the end."""
    import numpy as np

    of = keys >> np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(len(keys), dtype=np.uint64)
    return np.searchsorted(of, np.arange((1 << bucket_bits) + 1, dtype=np.uint64))


def rest_of(keys, bucket_bits: int):
    """The KEY_BITS bits after those that give a key's bucket; the order within a bucket stays."""
    import numpy as np

    return (keys << np.uint64(bucket_bits)) >> np.uint64(64 - KEY_BITS)


def _squeezed(array) -> bytes:
    """An array with its length, compressed byte plane by byte plane."""
    import numpy as np
    import pyarrow as pa

    planes = np.ascontiguousarray(array.view("u1").reshape(len(array), array.itemsize).T)
    return struct.pack("<q", len(array)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expanded(data: bytes, dtype: str):
    import numpy as np
    import pyarrow as pa

    (length,), dtype = struct.unpack_from("<q", data), np.dtype(dtype)
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], decompressed_size=length * dtype.itemsize, codec="zstd"), dtype="u1")
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, length).T).reshape(-1).view(dtype)


def _steps(keys) -> bytes:
    """Sorted keys by their differences, compressed."""
    import numpy as np

    return _squeezed(np.diff(keys.astype("<u8"), prepend=np.uint64(0)))


def _keys(data: bytes):
    """Keys from ``_steps``."""
    import numpy as np

    return np.cumsum(_expanded(data, "<u8"), dtype=np.uint64)


def item(kind: int, keys):
    """The hash that an n-gram goes by in its bucket's filter."""
    import numpy as np

    return mix(keys + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def places(items, levels, size):
    """Of (item, level): two words of a filter of so many (for all, or each its own), and the bits that the entry sets in the first; it sets them in the second too, turned."""
    import numpy as np

    g = mix(items ^ (levels.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    mask = np.uint64(1) << (g & np.uint64(63))
    for i in range(1, PROBES):
        mask |= np.uint64(1) << ((g >> np.uint64(6 * i)) & np.uint64(63))
    g, size = mix(g), np.asarray(size).astype(np.uint64)
    return ((g & np.uint64(0xFFFFFFFF)) % size).astype(np.int64), ((g >> np.uint64(32)) % size).astype(np.int64), mask


def turned(mask):
    import numpy as np

    return (mask << np.uint64(21)) | (mask >> np.uint64(43))


def hits(words, items, levels, start, size):
    """Which (item, level) pairs are in their filters, each of which has ``size`` of the words from ``start`` on."""
    first, second, mask = places(items, levels, size)
    found = (words[start + first] & mask) == mask
    if found.any():
        some = turned(mask[found])
        found[found] = (words[start[found] + second[found]] & some) == some
    return found


def level_of(n):
    """The levels of counts."""
    import numpy as np

    n = np.asarray(n, dtype=np.int64)
    high = EXACT + np.floor(np.log(np.maximum(n, 1) / EXACT) / math.log(RATIO) + 1e-9)
    return np.minimum(np.where(n <= EXACT, n, high), TOP_LEVEL).astype(np.int64)


def counts_of_levels():
    """The count that each level stands for; level 0 for none."""
    import numpy as np

    level = np.arange(TOP_LEVEL + 1)
    return np.where(level < EXACT, level, EXACT * RATIO ** (level - EXACT + 0.5))


def probe(words, items, start=0, size=None):
    """The level of each item by repeated membership probes of its bucket's filter; the few that go far, several levels at a time."""
    import numpy as np

    levels, live, level = np.zeros(len(items), dtype=np.uint8), np.arange(len(items)), 0
    start, size = np.broadcast_to(start, len(items)), np.broadcast_to(len(words) if size is None else size, len(items))
    while len(live) and level < TOP_LEVEL:
        some = min(32, TOP_LEVEL - level, max(1, 1024 // len(live)))
        each = lambda x: np.repeat(x, some)
        found = hits(words, each(items), np.tile(np.arange(level + 1, level + some + 1), len(items)), each(start), each(size)).reshape(-1, some)
        reached = np.where(found.all(axis=1), some, np.argmin(found, axis=1))
        levels[live] = level + reached
        on = reached == some
        live, items, start, size, level = live[on], items[on], start[on], size[on], level + some
    return levels


def built(found: list, bits: int = BITS):
    """The filter's words for (items, levels) of each kind, so many bits for each entry."""
    import numpy as np

    items, levels = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-levels, kind="stable")
    items, levels = items[order], levels[order]
    size = max(1, -(-int(levels.sum()) * bits // 64))
    out, level = np.zeros(size, dtype=np.uint64), 0
    while len(items):
        level += 1
        items = items[: np.searchsorted(-levels, -level, side="right")]  # those of this level or above
        for a in range(0, len(items), 1 << 18):
            some = items[a : a + (1 << 18)]
            first, second, mask = places(some, np.full(len(some), level), size)
            np.bitwise_or.at(out, first, mask)
            np.bitwise_or.at(out, second, turned(mask))
    return out


def false_hits(words) -> float:
    """The share of absent entries that a filter finds: the chance that the bits of an entry are set in both of its words."""
    import numpy as np

    sizes = np.bincount(np.bitwise_count(words), minlength=65)
    distinct = [1.0] + [0.0] * PROBES  # of PROBES drawn bits, how many differ
    for _ in range(PROBES):
        distinct = [distinct[d] * d / 64 + (distinct[d - 1] * (65 - d) / 64 if d else 0.0) for d in range(PROBES + 1)]
    held = [sum(int(n) * math.comb(k, d) for k, n in enumerate(sizes)) / math.comb(64, d) / max(1, len(words)) for d in range(PROBES + 1)]
    return math.fsum(p * x * x for p, x in zip(distinct, held, strict=True))


# ---------------------------------------------------------------- groups of documents


def _datas(column) -> list[bytes]:
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(docs: DataFrame, bucket_bits: int) -> DataFrame:
    """GROUPED rows of ``docs`` (doc_id, held_out, text), with 2 ** bucket_bits buckets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [("stripe", pa.int32()), ("bucket", pa.int32()), ("gid", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())]
            + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))]
        )
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            ids, out = [i for x in held for i in x[0]], [h for x in held for h in x[1]]
            words, lengths = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            held.clear()  # and what is done with goes below too: a group is most of what a worker holds
            train = np.repeat(~np.array(out, dtype=bool), lengths)
            counted = lambda back, n: np.bincount(back[train], minlength=n).astype("<u4")
            keys = pairs(words)
            one, back = np.unique(words, return_inverse=True)
            del words
            back, n1 = back.astype("<u4"), counted(back, len(one))
            two, back2 = np.unique(keys, return_inverse=True)
            del keys
            n2 = counted(back2, len(two))
            del back2
            row = {"stripe": [-1], "bucket": [-1], "gid": [number], "words": [_steps(one)], "word_counts": [_squeezed(back)], "pairs": [None], "pair_counts": [None], "ids": [ids], "held": [out], "lengths": [lengths]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)
            c1, c2 = bucket_cuts(one, bucket_bits), bucket_cuts(two, bucket_bits)
            two = rest_of(two, bucket_bits)
            for a in range(0, 1 << bucket_bits, 64):
                some = [k for k in range(a, min(1 << bucket_bits, a + 64)) if c1[k] < c1[k + 1] or c2[k] < c2[k + 1]]
                cut = lambda x, c: [x[c[k] : c[k + 1]] for k in some]
                row = {"stripe": [k // STRIPE for k in some], "bucket": some, "gid": [number] * len(some), "words": [_steps(x) for x in cut(one, c1)], "word_counts": [_squeezed(x) for x in cut(n1, c1)]}
                row |= {"pairs": [_steps(x) for x in cut(two, c2)], "pair_counts": [_squeezed(x) for x in cut(n2, c2)], "ids": [None] * len(some), "held": [None] * len(some), "lengths": [None] * len(some)}
                yield pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            ids, out, datas = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), _datas(batch.column("text"))
            for a in range(0, len(datas), 100):
                words, lengths = tokens(datas[a : a + 100])
                held.append((ids[a : a + 100], out[a : a + 100], words, lengths))
                size += len(words)
                if size >= GROUP_TOKENS:
                    yield from flush()
                    number, size = number + 1, 0
        if size:
            yield from flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, GROUPED)


# ---------------------------------------------------------------- training


@dataclass
class Model:
    """Where the buckets' files are; n and v: training tokens and distinct ones."""

    folder: str
    buckets: list[tuple[int, str, int, int]]  # bucket, file, 64-bit words of filter, distinct words
    n: int
    v: int
    false_hits: float = 0.0  # the share of absent n-grams that are found

    def shards(self, shard_bytes: int = SHARD_BYTES) -> list[list[tuple[int, str, int, int]]]:
        """The buckets in runs of ``shard_bytes`` at most."""
        out, size = [], 0
        for row in sorted(self.buckets):
            own = 8 * row[2] + 16 * row[3]
            if not out or size + own > shard_bytes:
                out.append([])
                size = 0
            out[-1].append(row)
            size += own
        return out

    def read(self, shard: list[tuple[int, str, int, int]]):
        """(the bytes of a shard, {bucket: (start, words of filter, distinct words)}): file by file, strip by strip, into one buffer."""
        import numpy as np

        fs, where = open_fs(self.folder)
        out, places, at = np.empty(sum(8 * b + 16 * w for _, _, b, w in shard), dtype=np.uint8), {}, 0
        for bucket, name, bits, words in shard:
            places[bucket] = (at, bits, words)
            end = at + 8 * bits + 16 * words
            with fs.open_input_stream(f"{where}/{name}") as f:
                while at < end:
                    strip = f.read(min(STRIP_BYTES, end - at))
                    if not strip:
                        raise OSError(f"{name} ends early")
                    out[at : at + len(strip)] = np.frombuffer(strip, dtype=np.uint8)
                    at += len(strip)
        return out, places


def parts(data, place):
    """(filter, sorted words, their counts) of a bucket in a shard's bytes."""
    at, bits, words = place
    cut = lambda n: data[at : at + 8 * n]
    one = cut(bits).view("<u8")
    at += 8 * bits
    two = cut(words).view("<u8")
    at += 8 * words
    return one, two, cut(words).view("<i8")


MANIFEST = "bucket int, name string, bits long, words long, n long, absent double"


def _summed(keys: list, counts: list):
    """Distinct keys with a count above 0, sorted, and their counts."""
    import numpy as np

    keys, counts = np.concatenate(keys), np.concatenate(counts)
    keys, counts = keys[counts > 0], counts[counts > 0].astype(np.int64)
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1])
    return keys[starts], np.add.reduceat(counts, starts)


def train(rows: DataFrame, bits: int = BITS) -> Model:
    """The model of the GROUPED ``rows``: each bucket's part is written by the task that sums its counts."""
    spark = rows.sparkSession
    folder = new_folder(spark, "lm-filter")

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        task, now, held = TaskContext.get().taskAttemptId(), None, []

        def close():
            w, n = _summed([_keys(x[0]) for x in held], [_expanded(x[1], "<u4") for x in held])
            p, m = _summed([_keys(x[2]) for x in held], [_expanded(x[3], "<u4") for x in held])
            words = built([(item(WORD, w), level_of(n)), (item(PAIR, p), level_of(m))], bits)
            name = f"bucket-{now:07d}-{task}.bin"
            with fs.open_output_stream(f"{where}/{name}") as f:
                for x in (words, w.astype("<u8"), n.astype("<i8")):
                    f.write(x.tobytes())
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "name": [name], "bits": [len(words)], "words": [len(w)], "n": [int(n.sum())], "absent": [false_hits(words) + len(p) / (1 << KEY_BITS)]})

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield close()

    keyed = rows.where("bucket >= 0").select("bucket", "words", "word_counts", "pairs", "pair_counts")
    manifest = written(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, MANIFEST), "lm-manifest").collect()  # one short row for each bucket
    rate = math.fsum(r.absent for r in manifest) / max(1, len(manifest))  # absent pairs go to all buckets alike
    return Model(folder, [(r.bucket, r.name, r.bits, r.words) for r in manifest], sum(r.n for r in manifest), sum(r.words for r in manifest), rate)


# ---------------------------------------------------------------- scoring


def answers(rows: DataFrame, model: Model, shard_bytes: int = SHARD_BYTES, spent: bool = False) -> DataFrame:
    """ANSWER rows: for the n-grams of each bucket of each group, the exact counts of its words and the levels of all.

    With ``spent``, a shard's files and the folders of its rows are deleted once it is done.
    """
    spark = rows.sparkSession
    path, gone = new_folder(spark, "lm-answers"), 0
    for shard in model.shards(shard_bytes):
        held = spark.sparkContext.broadcast(model.read(shard))

        def look_up(batches, held=held):
            import numpy as np
            import pyarrow as pa

            data, places = held.value
            filters = data.view("<u8")

            def found(kind, keys, buckets):
                """The levels of each row's keys: all rows are probed together."""
                lengths = np.array([len(x) for x in keys])
                of = np.array([places[b][:2] for b in buckets], dtype=np.int64).reshape(-1, 2)
                levels = probe(filters, item(kind, np.concatenate(keys)), np.repeat(of[:, 0] // 8, lengths), np.repeat(of[:, 1], lengths))
                return np.split(levels, np.cumsum(lengths)[:-1])

            def exact(one, bucket):
                _, known, counts = parts(data, places[bucket])
                if not len(known):
                    return np.zeros(len(one), dtype="<i8")
                at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                return np.where(known[at] == one, counts[at], 0)

            def answered(rows):
                buckets, gids, one, two = (list(c) for c in zip(*rows))
                out = {"bucket": pa.array(buckets, pa.int32()), "gid": pa.array(gids, pa.int64()), "counts": [_squeezed(exact(x, b)) for x, b in zip(one, buckets)]}
                return pa.RecordBatch.from_pydict(out | {"word_levels": list(map(_squeezed, found(WORD, one, buckets))), "pair_levels": list(map(_squeezed, found(PAIR, two, buckets)))})

            for batch in batches:
                rows, size = [], 0
                for bucket, gid, words, two in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    rows.append((bucket, gid, _keys(words), _keys(two)))
                    size += len(rows[-1][2]) + len(rows[-1][3])
                    if size >= PROBED:
                        yield answered(rows)
                        rows, size = [], 0
                if rows:
                    yield answered(rows)

        first, last = shard[0][0], shard[-1][0]
        own = rows.where(F.col("stripe").between(first // STRIPE, last // STRIPE) & F.col("bucket").between(first, last))
        own.select("bucket", "gid", "words", "pairs").mapInArrow(look_up, ANSWER).write.mode("append").parquet(path)
        held.destroy()  # its rows are written, so nothing reads this shard again
        if spent:
            whole = (last + 1) // STRIPE
            discard(*[f"{model.folder}/{name}" for _, name, _, _ in shard], *[f"{rows.written_at}/stripe={i}" for i in range(gone, whole)], spark=spark)
            gone = whole
    return spark.read.schema(ANSWER).parquet(path) if model.buckets else spark.createDataFrame([], ANSWER)


def combined(rows: DataFrame, found: DataFrame, model: Model, mu: float = MU) -> DataFrame:
    """SCORES of all documents, from the groups' tokens and what was found for their n-grams."""
    n, v, extra = model.n, model.v, model.v * model.false_hits

    def run(batches):
        import numpy as np
        import pyarrow as pa

        value = counts_of_levels()

        def scores(group, found):
            lengths, one, back = np.array(group["lengths"], dtype=np.int64), _keys(group["words"]), _expanded(group["word_counts"], "<u4")
            starts = np.cumsum(lengths) - lengths
            joined = lambda c, dtype: np.concatenate([_expanded(x[c], dtype) for x in found])  # noqa: E731  bucket by bucket is in the order of the keys
            back2 = np.unique(pairs(one[back]), return_inverse=True)[1]
            sums = lambda x: np.add.reduceat(x, starts)
            exact = joined("counts", "<i8")
            base, known = sums(np.log10(exact + 1.0)[back]) - lengths * math.log10(n + v + 1), sums((exact > 0).astype(np.int64)[back])
            word, pair = value[joined("word_levels", "u1")][back], value[joined("pair_levels", "u1")][back2]
            del back2, exact
            of_history = before(word)
            pair = np.minimum(pair, np.minimum(word, of_history))  # no pair is more frequent than its words
            p = np.minimum(1.0, (pair + mu * ((word + 1) / (n + v + 1))) / (of_history + np.where(of_history > 0, extra, 0.0) + mu))
            out = {"doc_id": pa.array(group["ids"], pa.int64()), "held_out": pa.array(group["held"], pa.bool_()), "n_tokens": lengths, "n_known": known, "base_score": base, "score": sums(np.log10(p))}
            return pa.RecordBatch.from_pydict(out)

        group, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] == -1:  # the first row of a group
                    if group:
                        yield scores(group, held)
                    group, held = row, []
                else:
                    held.append(row)
        if group:
            yield scores(group, held)

    own = rows.where("stripe = -1").select("bucket", "gid", "words", "word_counts", "ids", "held", "lengths")
    both = own.unionByName(found, allowMissingColumns=True)
    return both.repartition("gid").sortWithinPartitions("gid", "bucket").mapInArrow(run, SCORES).withColumn("train_tokens", F.lit(n).cast("long"))


def score(docs: DataFrame, *, mu: float = MU, bits: int = BITS, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """SCORES and train_tokens of ``docs`` (doc_id, held_out, text) by the model of those not held out."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = (size // bucket_bytes).bit_length()
    rows = written(grouped(docs, bucket_bits), "lm-groups", by=("stripe",))
    model = train(rows, bits)
    return combined(rows, answers(rows, model, shard_bytes, spent=True), model, mu)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return score(docs)
