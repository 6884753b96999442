"""Operator 9: SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has bit i set if more than half the XXH64 hashes of its
word shingles have it set. Distinct fingerprints are linked by the bits they
differ in, and a component is what links connect. Each distinct fingerprint
goes to one top node of the index for each block of its bits, as (block
number, block value): the block is the masked pattern that all below the node
share. Within a node the fingerprints are sorted by Gray rank, so that
neighbours share most bits, and a tree is laid over them: each upper node holds
the mask of the bits that all below it share, and their pattern. Group is held
against group from the root down, a group against itself first, and a pair of
groups goes as soon as the differences of their shared bits, added up word by
word, exceed the bound, or where all of both groups are linked up already; what
is left is compared bit by bit in leaves of ``LEAF`` rows. All nodes of a task,
of whatever size, lie in one such index and go down it together.

A node gives a spanning forest of its links (at most one row for each member),
never its pairs; the forests of all nodes connect what all links connect.
Components come from alternating large-star and small-star rounds over written
tables. Copies never meet: everything after the fingerprints works on distinct
ones, pre-aggregated. Tables that are joined on a key that may be hot are
written first, so that both sides are plain shuffles, which Spark splits where
they are skewed.

``near_duplicates`` is exact: 64 bits, repeats counted, links at ``max_bits``
differing bits or fewer. Cut into max_bits + 1 blocks, two linked fingerprints
agree on at least one whole block; nodes with more than ``NODE_ROWS``
fingerprints are cut again by the blocks of the remaining bits, which is exact
for the same reason.

``similar_documents`` links sets of word shingles by their Jaccard similarity,
0.8 or more, and loses no link. A set with more than a fifth of its shingles to
itself has none: that is counted over the ids in the lowest 3/10 of all hashes,
packed by buckets; ids that clash only leave more sets in. The sets that stay go
through the index. At 0.8, some 15 % of bits differ, too many for exact blocks,
so it finds most links, not all: its fingerprints, of distinct shingles, have
``WIDE_WORDS`` words, the blocks 12 bits (the last 4 of each word are in none), and a pair is a candidate where the
words together differ in ``WIDE_BITS`` or fewer. Forests grow by rising bounds,
so the closest candidates are kept, and each of their pairs is decided by the
whole sets. What that leaves apart is met by exact prefixes (``open_pairs``):
each pair of sets of different components that share a shingle among the rarest
of both, and may be similar by their sizes and places, is decided by the whole
sets too. Nodes with more than ``NODE_ROWS`` members are dealt out by pairs of
slices; the work in nodes grows with the square of their size, and so do the
pairs of a shingle that is among the rarest of many sets in different components.

Defined results: fewer words than a shingle make one shingle, no words (null
or empty text) the fingerprint zero, which links like any other in
``near_duplicates`` and to its copies alone in ``similar_documents``; ties and
repeated rows have equal rows; null ids never name a component unless it has
no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import discard, releasing, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: A node with more fingerprints is cut again.
NODE_ROWS = 20_000
#: Fingerprints in a leaf of the tree, and children of an upper node.
LEAF, FANOUT = 4, 4
#: Rows of the nodes that a task lays one index over, about, and pairs of groups that go down it at a time.
TREE_ROWS, PIECE = 1 << 16, 1 << 13
#: Linked pairs that are held until the closest of them are joined first.
HELD_PAIRS = 1 << 16
#: Of similar_documents: words of a shingle, words of a fingerprint, blocks of each, and differing bits of a candidate pair.
WIDE_SHINGLE, WIDE_WORDS, WIDE_BLOCKS, WIDE_BITS = 5, 6, 5, 76
#: The similarity that links, in fifths.
FIFTHS = 4
#: Words whose hashes a task keeps; 40-bit ids of shingles below this are counted over all sets; ids of a bucket, and ids that a task packs at a time.
KNOWN_WORDS, FIRST_IDS, BUCKET_IDS, DEALT_IDS = 200_000, 3 * (1 << 40) // 10, 250_000, 1 << 18


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(data: bytes, shingle: int, seed: int = SEED):
    """XXH64 of each word shingle of a UTF-8 text, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    last = ends[shingle - 1 :] or ends[-1:]
    starts = [0, *[e + 1 for e in ends[: len(last) - 1]]]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, last)), dtype="<u8", count=len(last))


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    hashes = shingle_hashes(data, shingle, seed)
    return majority(hashes) if len(hashes) else 0


def wide_fingerprint(hashes, words: int = WIDE_WORDS) -> list[int]:
    """The fingerprint of some distinct hashes: its first word by themselves, the others by hashes of them."""
    import numpy as np

    out = []
    for k in range(words):
        x = _mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else hashes
        out.append(majority(x) if len(x) else 0)
    return out


def _mixed(x):
    """64-bit integers, their bits mixed (SplitMix64's last steps)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes) -> int:
    """Bits that are set in more than half the hashes: bytes are counted by value, then values turn into bits."""
    import numpy as np

    m = len(hashes)
    counts = np.zeros((8, 256), dtype=np.int64)
    for a in range(0, m, 1 << 16):
        some = hashes[a : a + (1 << 16)].view("u1").reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
        counts += np.bincount(some.ravel(), minlength=2048).reshape(8, 256)
    ones = counts @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return int(sum(1 << i for i, x in enumerate((2 * ones > m).ravel().tolist()) if x))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=SHINGLE, seed=SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``extra``, fp: one narrow row for each document."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            values = [_signed(fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, seed)) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(values, type=pa.int64())], names=names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    names = ["doc_id", *extra, "fp"]
    return kept.mapInArrow(releasing(compute), kept.select("doc_id", *extra, F.lit(0).cast("long").alias("fp")).schema)


# ---------------------------------------------------------------- the index


def blocks_of(bits: list[int], parts: int) -> list[list[int]]:
    """The bit positions cut into ``parts`` blocks of nearly equal size."""
    base, more = divmod(len(bits), parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i < more)
        out.append(bits[at : at + n])
        at += n
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def gray_rank(values):
    """The position of each value in the reflected Gray order: the prefix XOR of its bits from the top."""
    import numpy as np

    out = values.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Trees:
    """The trees of many nodes over rows of words, sorted by (node, Gray rank): each level's groups, leaves first, lie within one node."""

    def __init__(self, values, sizes):
        """``sizes``: the rows of each node, in order."""
        import numpy as np

        self.values, self.levels, conj, disj, counts, step = values, [], values, values, sizes, LEAF
        while True:
            groups = -(-counts // step)
            within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
            cuts = np.repeat(np.cumsum(counts) - counts, groups) + step * within
            ends = np.concatenate([cuts[1:], [len(conj)]])
            conj, disj = np.bitwise_and.reduceat(conj, cuts), np.bitwise_or.reduceat(disj, cuts)
            self.levels.append((conj, ~(conj ^ disj), cuts, ends))  # a bit is shared if AND and OR agree on it
            if (groups == 1).all():
                return
            counts, step = groups, FANOUT

    def spans(self, labels):
        """The least and the greatest label of each group, by level."""
        import numpy as np

        out, low, high = [], labels, labels
        for _, _, cuts, _ in self.levels:
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append((low, high))
        return out


def near(x, y, masks, max_bits: int):
    """Which rows of words differ in max_bits places or fewer, in all or under the masks; word by word, while any is left."""
    import numpy as np

    left, sums = np.arange(len(x[0])), np.zeros(len(x[0]), dtype=np.int64)
    for k in range(x[1].shape[1]):
        i, j = x[0][left], y[0][left]
        differ = x[1][i, k] ^ y[1][j, k]
        if masks is not None:
            differ &= masks[i, k] & masks[j, k]
        sums[left] += np.bitwise_count(differ)
        left = left[sums[left] <= max_bits]
        if not len(left):
            break
    return left


def linked_pairs(trees: Trees, max_bits: int, labels):
    """Index pairs (i < j) of rows of one node at max_bits differing bits or fewer, in pieces.

    A group is held against itself before it is held against others. Pairs of
    rows or groups that lie in one and the same label are left out;
    ``labels()`` gives the labels as they are by then, and whether they changed.
    """
    import numpy as np

    now, spans = labels()[0], None
    top = len(trees.levels) - 1
    roots = np.arange(len(trees.levels[top][0]))
    stack = [(top, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PIECE:  # keeps every step within bounded memory
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:]), (depth, a[:half], b[:half])]
            continue
        now, changed = labels()
        if changed or spans is None:
            spans = trees.spans(now)
        low, high = spans[depth]
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        pattern, mask, first, end = trees.levels[depth]
        keep = near((a, pattern), (b, pattern), mask, max_bits)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        wide = end[b] - first[b]
        n = (end[a] - first[a]) * wide
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a][pair] + k // wide[pair], first[b][pair] + k % wide[pair]
        if depth:
            own = x == y
            stack += [(depth - 1, x[z], y[z]) for z in (x < y, own) if z.any()]
        else:
            z = (x < y) & (now[x] != now[y])
            x, y = x[z], y[z]
            found = near((x, trees.values), (y, trees.values), None, max_bits)
            if len(found):
                yield x[found], y[found]


def forest(values, sizes, bounds: tuple[int, ...]):
    """Spanning edges (index pairs) of the links within each node, of rows of words sorted by (node, Gray rank); the links of each bound come before those of the next."""
    import numpy as np

    n = len(values)
    labels, out_a, out_b, changed = np.arange(n), [], [], True

    def joined(x, y):
        """Add the edges x, y that a spanning forest needs, the closest first; labels stay the least index of each tree."""
        nonlocal labels, changed
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = up
            return i

        order = np.argsort(np.bitwise_count(values[x] ^ values[y]).sum(axis=1), kind="stable")
        x, y = x[order], y[order]
        u, v = labels[x], labels[y]
        _, first = np.unique(np.minimum(u, v) * n + np.maximum(u, v), return_index=True)
        for i in sorted(first.tolist()):
            p, q = find(int(u[i])), find(int(v[i]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out_a.append(int(x[i]))
                out_b.append(int(y[i]))
        if root:
            old = np.array(sorted(root))
            new = np.array([find(int(i)) for i in old])
            at = np.minimum(np.searchsorted(old, labels), len(old) - 1)
            labels, changed = np.where(old[at] == labels, new[at], labels), True

    def current():
        nonlocal changed
        was, changed = changed, False
        return labels, was

    trees = Trees(values, sizes)
    for max_bits in bounds:
        held, n_held = [], 0
        for pair in linked_pairs(trees, max_bits, current):
            held.append(pair)
            n_held += len(pair[0])
            if n_held >= HELD_PAIRS:
                joined(*map(np.concatenate, zip(*held)))
                held, n_held = [], 0
        if held:
            joined(*map(np.concatenate, zip(*held)))
    return np.array(out_a, dtype=np.int64), np.array(out_b, dtype=np.int64)


def _searcher(bounds: tuple[int, ...], words: int):
    """Rows (four columns that name a node, key, fingerprint words as bytes) in the order of their nodes to spanning edges a, b between keys."""

    def edges(nodes, keys, values):
        import numpy as np

        number = np.concatenate([[0], np.cumsum((nodes[1:] != nodes[:-1]).any(axis=1))])
        met = np.bincount(number)[number] > 1  # a node of one row has no link
        number, keys, values = number[met], keys[met], values[met]
        if not len(keys):
            return keys, keys
        order = np.lexsort((gray_rank(values[:, 0]), number))
        keys, values = keys[order], values[order]
        sizes = np.bincount(number)
        i, j = forest(values, sizes[sizes > 0], bounds)
        return keys[i], keys[j]

    def search(batches):
        import numpy as np
        import pyarrow as pa

        held, n = [], 0

        def close(last: bool):
            """Edges of all nodes that are complete; the others stay."""
            nonlocal held, n
            nodes, keys, values = (np.concatenate(x) for x in zip(*held))
            cut = len(keys) if last else int(np.nonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1]).any(axis=1)]))[0][-1])
            held, n = [(nodes[cut:], keys[cut:], values[cut:])], len(keys) - cut
            a, b = edges(nodes[:cut], keys[:cut], values[:cut]) if cut else (keys[:0], keys[:0])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                nodes = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
                keys = batch.column(4).to_numpy()
                values = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words) if words > 1 else keys.view(np.uint64).reshape(-1, 1)
                held.append((nodes, keys, values))
                n += len(keys)
                if n >= TREE_ROWS:
                    yield close(False)
        if held:
            yield close(True)

    return search


def _node_keys(distinct: DataFrame, max_bits: int) -> DataFrame:
    """node, fp: the top nodes of each distinct fingerprint; large nodes are cut by the blocks of their other bits."""
    every = list(range(63, -1, -1))
    tops = blocks_of(every, max_bits + 1)
    pattern = lambda bits: F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits))))
    keyed = distinct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pattern(bits).alias("v")) for k, bits in enumerate(tops)])).alias("top"), "fp").select("top.k", "top.v", "fp")
    large = written(keyed.groupBy("k", "v").count().where(F.col("count") > NODE_ROWS).select("k", "v", F.lit(True).alias("large")), "simhash-large")
    keyed = keyed.join(large, ["k", "v"], "left")
    cut = []
    for k, bits in enumerate(tops):
        rest = blocks_of([b for b in every if b not in bits], max_bits + 1)
        cut.append(F.when(F.col("k") == k, F.array(*[F.struct(F.lit(s).alias("s"), pattern(x).alias("w")) for s, x in enumerate(rest)])))
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w")))
    return keyed.select("k", "v", F.explode(F.when(F.col("large"), F.coalesce(*cut)).otherwise(whole)).alias("sub"), "fp").select("k", "v", "sub.s", "sub.w", "fp")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: spanning edges among the distinct fingerprints ``fp``; all links are connected by them."""
    nodes = _node_keys(distinct, max_bits).select("k", "v", "s", "w", "fp", F.lit(None).cast("binary").alias("words"))
    return nodes.repartition("k", "v", "s", "w").sortWithinPartitions("k", "v", "s", "w").mapInArrow(releasing(_searcher((max_bits,), 1)), "a long, b long")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """fp, root for every end of an edge: the smallest end of its component, by large-star and small-star rounds.

    No round gathers a vertex's neighbours: it takes their minimum by a
    pre-aggregated group and joins it back.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """The next pairs, written; ``pairs`` goes."""
        # large-star links each larger neighbour to the vertex's minimum; small-star the vertex and its smaller neighbours
        if larger:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components-least")
            out = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "components")
            discard(pairs, least)
            return out
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(down.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        joined = down.join(least, "a")
        out = written(joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct(), "components")
        discard(pairs, least)
        return out

    pairs = written(edges.where("a != b").distinct(), "components")
    state = None
    while True:
        pairs = star(star(pairs, True), False)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return pairs.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=SHINGLE, max_bits=MAX_BITS, seed=SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``extra``, fp, component (its smallest fingerprint), component_id for every document."""
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed, extra=extra), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits))
    rooted = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-named")
    table = written(rooted.join(named, "root").select("fp", F.col("root").alias("component"), "component_id"), "simhash-components")
    discard(classes, rooted, named)
    return rows.join(table, "fp").select("doc_id", *extra, "fp", "component", "component_id")


# ---------------------------------------------------------------- similar documents


def _hashed_sets(texts):
    """The sorted distinct shingle hashes of each text of an Arrow column: mixed sums of the XXH64 of their words, times a factor for each place."""
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    factors = np.array([xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(WIDE_SHINGLE)], dtype=np.uint64)

    def hashed(word: bytes) -> int:
        if (found := known.get(word)) is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            found = known[word] = xxh64_intdigest(word, SEED)
        return found

    for x in texts.cast(pa.binary()):
        words = x.as_buffer().to_pybytes().lower().split() if x.is_valid else []
        if not words:
            yield np.zeros(0, dtype="<u8")
            continue
        w = np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))
        size = min(WIDE_SHINGLE, len(w))
        n = len(w) - size + 1
        sums = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            sums += w[i : i + n] * factors[i]
        yield np.unique(_mixed(sums)).astype("<u8", copy=False)


def _set_key(found) -> int:
    """The 64-bit name of a set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0


def _first_ids(found):
    """The distinct 40-bit ids of a set's shingles, as far as they are below FIRST_IDS."""
    import numpy as np

    return np.unique(found[: np.searchsorted(found, np.uint64(FIRST_IDS << 24))] >> np.uint64(24))


def set_rows(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``names``, key (of the set of shingles), size (of the set), first (its ids below FIRST_IDS) of each document of ``docs`` (text, names)."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            keys, sizes, firsts = [], [], []
            for found in _hashed_sets(batch.column(0)):
                keys.append(_set_key(found))
                sizes.append(len(found))
                firsts.append(len(_first_ids(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, type=pa.int64()) for x in (keys, sizes, firsts)]], names=[*names, "key", "size", "first"])

    kept = docs.select("text", *names)
    zero = F.lit(0).cast("long")
    return kept.mapInArrow(releasing(compute), kept.select(*names, zero.alias("key"), zero.alias("size"), zero.alias("first")).schema)


def shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """key, shared: how many of a set's ids below FIRST_IDS another set of ``docs`` (text) has too; sets without one have no row.

    The ids go by buckets (id modulo ``buckets``, 256 at least, so that the
    quotient has 32 bits), packed. An id that several sets of a task's group
    have is counted there, and goes to its bucket once, as known to be shared;
    so what very many sets have weighs one entry for each group. A set is
    dealt once by each task, and each task's count of it is the whole one.
    """

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen, keys, ids, n = TaskContext.get().partitionId(), set(), [], [], 0

        def packed():
            owners, each = np.array(keys, dtype="<i8"), np.concatenate(ids)
            owner = np.repeat(np.arange(len(owners)), [len(x) for x in ids])
            found, back, times = np.unique(each, return_inverse=True, return_counts=True)
            alone = times[back] == 1
            counted = np.bincount(owner[~alone], minlength=len(owners))
            sent = np.concatenate([each[alone], found[times > 1]])  # what is known to be shared comes without a set
            of = np.concatenate([owners[owner[alone]], np.zeros(int((times > 1).sum()), dtype="<i8")])
            known = np.arange(len(sent)) >= int(alone.sum())
            bucket = sent % np.uint64(buckets)
            order = np.lexsort((known, bucket))
            bucket, of, known, rest = bucket[order], of[order], known[order], (sent[order] // np.uint64(buckets)).astype("<u4")
            starts = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
            ends = [s + int((~known[s:e]).sum()) for s, e in zip(starts[:-1], starts[1:])]  # those with a set come first
            own = np.nonzero(counted)[0]
            rows = [(int(bucket[s]), rest[s:m].tobytes(), of[s:m].tobytes(), rest[m:e].tobytes(), b"") for s, m, e in zip(starts[:-1], ends, starts[1:])]
            rows.append((task % buckets, b"", owners[own].tobytes(), b"", counted[own].astype("<i8").tobytes()))
            columns = [pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(rows), pa.int32())], names=["bucket", "ids", "keys", "known", "counts", "task"])

        for batch in batches:
            for found in _hashed_sets(batch.column(0)):
                if (key := _set_key(found)) in seen or not len(some := _first_ids(found)):
                    continue
                seen.add(key)
                keys.append(key)
                ids.append(some)
                n += len(some)
                if n >= DEALT_IDS:
                    yield packed()
                    keys, ids, n = [], [], 0
        if n:
            yield packed()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        now, held, found, n = None, [], [], 0

        def close():
            """The bucket's shared ids, by set and task."""
            joined = lambda i, kind: np.concatenate([np.frombuffer(x[i], dtype=kind) for x in held])
            ids, keys, known = joined(0, "<u4"), joined(1, "<i8"), np.unique(joined(2, "<u4"))
            tasks = np.repeat(np.array([x[3] for x in held], dtype=np.int32), [len(x[0]) // 4 for x in held])
            order = np.lexsort((keys, ids))
            ids, keys, tasks = ids[order], keys[order], tasks[order]
            starts = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, dtype=bool)
            group = np.cumsum(starts) - 1
            # of an id's entries, sorted by set, the first and the last differ where two sets have it
            first = np.nonzero(starts)[0]
            last = np.concatenate([first[1:] - 1, [len(ids) - 1]])[: len(first)]
            shared = (keys[first] != keys[last])[group] | np.isin(ids, known) if len(ids) else starts
            found.append((keys[shared], tasks[shared], np.ones(int(shared.sum()), dtype=np.int64)))
            return len(found[-1][0])

        def summed():
            """What was found so far, packed by the sets' own buckets."""
            keys, tasks, counts = (np.concatenate(x) for x in zip(*found))
            found.clear()
            keys, tasks, counts = _added(keys, tasks, counts)
            part = keys.astype(np.uint64) % np.uint64(buckets)
            order = np.argsort(part, kind="stable")
            part, keys, tasks, counts = part[order], keys[order], tasks[order], counts[order]
            starts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]]) if len(part) else np.zeros(1, dtype=np.int64)
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])], type=pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[starts[:-1]].astype(np.int64)), cut(keys), cut(tasks), cut(counts)], names=["part", "keys", "tasks", "counts"])

        for batch in batches:
            for bucket, ids, keys, known, counts, task in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    n += close()
                    held = []
                    if n >= DEALT_IDS:
                        yield summed()
                        n = 0
                now = bucket
                if counts:  # a task's own
                    own = np.frombuffer(keys, dtype="<i8")
                    found.append((own, np.full(len(own), task, dtype=np.int32), np.frombuffer(counts, dtype="<i8")))
                    n += len(own)
                else:
                    held.append((ids, keys, known, task))
        if held:
            close()
        if found:
            yield summed()

    def merged(batches):
        """Each set's count: the sum over its ids' buckets by task; the tasks that dealt it agree."""
        import numpy as np
        import pyarrow as pa

        def whole(held):
            keys, tasks, counts = (np.concatenate([np.frombuffer(x[i], dtype=kind) for x in held]) for i, kind in enumerate(("<i8", "<i4", "<i8")))
            keys, _, counts = _added(keys, tasks, counts)
            starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
            return pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int64()), pa.array(np.maximum.reduceat(counts, starts), pa.int64())], names=["key", "shared"])

        now, held = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield whole(held)
                    held = []
                now = part
                held.append(row)
        if held:
            yield whole(held)

    dealt = docs.select("text").mapInArrow(releasing(deal), "bucket long, ids binary, keys binary, known binary, counts binary, task int").repartition("bucket").sortWithinPartitions("bucket")
    counted = dealt.mapInArrow(releasing(count), "part long, keys binary, tasks binary, counts binary")
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(merged), "key long, shared long")


def _added(keys, tasks, counts):
    """The sums of the counts of equal (key, task), in that order."""
    import numpy as np

    order = np.lexsort((tasks, keys))
    keys, tasks, counts = keys[order], tasks[order], counts[order]
    if not len(keys):
        return keys, tasks, counts
    starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]) | (tasks[1:] != tasks[:-1]))[0] + 1])
    return keys[starts], tasks[starts], np.add.reduceat(counts, starts)


def hashed_sets(docs: DataFrame, one: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """key, size, items (the set), words (its wide fingerprint, big-endian) of the documents of ``docs`` (text, names) that ``one`` (names) names, each once."""

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = list(_hashed_sets(batch.column(0).slice(at, 256)))
                words = [b"".join(x.to_bytes(8, "big") for x in wide_fingerprint(x)) for x in found]
                columns = [pa.array([_set_key(x) for x in found], type=pa.int64()), pa.array([len(x) for x in found], type=pa.int64()), pa.array([x.view("<i8") for x in found], type=pa.list_(pa.int64())), pa.array(words, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "items", "words"])

    texts = docs.join(one, list(names), "left_semi").dropDuplicates(list(names)).select("text")
    return texts.mapInArrow(releasing(compute), "key long, size long, items array<long>, words binary")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b: keys of ``classes`` (key, words) whose wide fingerprints are near, as spanning forests of the index's nodes."""
    size = 64 // WIDE_BLOCKS
    word = lambda k: F.conv(F.hex(F.substring("words", 8 * k + 1, 8)), 16, -10).cast("long")
    blocks = F.flatten(F.array(*[F.array(*[F.struct(F.lit(k * WIDE_BLOCKS + b).alias("k"), F.shiftright(word(k), b * size).bitwiseAND(F.lit((1 << size) - 1)).alias("v")) for b in range(WIDE_BLOCKS)]) for k in range(WIDE_WORDS)]))
    keyed = classes.select(F.explode(blocks).alias("top"), "key", "words").select("top.k", "top.v", "key", "words")
    large = written(keyed.groupBy("k", "v").count().where(F.col("count") > NODE_ROWS).select("k", "v", F.ceil(F.col("count") / NODE_ROWS).alias("slices")), "simhash-large")
    own = F.pmod(F.xxhash64("key"), F.col("slices"))
    slices = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    dealt = keyed.join(large, ["k", "v"], "left").withColumn("other", F.explode(slices)).withColumn("own", F.coalesce(own, F.lit(0).cast("long")))
    nodes = dealt.select("k", "v", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("w"), "key", "words")
    bounds = tuple(WIDE_BITS * i // 4 for i in (1, 2, 3, 4))
    return nodes.repartition("k", "v", "s", "w").sortWithinPartitions("k", "v", "s", "w").mapInArrow(releasing(_searcher(bounds, WIDE_WORDS)), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b of keys whose whole sets have a similarity of FIFTHS / 5 or more."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("items").alias(f"set_{c}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = (5 + FIFTHS) * both >= FIFTHS * (F.size("set_a") + F.size("set_b"))  # both / (a + b - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")


def open_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: every pair of keys that may be similar and that ``roots`` (fp, root) does not join yet, by exact prefixes.

    In one order of all shingles, the rarest first, two similar sets have
    their first common shingle among the first size / 5 + 1 of each; from
    there on both must be long enough for what they have to share. Shingles
    of one set alone come first and meet nothing.
    """
    entries = sets.select("key", "size", F.explode("items").alias("item"))
    often = written(entries.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1"), "similar-often")
    common = entries.join(often, "item")
    own = Window.partitionBy("key")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "item"))  # from 1, those of this set alone before
    placed = common.select("key", "size", "item", place.alias("place")).where(f"5 * (place - 1) <= {5 - FIFTHS} * size")
    prefixes = written(placed.join(roots.withColumnRenamed("fp", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "similar-prefixes")
    mixed = written(prefixes.groupBy("item").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("item"), "similar-mixed")
    met = written(prefixes.join(mixed, "item", "left_semi"), "similar-met")
    discard(often, prefixes, mixed)
    a, b = (met.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "size", "place", "root")]) for x in "ab")
    left = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    may = (F.col("root_a") < F.col("root_b")) & ((5 + FIFTHS) * left >= FIFTHS * (F.col("size_a") + F.col("size_b")))
    may &= 5 * F.least("size_a", "size_b") >= FIFTHS * F.greatest("size_a", "size_b")
    pairs = written(a.join(b, "item").where(may).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct(), "similar-open")
    discard(met)
    return pairs


def similar_documents(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``names``, component for every document of ``docs`` (text, names); rows of equal names have equal texts. No name is key, size, first or one."""
    spark = docs.sparkSession
    rows = written(set_rows(docs, names), "similar-rows")
    classes = written(rows.groupBy("key").agg(F.min("size").alias("size"), F.min("first").alias("first"), F.min(F.struct(*names)).alias("one")).where("key != 0"), "similar-classes")
    ids = classes.agg(F.sum("first")).first()[0] or 0
    buckets = max(256, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")), ids // BUCKET_IDS)
    alone = F.col("first") - F.coalesce("shared", F.lit(0))
    one = written(classes.join(shared_counts(docs, buckets), "key", "left").where(5 * alone <= (5 - FIFTHS) * F.col("size")).select("one.*"), "similar-wanted")
    sets = written(hashed_sets(docs, one, names), "similar-sets")
    discard(classes, one)
    pairs = written(candidates(sets).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-pairs")
    found = written(components(verified(pairs, sets)), "similar-components")
    rest = open_pairs(sets, found)
    more = written(verified(rest, sets), "similar-links")
    discard(sets, pairs, rest)
    if not more.isEmpty():
        joined = written(components(found.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(more)), "similar-components")
        discard(found)
        found = joined
    discard(more)
    return rows.join(found.withColumnRenamed("fp", "key"), "key", "left").select(*names, F.coalesce("root", "key").alias("component"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
