"""The index against all pairs: forests, dense and large nodes, and the links of similar_documents."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarryline.llm import simhash

SF = "/root/testdata/sf0.001"


def components_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("words", [1, 3])
def test_forest_connects_what_all_links_connect(words):
    rng = np.random.default_rng(words)
    for kind in ("sparse", "dense", "both"):
        values = rng.integers(0, 1 << 63, (300, words), dtype=np.uint64)
        if kind != "sparse":  # balls of fingerprints around a few centres
            centres = values[:4] if kind == "dense" else values[:150]
            values = centres[rng.integers(0, len(centres), 300)]
            for _ in range(3 * words):
                values = values ^ (np.uint64(1) << rng.integers(0, 64, values.shape, dtype=np.uint64))
        values = np.unique(values, axis=0)
        values = values[np.argsort(simhash.gray_rank(values[:, 0]), kind="stable")]
        for bound in (4, 12 * words):
            a, b = simhash.forest(values, np.array([len(values)]), (bound // 2, bound))
            far = np.bitwise_count(values[a] ^ values[b]).sum(axis=1)
            assert (far <= bound).all() and len(a) < len(values)
            every = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2) <= bound
            assert components_of(len(values), zip(a.tolist(), b.tolist())) == components_of(len(values), np.argwhere(np.triu(every, 1)).tolist())


def test_many_nodes_lie_in_one_index():
    """Nodes of every size at once: the components of each are those of its own pairs."""
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(2, 12, 200), [70, 400, 2, 33]])
    parts = []
    for size in sizes:
        centres = rng.integers(0, 1 << 63, (max(1, size // 8), 1), dtype=np.uint64)
        part = centres[rng.integers(0, len(centres), size)]
        for _ in range(3):
            part = part ^ (np.uint64(1) << rng.integers(0, 64, part.shape, dtype=np.uint64))
        part = np.unique(part, axis=0)
        parts.append(part[np.argsort(simhash.gray_rank(part[:, 0]), kind="stable")])
    sizes, values = np.array([len(p) for p in parts]), np.concatenate(parts)
    a, b = simhash.forest(values, sizes, (4,))
    node = np.repeat(np.arange(len(sizes)), sizes)
    assert (node[a] == node[b]).all()
    every = (np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2) <= 4) & (node[:, None] == node[None])
    assert components_of(len(values), zip(a.tolist(), b.tolist())) == components_of(len(values), np.argwhere(np.triu(every, 1)).tolist())


def test_groups_are_pruned_by_their_differences():
    """Of all pairs of rows of a large node of scattered fingerprints few are compared one by one."""
    rng = np.random.default_rng(6)
    values = np.unique(rng.integers(0, 1 << 63, (4000, 1), dtype=np.uint64) & np.uint64(0xFFFF0FFF00FF000F), axis=0)
    values = values[np.argsort(simhash.gray_rank(values[:, 0]), kind="stable")]
    compared, near = [], simhash.near
    simhash.near = lambda x, y, masks, bits: (compared.append(len(x[0])) if masks is None else None, near(x, y, masks, bits))[1]
    try:
        simhash.forest(values, np.array([len(values)]), (2,))
    finally:
        simhash.near = near
    assert sum(compared) < len(values) ** 2 / 20, sum(compared)


def test_every_link_comes_from_the_index(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    values = simhash.fingerprints(docs).select("fp").distinct()
    assert simhash.links(values).count() > 0
    search = simhash.linked_pairs
    monkeypatch.setattr(simhash, "linked_pairs", lambda *_: iter(()))
    assert not list(simhash._searcher((4,), 1)(iter([pa.RecordBatch.from_pydict({"k": [0, 0], "v": [0, 0], "s": [0, 0], "w": [0, 0], "fp": [0, 1], "words": [b"", b""]})])))[0].num_rows
    monkeypatch.setattr(simhash, "linked_pairs", search)


def test_large_nodes_are_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "NODE_ROWS", 3)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    found = simhash.similar_documents(docs.select("text", "doc_id"), ("doc_id",)).collect()
    monkeypatch.undo()
    assert sorted(found) == sorted(simhash.similar_documents(docs.select("text", "doc_id"), ("doc_id",)).collect())


@pytest.fixture(scope="module")
def edited(tmp_path_factory):
    """Texts edited again and again, each a chain around the limit; a common passage; a short text in many copies."""
    where, rng = tmp_path_factory.mktemp("edited"), random.Random(7)
    passage, texts = " ".join(f"p{i}" for i in range(30)), [None, "", "a b c", "A b  c", "a b c d e"]
    for c in range(40):
        words = [f"c{c}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(8):
            texts.append(" ".join(words) + (f" {passage}" if c % 2 else ""))
            words = list(words)
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(docs), where / "documents.parquet")
    return f"{where}"


@pytest.mark.parametrize("which", ["table", "edited"])
def test_similar_documents_against_all_pairs(spark, edited, which):
    where = SF if which == "table" else edited
    rows = spark.read.parquet(f"{where}/documents.parquet").select("text", "doc_id")
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(rows, ("doc_id",)).collect()}
    ids, sets = [], []
    for r in rows.collect():
        words = (r["text"] or "").encode().lower().split()
        ids.append(r["doc_id"])
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    alike = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    want = components_of(len(sets), alike)
    met = [got[ids[i]] == got[ids[j]] for i, j in alike]
    assert all(m for m, (i, j) in zip(met, alike) if sets[i] == sets[j])
    assert sum(met) >= 0.9 * len(met), (sum(met), len(met))
    of = {}
    assert all(of.setdefault(got[i], w) == w for i, w in zip(ids, want))  # nothing is joined that links do not connect


def test_near_dedup_keeps_the_least_of_each_component(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()}
    found = simhash.similar_documents(docs.select("text", "doc_id"), ("doc_id",)).groupBy("component").agg(F.min("doc_id").alias("least"))
    assert kept == {r["least"] for r in found.collect()}


def five_word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


@pytest.fixture(scope="module")
def limit_texts():
    """Pairs of texts just at the limit or just below, of many lengths, most with a passage that many share; longer texts that hold a whole one."""
    rng = random.Random(11)
    passage, texts = " ".join(f"p{i}" for i in range(12)), []
    for c in range(600):
        n = rng.choice((8, 9, 12, 25, 60, 130))
        words = [f"c{c}w{i}" for i in range(n)]
        tail = f" {passage}" if c % 3 else ""
        texts.append(" ".join(words) + tail)
        if c % 2:  # words in the middle of the text, each changes five shingles
            size, changed = n - 4 + (12 if tail else 0), 0
            while 9 * (size - 5 * (changed + 1)) >= 4 * 2 * size:
                changed += 1
            for i in range(changed + (c % 5 == 0)):
                words[min(6 * i + 4, n - 1)] = f"e{c}x{i}"
            texts.append(" ".join(words) + tail)
        else:  # words before it
            texts.append(" ".join([f"b{c}x{i}" for i in range((n + 8 if tail else n - 4) // 4 + (c % 5 == 0))] + words) + tail)
    return [*texts, None, "", "a b", "A  b"]


@pytest.mark.parametrize("bits", [simhash.WIDE_BITS, 0])
def test_no_link_at_the_limit_is_lost(spark, limit_texts, monkeypatch, bits):
    """Components are those of all pairs, whatever the index finds before."""
    monkeypatch.setattr(simhash, "WIDE_BITS", bits)
    sets = five_word_sets(limit_texts)
    alike = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    docs = spark.createDataFrame(list(enumerate(limit_texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component"] for r in simhash.similar_documents(docs.select("text", "doc_id"), ("doc_id",)).collect()}
    least = {}
    for i in sorted(got):
        least.setdefault(got[i], i)
    assert len(alike) > 300 and [least[got[i]] for i in range(len(sets))] == components_of(len(sets), alike)


def test_shared_counts(spark):
    """Ids that two different sets have, copies counted once; the same for any number of buckets."""
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h z z", "k l m n o p q"] + [f"x{i} " * 3 + "a b c d e f g" for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = {r["key"]: r["first"] for r in simhash.set_rows(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int"), ("i",)).collect()}
    ids = {simhash._set_key(s): set(simhash._first_ids(s).tolist()) for s in simhash._hashed_sets(pa.array(texts))}
    assert rows == {k: len(v) for k, v in ids.items()}
    want = {k: sum(any(x in w for q, w in ids.items() if q != k) for x in v) for k, v in ids.items()}
    for buckets in (256, 1000):
        got = {r["key"]: r["shared"] for r in simhash.shared_counts(docs, buckets).collect()}
        assert got == {k: n for k, n in want.items() if n} and got


def test_what_all_sets_share_weighs_one_entry_for_a_group(spark, monkeypatch):
    """A passage in every text: small groups and large ones give the same counts, and copies in several tasks count once."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} own{i} " + " ".join(f"o{i}x{j}" for j in range(5)) for i in range(300)] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    want = sorted(map(tuple, simhash.shared_counts(docs, 256).collect()))
    monkeypatch.setattr(simhash, "DEALT_IDS", 60)
    assert sorted(map(tuple, simhash.shared_counts(docs, 300).collect())) == want and len(want) == 300 and len({n for _, n in want}) <= 3
