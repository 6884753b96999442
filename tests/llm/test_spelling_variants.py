"""Tiles by all pairs, the wavelet tree by plain search, hot prefixes halved, long chains of forms."""

import random
from itertools import combinations

import numpy as np
import pytest

from quarryline.llm import spelling_variants as variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_wavelet_tree_reports_every_point_of_a_rectangle():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        tree = variants.Wavelet(values)
        a, b = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        c, d = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        which, found = tree.report(a, b, c, d)
        want = [(k, v) for k in range(50) for v in values[a[k] : b[k]].tolist() if c[k] <= v < d[k]]
        assert sorted(zip(which.tolist(), found.tolist())) == sorted(want)


def test_tiles_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        size, letters = rng.randint(1, 6), "abé"[: rng.randint(1, 3)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([size, size + 1]))) for _ in range(rng.randint(1, 60))})
        want = sorted((a, b) for a, b in combinations(range(len(words)), 2) if near(words[a], words[b]) and min(len(words[a]), len(words[b])) == size)
        for cuts in ([(0, size)], [(0, size // 2), (size // 2 + 1, size)]):  # each pair once, however the positions are cut
            pairs = [variants.pairs_of_tile(words, size, *cut) for cut in cuts]
            assert sorted(tuple(sorted(p)) for i, j in pairs for p in zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("cells", [variants.CELLS, 60])
def test_near_words_against_all_pairs(spark, cells):
    """A third of the words share a prefix, a third a suffix; some are very long; small tiles halve them again and again."""
    rng = random.Random(4)
    words = {("common" if i % 3 == 0 else "") + "".join(rng.choice("abcé") for _ in range(rng.randint(2, 6))) + ("ending" if i % 3 == 1 else "letters") for i in range(150)}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "aaaaaaa", "aaaaaaaa", "é" * 9}
    n = {w: rng.choice([2, 5, 5, 300]) for w in sorted(words)}
    rows = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in variants.near_words(rows, cells=cells).collect()}
    want = {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        if others:
            want[w] = len(others), min(others, key=lambda v: (-n[v], v))
    assert got == want and len(want) > 20


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)]
    rows = spark.createDataFrame([*chain, ("a", "w3")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.roots(rows, 10**19).collect()}
    assert got == {w: "w18" for w, _ in [*chain, ("a", "")]}


def test_observed_words(spark):
    """One code point is deleted where 31 divides the hash; nulls count for nothing; only A-Z is lowered."""
    import zlib

    word = next(w for w in (f"worder{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop") if zlib.crc32(f"1:{w}".encode()) % 31 == 0)
    docs = spark.createDataFrame([(1, f"{word} {word}-{word.upper()} Éclairs Éclairs short"), (2, None), (None, "")], "doc_id long, text string")
    at = zlib.crc32(f"1:{word}".encode()) % len(word)
    got = {r["word"]: r["n"] for r in variants.observed_words(docs).collect()}
    assert got.get(word[:at] + word[at + 1 :]) == 3 and word not in got
    assert [n for w, n in got.items() if w.startswith("É")] == [2]
