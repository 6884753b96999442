"""The language model against a plain version of itself, over few and many shards."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarryline.llm import bloom_lm as lm
from quarryline.llm.shared import fold_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (fold_of(F.col("doc_id"), 7) == 2).alias("held_out"), "text")


def words(text):
    return [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")] + [None]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_shards_and_buckets_leave_the_result_alone(spark, monkeypatch):
    docs = documents(spark)
    one = by_id(lm.score(docs))
    many = by_id(lm.score(docs, shard_bytes=300_000, bucket_bytes=20_000))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert r["base_score"] == many[k]["base_score"] and r["n_known"] == many[k]["n_known"]
        assert math.isclose(r["score"], many[k]["score"], rel_tol=1e-4)  # false hits differ
    monkeypatch.setattr(lm, "GROUP_TOKENS", 1000)
    rows = lm.written(lm.grouped(docs, 4), "groups", by=("stripe",))
    model = lm.train(rows)
    assert len(model.shards(1 << 30)) == 1 and len(model.shards(1)) == len(model.buckets) == 16
    some = [by_id(lm.combined(rows, lm.answers(rows, model, size), model)) for size in (1 << 30, 400_000, 1)]
    assert some[0] == some[1] == some[2]


def test_score_is_the_stated_model(spark):
    value = lm.counts_of_levels()
    level = lambda n: value[int(lm.level_of(n))] if n else 0.0
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = by_id(lm.score(documents(spark)))
    seen = [words(t) for i, t in docs if not got[i]["held_out"]]
    one = Counter(w for t in seen for w in t)
    two = Counter(p for t in seen for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    exact, model = 0, lm.train(lm.written(lm.grouped(documents(spark), 0), "groups", by=("stripe",)))
    extra = model.v * model.false_hits
    for i, text in docs:
        t, want = words(text), 0.0
        for h, w in zip([None, *t], t):
            pair = min(level(two[h, w]), level(one[h]), level(one[w]))
            want += math.log10((pair + lm.MU * (level(one[w]) + 1) / (n + v + 1)) / (level(one[h]) + (extra if one[h] else 0) + lm.MU))
        exact += math.isclose(got[i]["score"], want, rel_tol=1e-9)
        assert abs(got[i]["score"] - want) < 0.01 * len(t)  # a false hit moves one count by one level
    assert exact >= 0.98 * len(docs)


def test_levels_keep_counts_within_four_percent():
    n = np.arange(1, 2_000_000, 7)
    off = lm.counts_of_levels()[lm.level_of(n)] / n
    assert (off[n < lm.EXACT] == 1).all() and 0.95 < off.min() and off.max() < 1.05


def test_false_hits():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 1_200_000, dtype=np.uint64)
    inside, outside = keys[:200_000], keys[200_000:]
    levels = lm.level_of(rng.geometric(0.5, len(inside)))
    filled = lm.built([(lm.item(lm.PAIR, inside), levels)])
    found = lm.probe(filled, lm.item(lm.PAIR, inside))
    assert (found >= levels).all() and (found == levels).mean() > 0.999
    absent = lm.probe(filled, lm.item(lm.PAIR, outside))
    assert (absent > 0).mean() < 1e-4, (absent > 0).mean()
    expected = lm.false_hits(filled) * len(outside)
    assert abs((absent > 0).sum() - expected) < 5 * expected**0.5, (expected, (absent > 0).sum())


def test_no_training_rows(spark):
    docs = documents(spark).withColumn("held_out", F.lit(True))
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in lm.score(docs).collect())


def sums_of_histories(docs, bits, chosen):
    """Over the whole vocabulary, the sum of p(w | h) for the histories that ``chosen`` takes from the words' counts."""
    rows = lm.written(lm.grouped(docs, bits), "groups", by=("stripe",))
    model = lm.train(rows)
    data, places = model.read(sorted(model.buckets))
    parts = {b: lm.parts(data, p) for b, p in places.items()}
    words = np.sort(np.concatenate([p[1] for p in parts.values()]))
    value = lm.counts_of_levels()

    def counts(kind, keys, names):
        of, out = keys >> np.uint64(64 - bits), np.zeros(len(keys))
        for b, (filled, _, _) in parts.items():
            at = np.nonzero(of == b)[0]
            out[at] = value[lm.probe(filled, lm.item(kind, names[at]))]
        return out

    of_word = counts(lm.WORD, words, words)
    p = (of_word + 1) / (model.n + model.v + 1)
    assert 0.97 < p.sum() < 1.03
    sums, extra = [], model.v * model.false_hits
    for i in chosen(of_word):
        keys = lm.pairs(np.stack([np.full_like(words, words[i]), words], axis=1).ravel())[1::2]
        pair = np.minimum(counts(lm.PAIR, keys, lm.rest_of(keys, bits)), np.minimum(of_word, of_word[i]))
        sums.append(float(((pair + lm.MU * p) / (of_word[i] + extra + lm.MU)).sum()))
    return np.array(sums)


def test_probabilities_of_a_history_add_up_to_nearly_one(spark):
    """False hits and quantised counts included."""
    sums = sums_of_histories(documents(spark), 3, lambda n: np.argsort(-n)[[0, 1, 2, 10, 50, 200, 500, 1000]])
    assert (abs(sums - 1) < 0.02).all(), sums


def test_sums_stay_near_one_over_a_large_vocabulary(spark):
    """Words seen once, of some 370,000: thirteen false hits each or so, taken out but for chance (1 % of the sum)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", (fold_of(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT).alias("held_out"), "text")
    sums = sums_of_histories(docs, 2, lambda n: np.random.default_rng(0).choice(np.nonzero(n == 1)[0], 30, replace=False))
    assert abs(sums.mean() - 1) < 0.01 and (abs(sums - 1) < 0.04).all(), sums
