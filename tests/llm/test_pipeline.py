"""The pipeline, stage by stage, against plain Python over a whole small table; each stage on what the one before kept."""

import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quarryline.llm import line_crf, mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of every stage, the documents first, each stage run on written rows of the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def ids(found):
    return Counter(d["doc_id"] for d in found)


def test_quality_classifier(spark, stages):
    model = line_crf.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    docs = rows(stages[0])
    scores = [float(line_crf.score_texts([(d["text"] or "").encode()], model)[0]) for d in docs]
    assert ids(rows(stages[1])) == ids(d for d, s in zip(docs, scores) if s >= 0.5) and min(scores) < 0.5


def test_near_dedup(stages):
    docs = rows(stages[1])
    sets = []
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    assert ids(rows(stages[2])) == Counter(least.values()) and len(least) < len(docs)


def test_decontamination(stages):
    word, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: tuple(word.findall((t or "").translate(lower)))
    windows = defaultdict(set)
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows[len(w[i : i + 10])].add(w[i : i + 10])
    docs = rows(stages[2])
    clean = [d for d in docs if not any(w[i : i + n] in some for w in [words(d["text"])] for n, some in windows.items() for i in range(len(w) - n + 1))]
    assert ids(rows(stages[3])) == ids(clean) and len(clean) < len(docs)


def test_source_mixing(stages):
    sized = [(r["id"], r["key"], r["h"], r["size"]) for r in mixing.sized(stages[3]).collect()]
    total = Counter()
    for _, key, _, size in sized:
        total[key] += size
    order = sorted(total, key=lambda k: (k.startswith("n"), k.encode("utf-32-be")))
    weight, full = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, set()
    while True:
        rest, left = sum(total.values()) - sum(3 * total[k] for k in full), [k for k in order if k not in full]
        target = {k: 3 * total[k] if k in full else rest * weight[k] / sum(weight[x] for x in left) for k in order}
        above = {k for k in left if target[k] > 3 * total[k]}
        if not above:
            break
        full |= above
    want = Counter()
    for key in order:
        own = sorted((h, i, s) for i, k, h, s in sized if k == key)
        whole, need = int(target[key] // total[key]), target[key] % total[key]
        for h, i, s in own:
            want[i] += whole + (1 if s and need >= s / 2 else 0)
            need = need - s if need >= s else 0
    got = ids(rows(stages[4]))
    assert got == +want and max(got.values()) <= 3


def test_token_output(spark, stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, want, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for d in sorted(rows(stages[4]), key=lambda d: (d["doc_id"], (d["text"] or "").encode())):
        found = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want.append((d["doc_id"], at, len(found), zlib.crc32(struct.pack(f"<{len(found)}I", *found))))
        at += len(found)
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r[k] for k in key) for r in rows(stages[5])) == sorted(want)
    assert sorted(tuple(r[k] for k in key) for r in rows(corpus_pipeline.run(spark, SF))) == sorted(want)


def test_a_null_id_stands_behind_all_others(spark):
    docs = spark.createDataFrame([(None, "one text of five words", "en", "s", 1), (7, "one text of five words", "en", "s", 1), (None, "another text of just five", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [("7", "one text of five words"), ("None", "another text of just five")]


def test_equal_ids_and_texts_keep_the_same_row_in_any_order(spark):
    found = [(7, "one text of five words", "en", s, 1) for s in ("b", "a", None)] + [(8, "", None, None, None), (9, None, "en", "b", 0)]
    kept = []
    for order in (found, found[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept.append(sorted(map(repr, corpus_pipeline.near_dedup(spark, docs, SF).collect())))
    assert kept[0] == kept[1] and len(kept[0]) == 2 and "source='a'" in kept[0][0]
