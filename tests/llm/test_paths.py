"""Paths that small tables do not take by themselves, by lowered constants and built tables."""

import io
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import chat_format, decontaminate, quality_rules, warc
from quarryline.llm.shared import new_folder, open_fs, shared_dir, written

SF = "/root/testdata/sf0.001"


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- decontamination


def test_benchmark_in_pieces(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = collected(decontaminate.contamination(docs, items))
    windows = decontaminate.benchmark_windows(items).count()
    monkeypatch.setattr(decontaminate, "PIECE_ROWS", 1 + windows // 3)
    monkeypatch.setattr(decontaminate, "COUNTED_ROWS", 3)
    assert collected(decontaminate.contamination(docs, items)) == want and any(r[-1] for r in want)


def test_items_that_share_windows(spark):
    """Windows of one, some and all items in one document, at one place and at several."""
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(f"i{k}", f"{passage} own {k} " + " ".join(f"x{k}y{j}" for j in range(12))) for k in range(5)]
    docs = [(0, f"a b {passage} c {passage}"), (1, items[2][1]), (2, "nothing here"), (3, " ".join(t for _, t in items))]
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert [got[i]["n_items"] for i in range(4)] == [5, 5, 0, 5]
    assert [got[i]["n_hit"] for i in range(4)] == [28, 28, 0, 140]


# ---------------------------------------------------------------- quality rules


def limit(n, alpha, level):
    """The largest k with P(Bin(n, alpha) <= k) <= level, by a plain sum."""
    total, k = 0.0, -1
    for i in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha))
        if total > level:
            return k
        k = i
    return k


def test_limits_against_a_plain_sum(spark):
    cases = [(n, level) for n in (1, 50, 149, 150, 400, 2000, 9000, 40_000, 300_000) for level in (0.05, 0.05 / 12, 1e-4)]
    rows = spark.createDataFrame(cases, "n long, level double")
    got = {(r["n"], r["level"]): r["k"] for r in rows.withColumn("k", quality_rules.most_rejections(F.col("n"), quality_rules.ALPHA, F.col("level"))).collect()}
    assert got == {(n, level): limit(n, quality_rules.ALPHA, level) for n, level in cases}


def test_cutoffs_and_kept_against_plain_python(spark):
    """Enough labels for cutoffs: two strata whose bad texts stand out, one too small; some ids occur twice."""
    rng, docs, labels = random.Random(5), [], []
    for i in range(3000):
        lang, good = ("en", "fr", "de")[0 if i % 3 == 0 else 1 if i % 40 else 2], i % 4 != 0
        words = [f"w{rng.randrange(5000)}{'$' if rng.random() < (0.02 if good else 0.5) else ''}" for _ in range(rng.randrange(25, 60))]
        lines = [" ".join(words[j : j + 8]) for j in range(0, len(words), 8)]
        if not good and rng.random() < 0.5:
            lines += lines[:2]
        docs.append((i, "\n".join(lines), lang))
        if rng.random() < 0.9:
            labels.append((i, int(good)))
    docs += [docs[4], docs[5]]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels + labels[:9], "doc_id long, quality int")
    rows = quality_rules.measures(docs)
    measured = [r.asDict() for r in rows.collect()]
    rules = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
    value = lambda r, c: min(1000 * r[c] // max(r["n_words"], 1), quality_rules.TOP)
    failed = lambda r: r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {r["doc_id"]: r for r in measured if not failed(r) and r["doc_id"] in mark}
    strata = defaultdict(list)
    for i, r in held.items():
        strata[r["stratum"]].append((r, mark[i]))
    tests, want = sum(any(g for _, g in x) for x in strata.values()) * len(rules), {}
    for stratum, x in strata.items():
        n = sum(g for _, g in x)
        k = limit(n, quality_rules.ALPHA, quality_rules.DELTA / tests)
        for rule, c in rules.items():
            best = None
            for cut in {value(r, c) for r, _ in x}:
                good, bad = sum(g for r, g in x if value(r, c) > cut), sum(1 - g for r, g in x if value(r, c) > cut)
                gain = bad - quality_rules.GOOD_WEIGHT * good
                if good <= k and gain > 0:
                    best = max(best or (gain, cut), (gain, cut))
            if best:
                want[stratum, rule] = (best[1], n, k)
    got = {(r["stratum"], r["rule"]): (r["cutoff"], r["n"], r["k"]) for r in quality_rules.thresholds(rows, labels).collect()}
    assert got == want and {s for s, _ in got} == {"en", "fr"}
    kept = sorted((r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(docs, labels).collect())
    plain = lambda r: not failed(r) and not any(value(r, c) > want[r["stratum"], rule][0] for rule, c in rules.items() if (r["stratum"], rule) in want)
    assert kept == sorted((r["doc_id"], plain(r)) for r in measured)
    assert any(not k and not failed(r) for (_, k), r in zip(kept, sorted(measured, key=lambda r: r["doc_id"])))


def test_the_histogram_is_bounded(spark):
    """Texts of ever more marks have one value from TOP on; the strictest cutoff below it rejects them all."""
    words = " ".join(f"w{i}" for i in range(30))
    docs = [(i, words + "#" * (240 + 60 * i), "en") for i in range(400)] + [(1000 + i, words, "en") for i in range(400)]
    labels = [(i, int(i >= 1000)) for i, _, _ in docs]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality_rules.measures(docs)
    assert rows.select(quality_rules._rules()["symbols"].alias("v")).distinct().count() <= 3
    got = quality_rules.quality_rules(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] >= 1000) for r in got)


def test_cutoffs_hold_their_limit_on_real_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    found = quality_rules.thresholds(written(quality_rules.measures(labelled), "measures"), labels).collect()
    strata = len({r["stratum"] for r in found})
    assert found and all(r["k"] <= limit(r["n"], quality_rules.ALPHA, quality_rules.DELTA / 3 / strata) for r in found)


# ---------------------------------------------------------------- archives


def test_several_archives_and_min_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 5)
    pages = [(i, f"http://h/{i}", "same" if i % 2 else f"page {i} " * 3) for i in range(30)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    for least, kinds in ((0, {"revisit": 14, "response": 16}), (5, {"response": 30})):
        folder = new_folder(spark, "warc")
        records = warc.write_archives(rows, folder)
        assert records.select("file").distinct().count() == 6
        back = warc.read_archives(warc.normalise(records, folder, min_bytes=least), folder).collect()
        counts = defaultdict(int)
        for r in back:
            counts[r["record_type"]] += 1
            assert r["refers_to"] == (29 if r["record_type"] == "revisit" else None)
        assert counts == kinds and sorted(r["page_id"] for r in back) == list(range(30))


def test_streams_of_several_chunks_and_members(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 64)
    blocks = [b"x" * n for n in (0, 1, 63, 64, 65, 5000)]
    record = lambda b: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n"
    one = zlib.compressobj(6, wbits=31)
    whole = one.compress(b"".join(map(record, blocks))) + one.flush()
    members = b"".join((z := zlib.compressobj(6, wbits=31)).compress(record(b)) + z.flush() for b in blocks)
    for data in (whole, members):
        assert [b for _, b in warc.records(io.BytesIO(data))] == blocks
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(whole[: len(whole) // 2])))


def test_a_cut_stream_is_an_error_wherever_it_ends(monkeypatch):
    """At every byte, and after every record where the writer flushed."""
    monkeypatch.setattr(warc, "CHUNK", 100)
    zipper, whole, ends = zlib.compressobj(6, wbits=31), b"", []
    for n in range(3):
        block = f"block {n} ".encode() * 20
        whole += zipper.compress(f"WARC/1.1\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + zipper.flush(zlib.Z_SYNC_FLUSH)
        ends.append(len(whole))
    whole += zipper.flush()
    assert len(list(warc.records(io.BytesIO(whole)))) == 3 and not list(warc.records(io.BytesIO(b"")))
    for n in [*range(1, len(whole)), *ends]:
        with pytest.raises(EOFError):
            list(warc.records(io.BytesIO(whole[:n])))


def test_an_archive_without_all_its_records_is_an_error(spark):
    folder = new_folder(spark, "warc")
    rows = warc.write_archives(spark.createDataFrame([(1, None, "a"), (2, None, "b")], "page_id long, url string, html string").coalesce(1), folder)
    fs, where = open_fs(folder)
    file = f"{where}/{rows.first()['file']}.warc.gz"
    with fs.open_input_stream(file, compression=None) as f:
        first = next(iter(warc.records(f)))
    zipper = zlib.compressobj(6, wbits=31)
    with fs.open_output_stream(file, compression=None) as f:
        f.write(zipper.compress(warc._header(first[0]) + first[1] + b"\r\n\r\n") + zipper.flush())
    with pytest.raises(Exception, match="1 of 2 records"):
        warc.normalise(rows, folder).collect()


def test_a_damaged_payload_is_an_error(spark):
    folder = new_folder(spark, "warc")
    rows = warc.write_archives(spark.createDataFrame([(1, None, "a payload")], "page_id long, url string, html string"), folder)
    manifest = warc.normalise(rows, folder)
    fs, where = open_fs(folder)
    file = f"{where}/{manifest.first()['file']}.warc.gz"
    data = zlib.decompress(open(file, "rb").read(), wbits=31).replace(b"a payload", b"A payload")
    z = zlib.compressobj(6, wbits=31)
    member = z.compress(data) + z.flush()
    open(file, "wb").write(member)
    index = file.removesuffix(".warc.gz") + ".idx"
    import json

    entry = json.loads(open(index).read())
    open(index, "w").write(json.dumps({**entry, "length": len(member)}) + "\n")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(manifest, folder).collect()


# ---------------------------------------------------------------- conversations


def test_own_conversation_minus_one_and_rows_without_one(spark):
    rows = [(-1, 0, "user", "hi"), (-1, 1, "assistant", "<yo>"), (None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    table = chat_format.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat_format.read_back(chat_format.format_conversations(table, apart=("probe",)))
    got = sorted(((r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]], r["loss_text"], r["valid"]) for r in found.collect()), key=repr)
    said = chat_format.PROBE
    assert got == sorted(
        [(-1, [("user", "hi"), ("assistant", "<yo>")], "<yo>", True), (-1, [("user", said), ("assistant", said)], said, True), (None, [("user", "a")], "", False), (None, [("user", "a")], "", False), (None, [("assistant", "b")], "b", False)], key=repr
    )


def test_loss_is_read_from_the_written_text(spark):
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "answer ~ <x>")], "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(table)
    changed = formatted.select("conv_id", F.replace("formatted", F.lit("answer"), F.lit("ANSWER")).alias("formatted"), "mask")
    assert chat_format.read_back(changed).first()["loss_text"] == "ANSWER ~ <x>"
    assert formatted.first()["segments"][1]["text"] == "q"


# ---------------------------------------------------------------- the shared folder


def test_a_cluster_needs_the_shared_folder():
    class Conf:
        def get(self, key, default):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


