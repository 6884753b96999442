"""The chunk encoder against the library, over production texts and strings of all kinds of characters."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import token_files

SF = "/root/testdata/sf0.001"
ODD = "aAzZéÉßÿĀşİıſKΣσςﬁ①½²٣日本한é가 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​'’\"<|>,.!?;:#*$%&()[]{}+-=_/\\~^`@0123456789̱́̊ªºµ×÷😀\x00\x7f"
PIECES = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "it's", "WE'LL", "don't", "é", "H̱", "ÀÞ", "naïve,", "a1b22", "x***", "$$$", "'s", "''re"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check(encoder, library, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), 1)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(ODD, max_size=12), st.sampled_from(PIECES), st.text(max_size=5)), max_size=8).map("".join), min_size=1, max_size=5))
def test_any_text(path, library, texts):
    check(token_files.encoder(path), library, [t.encode("utf-8", "replace").decode() for t in texts])


def test_cache_turnover(path, library):
    texts = [None, "", *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    small = token_files.ChunkEncoder(path, False, 50)
    for a in range(0, len(texts), 7):
        check(small, library, texts[a : a + 7])
    assert small.old


def test_whole_texts(spark, path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda **o: sorted(map(tuple, token_files.tokenize(docs, **o).collect()))
    assert rows() == rows(whole_texts=True)


def test_files_hold_the_ids(spark, library):
    from quarryline.llm.shared import new_folder

    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), new_folder(spark, "tokens")
    import public_tokenizers

    manifest = token_files.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(manifest, folder, with_ids=True).collect()}
    assert got == {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
