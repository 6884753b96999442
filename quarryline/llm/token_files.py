"""Operator 3: token ids as flat binary files with 64-bit document offsets.

The documents are dealt out by ranges of their id, and each partition becomes
one shard, in ascending id order over all shards:

* ``shard-*.bin``: the ids of all its documents, little-endian unsigned 16-bit
  integers (32-bit where the vocabulary needs them), with nothing in between;
* ``shard-*.idx``: n + 1 little-endian unsigned 64-bit offsets, counted in ids
  over the whole corpus; the base of a shard is the prefix sum of the token
  counts of the shards before it;
* ``shard-*.doc``: the n document ids as little-endian signed 64-bit integers,
  then n bytes that are 1 where the id is null.

A file's name holds the attempt that wrote it, and only files named by the
written manifest count, so a lost executor or a second attempt leaves no trace
in the result. Reading maps the files into memory where the file system is
local (shared mounts too), and reads them otherwise.

White space never takes part in a token of the production vocabulary, and no
pre-token spans it, so a text's ids are those of its white-space-separated
chunks one after the other. The chunks of a batch are cut out and numbered by
Arrow, and each distinct one is looked up once: each worker keeps chunks in a
bounded cache of two generations (a full one becomes the old one, and what is
used again moves from the old one to the new, so frequent chunks stay). A
chunk in neither goes to the tokenizers library. Where it is of printable
ASCII and Latin-1 letters alone, what normalising and pre-tokenising do to it
is known: it is lower-cased and cut by ``PRE_TOKENS``, and the pieces go to the
library's model directly; any other chunk takes the library's whole way.
``whole_texts=True`` encodes every text in one call, for vocabularies without
that property.

Defined results: a null text is empty and has the end id alone; ids that tie
are ordered by text, and are dealt to several tasks where they differ in their
first TIE_CHARS characters; null ids come first; an empty table writes no files
and returns no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import new_folder, open_fs, releasing, written

END_ID = 1
#: Chunks in each of a worker's two cache generations, give or take one group's.
CACHE_WORDS = 250_000
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 4_000_000

#: Chunks whose normal form is known: printable ASCII and the letters of Latin-1, all composed already.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Marks that are one pre-token where they end such a chunk after a letter.
MARKS = ".,;:!?*$%&#|()\""
#: The vocabulary's pre-tokens of such a chunk, lower-cased.
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

#: Characters of a text that deal out rows of one id (or of none).
TIE_CHARS = 128

_encoders: dict[tuple, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


class ChunkEncoder:
    """Texts to ids, chunk by chunk through a cache."""

    def __init__(self, path: str, whole_texts: bool, cache_words: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = "<u2" if top < 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        rule = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
        before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.known = "Lowercase" in json.dumps(parts["normalizer"]) and before[:1] == [rule] and [x["type"] for x in before[1:]] == ["ByteLevel"] and all(x[:1] == "<" for x in special)
        self.letters = _byte_letters()
        self.whole_texts, self.cache_words = whole_texts, cache_words
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token, by the cache."""
        found = self.cache.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(word)]
                found = struct.pack(f"<{len(ids)}{self.code}", *ids)
            self.cache[piece] = found
        return found

    def _plain(self, chunk: str) -> bytes | None:
        """The ids of a chunk whose normal form is known, else None."""
        if not self.known or not (PLAIN.fullmatch(chunk)):
            return None
        low = chunk.lower()
        if low.isalpha():  # no special token is
            return self._piece(low)
        core = low.rstrip(MARKS)
        if core and core.isalpha():
            return self._piece(core) + self._piece(low[len(core) :])
        return None if self.special.search(low) else b"".join(map(self._piece, PRE_TOKENS.findall(low)))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        import numpy as np

        cache, hard = self.cache, []
        out = [*map(cache.get, chunks)]
        for i in [i for i, x in enumerate(out) if x is None]:
            chunk = chunks[i]
            found = self.old.get(chunk)
            if found is None:
                found = self._plain(chunk)
            if found is None:
                hard.append(i)
            else:
                out[i] = cache[chunk] = found
        for a in range(0, len(hard), 2000):
            some = hard[a : a + 2000]
            found = self.tokenizer.encode([chunks[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(found.ids, dtype=self.dtype), np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
            ends, at = np.searchsorted(of, np.arange(len(some)), side="right").tolist(), 0
            for i, end in zip(some, ends):
                cache[chunks[i]] = out[i] = ids[at:end].tobytes()
                at = end
        return out

    def encode(self, texts, end_id: int):
        """(the ids of all texts of the Arrow column one after the other, each with the end id; the number of ids of each)."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        if self.whole_texts:
            found = [np.array([*e.ids, end_id], dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(found), np.array(list(map(len, found)), dtype=np.int64)
        if len(self.cache) > self.cache_words:
            self.old, self.cache = self.cache, {}
        split = pc.ascii_split_whitespace(texts)
        numbered = pc.dictionary_encode(split.flatten())
        known = self._chunks(numbered.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        sizes = np.array([*map(len, known), width], dtype=np.int64) // width
        flat = np.frombuffer(b"".join(known) + np.array([end_id], dtype=self.dtype).tobytes(), dtype=self.dtype)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        order = np.insert(numbered.indices.to_numpy(zero_copy_only=False), ends, len(known))  # the end id is the last entry
        counts, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
        upto = np.cumsum(counts)
        ids = flat[np.repeat(first - upto + counts, counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def encoder(path: str, whole_texts: bool = False, cache_words: int = CACHE_WORDS) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary; its cache lives on between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, whole_texts, cache_words)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]


def _groups(texts):
    """Slices of the Arrow column with about GROUP_BYTES each."""
    import pyarrow.compute as pc

    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        size += length or 0
        if size >= GROUP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _shard_writer(folder: str, path: str, end_id: int, whole_texts: bool):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        fs, where = open_fs(folder)
        task, enc, out = TaskContext.get(), None, None
        ids, nulls, lengths = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                enc = encoder(path, whole_texts)
                name = f"shard-{task.partitionId():07d}-{task.taskAttemptId()}"
                fs.create_dir(where, recursive=True)
                out = fs.open_output_stream(f"{where}/{name}.bin")
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1"))
            for a, b in _groups(batch.column(1)):
                found, sizes = enc.encode(batch.column(1).slice(a, b - a), end_id)
                lengths.append(sizes)
                out.write(found.tobytes())
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{where}/{name}.doc") as f:
            f.write(np.concatenate(ids).tobytes())
            f.write(np.concatenate(nulls).tobytes())
        lengths = np.concatenate(lengths)
        with fs.open_output_stream(f"{where}/{name}.len") as f:
            f.write(lengths.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "name": [name], "dtype": [enc.dtype], "n_docs": [len(lengths)], "n_tokens": [int(lengths.sum())]},
            schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return write


MANIFEST = "shard int, name string, dtype string, n_docs long, n_tokens long"


def _index_writer(folder: str):
    def write(batches):
        import numpy as np
        import pyarrow as pa

        fs, where = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{where}/{row['name']}.len") as f:
                    lengths = np.frombuffer(f.read(), dtype="<i8")
                offsets = np.concatenate([[0], np.cumsum(lengths)]) + row["base"]
                with fs.open_output_stream(f"{where}/{row['name']}.idx") as f:
                    f.write(offsets.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema)

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col="doc_id", text_col="text", end_id=END_ID, whole_texts=False) -> DataFrame:
    """Write the files to ``folder``; returns the manifest: one row for each shard, with its base."""
    spark = docs.sparkSession
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id", F.left("text", F.lit(TIE_CHARS))).sortWithinPartitions("id", "text")
    shards = written(dealt.mapInArrow(releasing(_shard_writer(folder, tokenizer_path, end_id, whole_texts)), MANIFEST), "token-shards")
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    slots = max(1, spark.sparkContext.defaultParallelism)
    return written(based.repartition(4 * slots, "shard").mapInArrow(_index_writer(folder), MANIFEST + ", base long"), "token-manifest")


def mapped(fs, path: str, dtype: str):
    """The file as an array: memory-mapped if the file system is local, else read."""
    import numpy as np
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _reader(folder: str, with_ids: bool):
    def read(batches):
        import numpy as np
        import pyarrow as pa

        fs, where = open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets = mapped(fs, f"{where}/{row['name']}.bin", row["dtype"]), mapped(fs, f"{where}/{row['name']}.idx", "<u8").astype(np.int64)
                n = len(offsets) - 1
                keys = np.asarray(mapped(fs, f"{where}/{row['name']}.doc", "u1"))
                doc, null = keys[: 8 * n].view("<i8"), keys[8 * n :].astype(bool)
                for a in range(0, n, 1024):
                    b = min(n, a + 1024)
                    wide = np.asarray(ids[offsets[a] - row["base"] : offsets[b] - row["base"]]).astype("<u4")
                    cut = offsets[a : b + 1] - offsets[a]
                    out = {
                        "doc_id": pa.array(doc[a:b], mask=null[a:b]),
                        "start": pa.array(offsets[a:b]),
                        "n_tokens": pa.array(np.diff(cut)),
                        "ids_crc32": pa.array([zlib.crc32(wide[x:y]) for x, y in zip(cut[:-1], cut[1:])], type=pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(wide.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(out)

    return read


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, and the ids where asked for."""
    slots = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.repartition(4 * slots, "shard").mapInArrow(releasing(_reader(folder, with_ids)), schema)


def tokenize(docs: DataFrame, *, tokenizer_path: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write and read back in one go."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, **options), folder)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
