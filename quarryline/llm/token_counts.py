"""Operator 8: token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as a whole. Every token of a byte-level vocabulary
covers a known number of bytes, so the running sum of token lengths gives the
span of each token; sections are spans of the same text. The two lists of
spans, both in order, are joined by interval, and each token goes to one
section:

* a token within one section belongs to it;
* a token that crosses a boundary goes to the section with most of its
  characters, to the earlier one on a tie.

A character belongs to the token that holds its first byte (a token may hold
part of a character), so a token may have no character of its own; such a
token goes to the section of the character that it continues. The counts of
the sections therefore sum to the whole text's number of tokens, which
encoding each section by itself does not give.

The sections of the production query: ``head`` is the first line with its line
break, ``tail`` the last line if there is more than one, ``body`` what lies
between. ``sections`` takes any other rule that cuts a text into spans.

Defined results: a null or empty text has no tokens and no sections; equal
rows have equal counts; very long texts are encoded whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("head", "body", "tail")

_encodings: dict[str, tuple] = {}


def encoding(path: str):
    """(encoding, length in bytes of each id) of a rank file; one for each worker process."""
    if path not in _encodings:
        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        widths[list(ranks.values())] = [len(x) for x in ranks]
        _encodings[path] = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths)
    return _encodings[path]


def head_body_tail(data: bytes) -> list[tuple[str, int, int]]:
    """(field, first byte, end) in order; empty spans are left out."""
    first = data.find(b"\n") + 1 or len(data)
    last = max(first, data.rfind(b"\n") + 1)
    return [(name, a, b) for name, a, b in (("head", 0, first), ("body", first, last), ("tail", last, len(data))) if b > a]


def attribute(ends, char_starts, section_ends):
    """The section of each token.

    ends: the running sum of token widths in bytes; char_starts: the byte at
    which each character starts; section_ends: the byte at which each section
    ends, in order, the last at the text's end. A token meets the sections
    from that of its first character to that of its last one; the widest
    overlap in characters wins, the earliest of equals.
    """
    import numpy as np

    begins = np.concatenate([[0], ends[:-1]])
    a, b = np.searchsorted(char_starts, begins), np.searchsorted(char_starts, ends)  # its characters: a to b
    a, none = np.where(a == b, a - 1, a), a == b
    b = np.where(none, a + 1, b)
    char_ends = np.searchsorted(char_starts, section_ends)
    low, high = np.searchsorted(char_ends, a, side="right"), np.searchsorted(char_ends, b - 1, side="right")
    out = low.copy()
    for t in np.nonzero(low != high)[0].tolist():
        edges = np.minimum(char_ends[low[t] : high[t] + 1], b[t])
        out[t] = low[t] + int(np.argmax(np.diff(np.concatenate([[a[t]], edges]))))
    return out, int((low != high).sum())


def token_counts(docs: DataFrame, *, id_col="doc_id", text_col="text", ranks_path: str | None = None, sections: Callable[[bytes], list[tuple[str, int, int]]] = head_body_tail, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, n_tokens, n_chars, n_crossing, and for each field its tokens and characters."""
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches):
        import numpy as np
        import pyarrow as pa

        enc, widths = encoding(ranks_path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                data = text.encode("utf-8", "replace")
                ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
                spans, crossing = sections(data), 0
                tokens, chars = dict.fromkeys(fields, 0), dict.fromkeys(fields, 0)
                if len(ids):
                    raw = np.frombuffer(data, dtype=np.uint8)
                    starts = np.nonzero((raw & 0xC0) != 0x80)[0]
                    section_ends = np.array([s[2] for s in spans])
                    of, crossing = attribute(np.cumsum(widths[ids]), starts, section_ends)
                    each = np.bincount(of, minlength=len(spans)).tolist()
                    sizes = np.diff(np.concatenate([[0], np.searchsorted(starts, section_ends)])).tolist()
                    for (name, _, _), n, m in zip(spans, each, sizes):
                        tokens[name] += n
                        chars[name] += m
                rows.append((len(ids), len(text), crossing, *tokens.values(), *chars.values()))
            columns = [pa.array(c, type=pa.int64()) for c in zip(*rows)] if rows else [pa.array([], type=pa.int64())] * (3 + 2 * len(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["doc_id", "n_tokens", "n_chars", "n_crossing", *[f"{x}_tokens" for x in fields], *[f"{x}_chars" for x in fields]]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(count, ", ".join(f"{n} long" for n in names))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
