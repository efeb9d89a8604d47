"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from opinara.llm._common import encoding, map_arrow, table

#: Texts above this many characters are cut into parts of about this size.
PART_CHARS = 1 << 16
#: Between a letter and a blank every match of the split pattern ends: none of its
#: alternatives goes on from a letter into white space, and none looks back.
SAFE = re.compile(r"(?<=[A-Za-z])(?=[ \n])")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of ``size`` characters or a little more (whole where it has none)."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc) -> np.ndarray:
    """The ids of a whole text, as uint32."""
    ids = [enc.encode_to_numpy(x, disallowed_special=()) for x in parts(text)]
    return np.concatenate(ids).astype(np.uint32, copy=False) if len(ids) > 1 else ids[0]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each whole text's token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. One row per input row, repeated rows too; other
    columns are ignored. Narrow: no shuffle, a text is encoded where it is read.
    """

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode(x or "", enc).astype("<u4").tobytes() for x in b.column(1).to_pylist()]
            yield {"id": b.column(0), "ids": ids}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary): the raw bytes of each row's ids, whether or not they are valid UTF-8."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            yield {"id": b.column(0), "bytes": [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]}

    kind = dict(encoded.dtypes)[id_col]
    return map_arrow(encoded.select(id_col, "ids"), run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document n_tokens and the digests of its ids and of the bytes decoded from them, in one pass over the texts."""

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            n, ids, raw = [], [], []
            for x in b.column(1).to_pylist():
                a = encode(x or "", enc).astype("<u4", copy=False)
                n.append(len(a))
                ids.append(hashlib.sha256(a.tobytes()).hexdigest())
                raw.append(hashlib.sha256(enc.decode_bytes(a.tolist())).hexdigest())
            yield {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": raw}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
