"""Token counts attributed to the sections of a document by the character spans of its tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from opinara.llm._common import encoding, map_arrow, table
from opinara.llm.byte_bpe import encode

RULES = ("start", "majority", "split")


def token_spans(text: str, enc, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each token: byte-level tokens tile the text, so lengths add up to offsets."""
    ends = np.cumsum(sizes[encode(text, enc)], dtype=np.int64)
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends


def token_sizes(enc) -> np.ndarray:
    sizes = np.zeros(enc.max_token_value + 1, np.int64)
    for rank, token in enumerate(enc.token_byte_values()):
        sizes[enc.encode_single_token(token)] = len(token)
    return sizes


def byte_of_char(raw: np.ndarray) -> np.ndarray:
    """Byte offset of each character, and of the end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def line_spans(text: str) -> list[int]:
    """Starts of the lines; a line keeps its newline, so the lines tile the text. An empty text is one empty line."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def allocate(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and tokens crossing out of it, for sections [edges[i], edges[i+1]) of bytes.

    ``start``: a token belongs to the section of its first byte. ``majority``: to the
    section with most of its bytes, the earlier one on a tie. ``split``: to each
    section in proportion to its bytes. Under every rule the counts add up to the
    document's tokens.
    """
    n = len(edges) - 1
    first = np.clip(np.searchsorted(edges, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(edges, ends - 1, "right") - 1, 0, n - 1)
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "start" or not (first != last).any():
        return np.bincount(first, minlength=n).astype(float), crossing
    whole = np.bincount(first[first == last], minlength=n).astype(float)
    for k in np.flatnonzero(first != last):
        i, j = first[k], last[k]
        inside = np.minimum(edges[i + 1 : j + 2], ends[k]) - np.maximum(edges[i : j + 1], starts[k])
        if rule == "majority":
            whole[i + int(np.argmax(inside))] += 1
        else:
            whole[i : j + 1] += inside / (ends[k] - starts[k])
    return whole, crossing


def section_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "majority", spans_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, char_start, char_end, n_tokens double, n_crossing): tokens of each section of each document.

    A document is encoded once and whole; its tokens are joined to its sections by
    interval. Sections are the lines of the text, or the ascending start characters in
    the array column ``spans_col`` (the first section begins at 0; starts outside the
    text are dropped; a null array is one section). A null or empty text is one empty
    section with no tokens. One set of rows per input row, repeated rows too. Narrow.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kind = dict(docs.dtypes)[id_col]
    columns = [id_col, text_col, *([spans_col] if spans_col else [])]

    def run(batches):
        enc = encoding(path, pattern)
        sizes = token_sizes(enc)
        for b in batches:
            out = {k: [] for k in ("id", "section", "char_start", "char_end", "n_tokens", "n_crossing")}
            given = b.column(2).to_pylist() if spans_col else None
            for r, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = text or ""
                at = byte_of_char(np.frombuffer(text.encode(), np.uint8))
                if given is None:
                    lines = np.array(line_spans(text))
                else:
                    lines = np.unique([0, *(x for x in given[r] or () if x is not None and 0 < x < len(text))])
                edges = np.append(lines, len(text))
                counts, crossing = allocate(*token_spans(text, enc, sizes), at[edges], rule)
                out["id"] += [key] * len(lines)
                out["section"] += range(len(lines))
                out["char_start"] += edges[:-1].tolist()
                out["char_end"] += edges[1:].tolist()
                out["n_tokens"] += counts.tolist()
                out["n_crossing"] += crossing.tolist()
            yield out

    made = map_arrow(docs.select(*columns), run, f"id {kind}, section int, char_start long, char_end long, n_tokens double, n_crossing long")
    return made.withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = section_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return counts.withColumn("n_tokens", counts.n_tokens.cast("long"))
