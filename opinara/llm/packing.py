"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import deque
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from opinara.llm._common import map_arrow, table

WINDOW, TIERS, END_ID = 2048, (256, 512, 1024, 2048), 1
#: Tokens of a step group, a multiple of the largest tier: every group but a partition's last has exactly as many.
STEP_TOKENS = 16 * 2048
#: Entries of a cache generation; a Python worker keeps the newest and the one before it, so frequent ones stay.
CACHE_PIECES = 300_000
#: A text or word of these characters only is lower-cased and cut by PIECES as the tokenizer itself would: no
#: normal form changes them, and lower case is one character for one.
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
BLANK = re.compile("[\t-\r ]")
SLICE_CHARS = 1 << 19
#: Normalizer and pre-tokenizer of the tokenizers to which all of that applies; texts go whole to any other.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def slices(text: str):
    """A text's parts of about SLICE_CHARS characters, cut before ASCII white space."""
    start = 0
    while start < len(text):
        stop = BLANK.search(text, start + SLICE_CHARS)
        stop = stop.start() if stop else len(text)
        yield text[start:stop]
        start = stop


class Encoder:
    """The ids of whole texts as the tokenizers library gives them, special tokens in a text included.

    White space never lies inside a token of such a vocabulary (it is dropped), and each
    piece of the pre-tokenizer's pattern is encoded by itself. So a text's ids are those of
    its pieces, looked up in a cache; new pieces are encoded together, and every piece's
    last token is one that ends a word. Words of other characters are pieces of their own
    that go through the whole tokenizer; their keys are bytes.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.added = [x["content"] for x in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_pieces = all(spec[k] == v for k, v in STEPS.items()) and bool(suffix) and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        if self.by_pieces:
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.most, self.new, self.old = most, {}, {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_pieces(self, pieces: list[str]) -> list[bytes]:
        """Some thousand pieces at a time; one by one where a piece has not exactly one token that ends a word."""
        out = []
        for k in range(0, len(pieces), 4000):
            part = pieces[k : k + 4000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            edges = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(edges, edges[1:])] if len(edges) == len(part) + 1 and edges[-1] == len(raw) else self.encoded(part)
        return out

    def pieces(self, text: str) -> list:
        if not any(x in text for x in self.added):
            if PLAIN.fullmatch(text):
                return PIECES.findall(text.lower())
        found = []
        for word in text.encode().split():
            w = word.decode()
            if PLAIN.fullmatch(w) and not any(x in w for x in self.added):
                found += PIECES.findall(w.lower())
            else:
                found.append(word)
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Long texts are encoded in slices that end at white space, so that memory follows neither them nor their words."""
        if not self.by_pieces:
            return self.encoded([x or "" for x in texts])
        out = self.of_short([x if x and len(x) <= SLICE_CHARS else "" for x in texts])
        for i, x in enumerate(texts):
            if x and len(x) > SLICE_CHARS:
                out[i] = b"".join([self.of_short([y])[0] for y in slices(x)])
        return out

    def of_short(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(x) for x in texts]
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old, unseen = self.new, self.old, []
        for p in set(chain.from_iterable(cut)):
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    unseen.append(p)
        plain = [p for p in unseen if isinstance(p, str)]
        words = [p for p in unseen if isinstance(p, bytes)]
        new.update(zip(plain, self.encoded_pieces(plain)))
        new.update(zip(words, self.encoded([x.decode() for x in words])))
        return [b"".join([new[p] for p in ps]) for ps in cut]


_ENCODERS: dict[str, Encoder] = {}


def encode_words(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of whole texts; the encoder and its caches live as long as the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path](texts)


class Packer:
    """Packs one partition's documents, in order, holding under one window of each tier.

    A document's whole windows go out at once as sequences of their own; the rest is
    routed to the smallest tier that holds it. A tier packs when it has a window's worth:
    its own pieces first, and where the next does not fit, the gap is filled with pieces
    of shorter tiers, the longest first, and only then by cutting. What is left at the
    end fills whole windows across tiers, then windows of powers of two, so there is no padding.
    """

    def __init__(self, tiers=TIERS, step_tokens=STEP_TOKENS, partition=0):
        self.tiers, self.step_tokens, self.base = sorted(tiers), step_tokens, partition << 32
        self.waiting = [deque() for _ in self.tiers]
        self.tokens = [0] * len(self.tiers)
        self.sequences = self.steps = 0
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def emit(self, size: int, pieces: list[tuple]) -> None:
        """One sequence of ``size`` tokens; pieces: (doc_id, start, doc_tokens, ids). It goes out with its step group."""
        at, sequence = 0, []
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            sequence.append((doc, start, n, zlib.crc32(ids), total, self.base + self.sequences, at, size, ids))
            at += n
        self.sequences += 1
        group = self.open.setdefault(size, [])
        group.append(sequence)
        if len(group) * size == self.step_tokens:
            self.close(self.open.pop(size))

    def close(self, group: list[list[tuple]]) -> None:
        self.rows += [(*row[:-1], self.base + self.steps, row[-1]) for sequence in group for row in sequence]
        self.steps += 1

    def add(self, doc, ids: bytes) -> None:
        top, total, start = self.tiers[-1], len(ids) // 4, 0
        while total - start >= top:
            self.emit(top, [(doc, start, total, ids[4 * start : 4 * (start + top)])])
            start += top
        if rest := total - start:
            t = next(i for i, w in enumerate(self.tiers) if w >= rest)
            self.waiting[t].append((doc, start, total, ids[4 * start :]))
            self.tokens[t] += rest
            while self.tokens[t] >= self.tiers[t]:
                self.fill(self.tiers[t], t)

    def take(self, t: int, most: int) -> tuple:
        """The first piece waiting in tier t, cut to ``most`` tokens."""
        doc, start, total, ids = self.waiting[t].popleft()
        if len(ids) > 4 * most:
            self.waiting[t].appendleft((doc, start + most, total, ids[4 * most :]))
            ids = ids[: 4 * most]
        self.tokens[t] -= len(ids) // 4
        return doc, start, total, ids

    def fill(self, size: int, t: int) -> None:
        """One sequence of ``size`` tokens from tier t and the shorter ones."""
        pieces, room = [], size
        while room:
            fits = next((s for s in range(t, -1, -1) if self.waiting[s] and len(self.waiting[s][0][3]) <= 4 * room), None)
            s = fits if fits is not None else next(s for s in range(t, -1, -1) if self.waiting[s])
            pieces.append(self.take(s, room))
            room -= len(pieces[-1][3]) // 4
        self.emit(size, pieces)

    def finish(self) -> None:
        top = len(self.tiers) - 1
        while left := sum(self.tokens):
            self.fill(min(self.tiers[-1], 1 << (left.bit_length() - 1)), top)
        # each size divides the larger ones, so from large to small the open groups fill whole ones
        group, room = [], self.step_tokens
        for size in sorted(self.open, reverse=True):
            for sequence in self.open[size]:
                group.append(sequence)
                room -= size
                if not room:
                    self.close(group)
                    group, room = [], self.step_tokens
        if group:
            self.close(group)
        self.open = {}

    def drain(self) -> dict[str, list]:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids")
        out = dict(zip(names, map(list, zip(*self.rows)) if self.rows else [[] for _ in names]))
        self.rows = []
        return out


def pack(docs: DataFrame, path: str, tiers=TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group (and ids binary).

    A document is its text's ids and ``end_id``; a null or empty text is the end id alone.
    Tiers are powers of two; the largest is the window. Repeated rows are documents of
    their own. Each input partition is packed by itself while it is read, so there is no
    shuffle, memory holds one batch and under a window per tier, and a lost task is packed
    again alike. No key matters, so none is hot.
    """
    if any(w & (w - 1) for w in tiers) or step_tokens % max(tiers):
        raise ValueError("tiers are powers of two, and the largest divides step_tokens")
    kind = dict(docs.dtypes)[id_col]
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId())
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), encode_words(b.column(1).to_pylist(), path)):
                packer.add(doc, ids + end)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"
    return map_arrow(docs.select(id_col, text_col), run, schema + ", ids binary" * with_ids).withColumnRenamed("doc_id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
