"""Phrases against a count by hand."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from opinara.llm import collocations


def brute(rows, longest, least, top, percent=80, scale=1_000_000):
    words, total = Counter(), Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in (("und" if x is None else x, t) for x, t in rows):
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            ws = re.findall(r"[^ \t]+", piece)
            total[lang] += len(ws)
            words.update((lang, tuple(ws[i : i + n])) for n in range(1, longest + 1) for i in range(len(ws) - n + 1))
    good = {k: n for k, n in words.items() if n >= least and len(k[1]) > 1}
    held = Counter()
    for (lang, p), n in good.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                held[lang, p[i : i + m]] = max(held[lang, p[i : i + m]], n)
    out = []
    for (lang, p), a in good.items():
        if held[lang, p] * 100 >= percent * a and held[lang, p]:
            continue
        score, _, left, right = min((2 * scale * a // (words[lang, p[:k]] + words[lang, p[k:]]), k, words[lang, p[:k]], words[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


def result(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def rows(seed=3):
    r = random.Random(seed)
    some = ["New", "york", "CITY", "of", "the", "é", "x y", "a-b", "\x01", "日本"]
    texts = [(r.choice(["en", "de", "und", None, ""]), "".join(r.choice(some) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(r.choice((0, 1, 5, 60))))) for _ in range(120)]
    texts += [("en", "in the city hall of new york. " * 40), ("en", "A a a a a"), ("en", None), ("de", " \t\n"), (None, "the city hall")] + [("fr", "le chat noir")] * 12
    return texts


def test_by_hand(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 700)
    df = spark.createDataFrame(rows(), "lang string, text string").withColumns({c: F.lit(1) for c in ("path", "n", "phrase", "h", "ws")}).repartition(3)
    for longest, least, top in ((4, 5, 2000), (2, 3, 10), (5, 8, None)):
        want = brute(rows(), longest, least, 10**9 if top is None else top)
        assert want and result(collocations.collocations(df, longest, least, top)) == want
    assert collocations.collocations(df.limit(0)).count() == 0


def test_filter_only_chooses(spark):
    """A filter of 8192 bits lets many rare paths through; the result stays."""
    df = spark.createDataFrame(rows(5), "lang string, text string")
    assert result(collocations.collocations(df, 4, 6, 50, bits=15)) == brute(rows(5), 4, 6, 50)


def test_filter_bits(spark):
    h = np.array([-5, 0, 1, 8, 32767, 32768, (1 << 62) + 9, -1], np.int64)
    m = np.frombuffer(collocations.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"), 20), np.uint8)
    assert collocations.inside(m, h.view(np.uint64)).all() and int(np.unpackbits(m).sum()) == len({int(x) % (1 << 20) for x in h})


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 10)
    raw = b"abc def ghi jkl mno, pq. r, s\n" * 3 + b"no separator at all here"
    parts = collocations.slices(raw)
    assert b"".join(parts) == raw and len(parts) > 5 and all(p[-1:] in b",.\n" for p in parts[:-1])
