"""Exact removal of repeated word windows: documents meet on winnowed anchors, and matches are extended word by word."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from opinara.llm._common import map_arrow, table, unused
from opinara.llm._words import mix, sequences, words_of
from opinara.storage import stored

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Characters of the texts that a map task compares among themselves before it shuffles anything.
CHUNK_CHARS = 4 << 20
#: Stands for a doc_id that is null, before all others.
NO_ID = -(2**63)
SEED = "h long, doc_id long, t long, start int, n int, place int, mask long"
MARK = "doc_id long, t long, start int, n int, mask long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def slide_min(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of each w neighbours and its (first) offset."""
    m = len(g) - w + 1
    best, off = g[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, w):
        less = g[k : k + m] < best
        best[less] = g[k : k + m][less]
        off[less] = k
    return best, off


def repeats_here(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """True for each window (of ``words`` from ``at``, in order) whose words also start at an earlier one of ``at``."""
    _, first, back = np.unique(sequences(words, window, 7)[at], return_index=True, return_inverse=True)
    source = first[back]
    dup = source < np.arange(len(at))
    x, y = at[dup], at[source[dup]]
    same = np.ones(len(x), bool)
    for k in range(window):
        same &= words[x + k] == words[y + k]
    dup[dup] = same
    return dup


def anchors_of(ids: np.ndarray, t: np.ndarray, texts: list[str | None], window: int, anchor: int) -> list:
    """Columns of SEED for a chunk of documents, told by doc_id and the hash t of their text; rows that repeat both are one.

    With mask 0, a row stands for the n neighbouring windows from word ``start`` whose
    smallest ``anchor``-word hash is h, at word start + place. Other rows say what repeats
    within the chunk: all n windows from ``start`` (mask -1), or those of the set bits;
    their h only deals them out. Windows that all repeat here have no anchor row.
    """
    order = np.lexsort((t, ids))
    ids, t = ids[order], t[order]
    new = np.ones(len(order), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (t[1:] != t[:-1])
    order, ids, t = order[new], ids[new], t[new]
    words, counts = words_of([texts[i] for i in order])
    empty = [[] for _ in names(SEED)]
    if len(words) < window:
        return empty
    begin = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    ok = doc[: len(words) - window + 1] == doc[window - 1 :]
    if not ok.any():
        return empty
    # where a stretch crosses from one document into the next its values are never used
    at = np.flatnonzero(ok)
    dup = repeats_here(words, at, window)
    best, off = slide_min(sequences(words, anchor, 8), window - anchor + 1)
    best, place = best[: len(ok)][ok].view(np.int64), at + off[: len(ok)][ok]
    d = doc[: len(ok)][ok]
    del words, off, doc, ok
    # a row for each run of windows with the same anchor at the same place; neighbouring ones that repeat throughout are one
    same_doc = np.concatenate([[False], d[1:] == d[:-1]])
    new = ~same_doc
    new[1:] |= place[1:] != place[:-1]
    f = np.flatnonzero(new)
    all_dup = np.logical_and.reduceat(dup, f)
    merge = np.zeros(len(f), bool)
    merge[1:] = all_dup[1:] & all_dup[:-1] & same_doc[f[1:]]
    head, full = f[~merge], all_dup[~merge]
    n = np.diff(np.append(head, len(at)))
    bit = np.arange(len(at)) - np.repeat(head, n)
    bits = np.add.reduceat(np.where(dup & ~np.repeat(full, n), np.left_shift(1, np.minimum(bit, 62)), 0), head)
    start, where = (at - begin[d])[head], place[head] - at[head]
    seeds, marks = np.flatnonzero(~full), np.flatnonzero(full | (bits > 0))
    spread = mix((ids[d[head]] * 31 + start).astype(np.uint64)).view(np.int64)
    rows = np.concatenate([seeds, marks])
    of = d[head][rows]
    h = np.concatenate([best[head][seeds], spread[marks]])
    mask = np.concatenate([np.zeros(len(seeds), np.int64), np.where(full, -1, bits)[marks]])
    return [h, ids[of], t[of], start[rows], n[rows], where[rows], mask]


def seeds_of(keyed: DataFrame, window: int, anchor: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """SEED rows of all documents: what repeats within a chunk, and every run of windows whose anchor occurs elsewhere too."""

    def seed(batches):
        ids, t, texts, size = [], [], [], 0

        def rows():
            return dict(zip(names(SEED), anchors_of(np.array(ids, np.int64), np.array(t, np.int64), texts, window, anchor)))

        for b in batches:
            ids += b.column(0).to_pylist()
            t += b.column(1).to_pylist()
            new = b.column(2).to_pylist()
            texts += new
            size += sum(len(x) for x in new if x)
            if size >= chunk_chars:
                yield rows()
                ids, t, texts, size = [], [], [], 0
        yield rows()

    def join(batches):
        """Of the rows sorted by h, document and start, the marks and those whose h another place has; a lone last one waits."""
        held, before = [np.zeros(0, np.int64) for _ in names(SEED)], None
        for b in batches:
            columns = [np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(held)]
            h, mask = columns[0], columns[6]
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            other = same & np.any([x[1:] != x[:-1] for x in columns[1:4]], axis=0)
            keep = mask != 0
            keep[1:] |= other
            keep[:-1] |= other
            # rows that repeat a document follow their first one; all of an anchor stay once two differ
            group = np.concatenate([[0], np.cumsum(~same)])
            keep |= np.bincount(group, np.concatenate([[False], other]))[group] > 0
            keep |= h == before
            last = group == group[-1]
            if keep[-1] or mask[-1]:
                before, held = (h[-1] if not mask[-1] else before), [x[:0] for x in columns]
            else:
                # one place only so far: its first row stands for it
                held = [x[last][:1] for x in columns]
            yield {c: x[keep] for c, x in zip(names(SEED), columns)}

    found = map_arrow(keyed, seed, SEED)
    return map_arrow(found.repartition("h").sortWithinPartitions("h", "doc_id", "t", "start"), join, SEED)


def contexts_of(base: DataFrame, key: str, t: str, seeds: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, doc_id, t, start, n, place, words) of each seed: its windows' words, in up to two parts.

    A window has at least half of its other words after the anchor, or before it. The part
    of either kind is dealt by the anchor grown by that many words to that side, so the
    occurrences of a frequent phrase are parted by what stands next to it.

    All columns of ``base`` go along, so that the texts are shuffled once for this join and
    the one that removes words: Spark reuses an exchange only where it is wholly the same.
    """
    half = (window - anchor + 1) // 2
    d, u, found = (unused(base.columns, x) for x in ("__d", "__u", "__rows"))
    wanted = seeds.groupBy(F.col("doc_id").alias(d), F.col("t").alias(u)).agg(F.collect_set(F.struct("start", "n", "place")).alias(found))
    rows = base.join(wanted, (base[key] == wanted[d]) & (base[t] == wanted[u])).drop(d, u)
    out = "key long, doc_id long, t long, start int, n int, place int, words binary"

    def run(batches):
        last = None
        for b in batches:
            columns = [[] for _ in names(out)]
            for i, h, text, runs in zip(*(b.column(k).to_pylist() for k in (key, t, "text", found))):
                if (i, h) == last:
                    continue  # a repeated row
                last = (i, h)
                words = text.encode().split()
                for r in sorted(runs, key=lambda r: r["start"]):
                    start, n, place = r["start"], r["n"], r["place"]
                    # windows start + j: those from ``cut`` on have ``half`` words and more after the anchor
                    cut = min(n, max(0, place + anchor + half - window))
                    for a, z, near in ((0, cut, slice(start + place - half, start + place + anchor)), (cut, n, slice(start + place, start + place + anchor + half))):
                        if a < z:
                            grown = hashlib.blake2b(b" ".join(words[near]), digest_size=8, salt=b"before" if z == cut else b"after").digest()
                            row = (int.from_bytes(grown, "little", signed=True), i, h, start + a, z - a, place - a, b" ".join(words[start + a : start + z - 1 + window]))
                            for x, c in zip(row, columns):
                                c.append(x)
            yield dict(zip(names(out), columns))

    return map_arrow(rows, run, out)


def extended(contexts: DataFrame, window: int, anchor: int) -> DataFrame:
    """MARK rows: the windows that an earlier occurrence of the same grown anchor has word for word.

    The occurrences of a key come as a stream in order of document and start. From the
    anchor each is extended to both sides, word by word, along the paths that occurrences
    before it have taken; a window is the pair of the ends of its two paths, and repeats if
    that pair was seen. So words are compared, not hashes, and no pairs of occurrences are made.
    """

    def run(batches):
        last, paths, seen = None, {}, {}
        for b in batches:
            columns = [[] for _ in names(MARK)]
            for key, i, t, start, n, place, text in zip(*(b.column(k).to_pylist() for k in range(7))):
                words = text.split(b" ")
                middle = tuple(words[place : place + anchor])
                if key != last:
                    last, paths, seen = key, {}, {}
                left = right = paths.setdefault(middle, len(paths))
                lefts, rights = {place: left}, {place + anchor: right}
                for k in range(place - 1, -1, -1):
                    left = lefts[k] = paths.setdefault((left, 0, words[k]), len(paths))
                for k in range(place + anchor, len(words)):
                    right = rights[k + 1] = paths.setdefault((right, 1, words[k]), len(paths))
                mask = 0
                for j in range(n):
                    me = (i, t, start + j)
                    if seen.setdefault((lefts[j], rights[j + window]), me) != me:
                        mask |= 1 << j
                if mask:
                    for x, c in zip((i, t, start, n, mask), columns):
                        c.append(x)
            yield dict(zip(names(MARK), columns))

    return map_arrow(contexts.repartition("key").sortWithinPartitions("key", "doc_id", "t", "start"), run, MARK)


def covered(n_words: int, marks, window: int) -> np.ndarray:
    """Which words lie in a marked window."""
    edge = np.zeros(n_words + 1, np.int32)
    for m in marks or ():
        start, n, mask = m["start"], m["n"], m["mask"]
        if mask < 0:
            edge[start] += 1
            edge[start + n + window - 1] -= 1
        else:
            for j in range(mask.bit_length()):
                if mask >> j & 1:
                    edge[start + j] += 1
                    edge[start + j + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_marks(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, str]:
    """``docs`` with a column, whose name comes too, of the windows that start earlier as well."""
    key, t, marks = (unused(docs.columns, x) for x in ("__id", "__t", "__marks"))
    base = docs.withColumn(key, F.coalesce(F.col("doc_id"), F.lit(NO_ID))).withColumn(t, F.xxhash64("text"))
    keyed = base.select(F.col(key).alias("__id"), F.col(t).alias("__t"), "text")
    seeds = stored(seeds_of(keyed, window, anchor), "seeds")
    found = extended(contexts_of(base, key, t, seeds.filter("mask = 0"), window, anchor), window, anchor)
    found = found.union(seeds.filter("mask <> 0").select(*names(MARK)))
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_set(F.struct("start", "n", "mask")).alias("m"))
    by_doc = by_doc.select(*[F.col(x).alias(unused(docs.columns, f"__{x}")) for x in by_doc.columns])
    d, u, m = by_doc.columns
    return base.join(by_doc, (base[key] == by_doc[d]) & (base[t] == by_doc[u]), "left").select(*[base[c] for c in docs.columns], by_doc[m].alias(marks)), marks


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: its words outside every window of ``window`` words that also starts earlier.

    Earlier: in a document with a smaller doc_id (equal ones: with a smaller hash of its
    text), or before in the same one; windows are judged on the input.

    1. Seeds: in every window the smallest hash of ``anchor`` neighbouring words is its
       anchor, so equal windows have equal anchors at equal places. Map tasks compare the
       windows of a chunk of texts among themselves first, which keeps a passage that many
       documents share from becoming a large group; then places meet by their anchor, and
       those of an anchor that occurs once are done.
    2. Extension: the others are grown word by word to both sides and compared with what
       came before (``extended``). Neighbouring repeated windows add up to maximal repeats.

    The cost is linear in the words; no pairs are made. A hash decides only what meets.

    ``kept`` joins the kept words by one space, and is the text itself where nothing is
    removed. A null or empty text has no words. Rows that repeat a doc_id with its text
    are one document and get the same result, however many there are; different texts under
    one doc_id are documents of their own. A null doc_id stands before all others. An
    empty table gives no rows. Other columns stay, but for those of the new names, which are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    (rows, marks), columns = with_marks(docs, window, anchor), docs.columns

    def run(batches):
        for b in batches:
            n, removed, kept = [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column(marks).to_pylist()):
                words = (text or "").encode().split()
                drop = covered(len(words), found, window)
                n.append(len(words))
                removed.append(int(drop.sum()))
                kept.append(text if not removed[-1] else b" ".join([w for w, d in zip(words, drop.tolist()) if not d]).decode())
            yield {c: b.column(c) for c in columns} | {"n_words": n, "n_removed": removed, "kept": kept}

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", n_words long, n_removed long, kept string"
    return map_arrow(rows, run, schema)


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document n_words, n_removed and the digest of the kept words."""

    def run(batches):
        for b in batches:
            out = {"doc_id": b.column(0), "n_words": [], "n_removed": [], "kept_sha256": []}
            for text in b.column(1).to_pylist():
                out["kept_sha256"].append(hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest())
            yield out | {"n_words": b.column(2), "n_removed": b.column(3)}

    found = dedup_substrings(docs.select("doc_id", "text"), window, anchor)
    return map_arrow(found.select("doc_id", "kept", "n_words", "n_removed"), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS s, words FROM w WHERE len(words) >= 20),
hashed AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM win),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM hashed) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM dup, (SELECT unnest(range(20)) AS k)),
by_doc AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN by_doc ON w.doc_id = by_doc.doc_id
"""
