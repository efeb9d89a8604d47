"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from opinara.llm import byte_bpe, chat_format, language_id, minhash_dedup, order_minhash, packing, permutation_ann, substring_dedup, token_counts, warc  # noqa: E402
from opinara.storage import fresh_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{r.randrange(4000)}" for _ in range(20000)]
    texts = [" ".join(r.choices(words, k=r.choice((3, 25, 60, 120)))) for _ in range(n)]
    passage = " ".join(r.choices(words, k=30))
    texts += [f"{texts[0]}", f"{r.choice(words)} {passage} {r.choice(words)}", f"x {passage} y\n{passage}", texts[3] + " tail"]
    base = r.choices(words, k=100)
    for _ in range(12):
        near = list(base)
        for _ in range(r.randrange(1, 5)):
            near[r.randrange(100)] = r.choice(words)
        texts.append(" ".join(near))
    texts += [None, "", " \n\t", "one", "ONE", "é" * 50, "a b c d", "A B C D"]
    return list(enumerate(texts))


def frame(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumn("id", F.lit(1)).withColumn("h", F.lit("x")).repartition(3)


def test_byte_bpe(spark):
    import numpy as np

    path = public.path("byte_bpe_multi_50k.tiktoken")
    rows = [*corpus(), (900, "word \n" * 40000), (901, "a" * 70000), (902, " " * 70000)]
    enc = byte_bpe.encoding(path, public.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.digests(frame(spark, rows), path, public.PATTERN).collect()}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode_documents(frame(spark, rows), path, public.PATTERN).collect()}
    for i, t in rows:
        want = enc.encode_ordinary(t or "")
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digests(frame(spark, rows).limit(0), path, public.PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    path = public.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, public.PATTERN)
    rows = [(1, "ab cd\n\n\nef ééé\ngh"), (2, None), (3, ""), (4, "\n\n"), (5, "x\n")]
    df = frame(spark, rows).withColumn("spans", F.when(F.col("doc_id") == 1, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(4).cast("long"), F.lit(99).cast("long"))))
    for col in (None, "spans"):
        out = token_counts.section_token_counts(df, path, public.PATTERN, rule, col).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("char_end").alias("e")).collect()
        assert {r.doc_id: (round(r.n, 6), r.e) for r in out} == {i: (len(enc.encode_ordinary(t or "")), len(t or "")) for i, t in rows}


def brute_sections(text, starts, enc, rule):
    """(section, char_start, char_end, n_tokens, n_crossing), byte by byte: each byte knows its token and its section."""
    edges = [*starts, len(text)]
    section = [k for k in range(len(starts)) for _ in text[edges[k] : edges[k + 1]].encode()]
    counts, crossing, at = [0.0] * len(starts), [0] * len(starts), 0
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        own = section[at : at + size]
        at += size
        crossing[own[0]] += own[0] != own[-1]
        if rule == "split":
            for k in own:
                counts[k] += 1 / size
        else:
            counts[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
    return [(k, edges[k], edges[k + 1], round(counts[k], 6), crossing[k]) for k in range(len(starts))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_by_brute_force(spark, rule):
    """Starts inside tokens, inside words and behind characters of several bytes; lines; a repeated row; clashing names."""
    path = public.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoding(path, public.PATTERN)
    r = random.Random(9)
    texts = ["".join(r.choices(["international", "é", "日本", " ", "\n\n", "\n", "  ", "x1", "🙂", "straße"], k=r.choice((1, 5, 80, 400)))) for _ in range(40)] + ["one line", "\n"]
    rows = [(i, t, sorted({0, *(r.randrange(len(t)) for _ in range(r.randrange(6)))})) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, spans array<long>").withColumns({c: F.lit(1) for c in ("id", "section", "n_tokens")}).repartition(3)
    lines = lambda t: [0, *(k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t))]
    for col in (None, "spans"):
        want = sorted((i, *x) for i, t, s in rows + rows[:1] for x in brute_sections(t, s if col else lines(t), enc, rule))
        got = token_counts.section_token_counts(df, path, public.PATTERN, rule, col).collect()
        assert sorted((x.doc_id, x.section, x.char_start, x.char_end, round(x.n_tokens, 6), x.n_crossing) for x in got) == want
    assert sum(x[5] for x in want) > 0 and token_counts.section_token_counts(df.limit(0), path, public.PATTERN, rule).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (10, "u", ""), (11, "v\r\nX: y", "z" * 100000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    index = warc.write_archives(df, folder, archive_bytes=300)
    back = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    tasks = warc.read_records(index, folder, range_bytes=200, task_bytes=200)
    assert tasks.rdd.getNumPartitions() == -(-index.agg(F.sum("length")).first()[0] // 200) and tasks.count() == 5
    assert warc.read_records(index.union(index), folder).count() == 5 and warc.read_records(index.limit(0), folder).count() == 0
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in back.items()} == {5: ("revisit", 2, 9), 2: ("response", None, 9), 9: ("response", None, 0), 10: ("revisit", 9, 0), 11: ("response", None, 100000)}
    assert bytes(back[2].payload).decode() == "<p>é</p>" and back[5].digest == back[2].digest == warc.digest_of("<p>é</p>".encode())
    only = warc.read_records(index.filter("page_id = 11"), folder).collect()
    assert len(only) == 1 and len(only[0].payload) == 100000
    small = fresh_path(spark, "warc")
    index = warc.write_archives(df, small, min_revisit_bytes=9)
    assert {r.page_id: r.record_type for r in warc.read_records(index, small).collect()}[10] == "response"


def test_warc_of_null_and_repeated_ids(spark):
    rows = [(None, "a", "x"), (0, "b", "y"), (None, "c", "y"), (None, "d", "z"), (None, "d", "z"), (7, "e", "w"), (7, "e", "w"), (7, "f", "v"), (8, "g", "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).withColumn("p", F.lit(3))
    folder = fresh_path(spark, "warc")
    back = warc.read_records(warc.write_archives(df, folder), folder).collect()
    got = sorted((str(r.page_id), r.url, r.record_type, str(r.refers_to)) for r in back)
    assert got == sorted([("None", "a", "response", "None"), ("0", "b", "response", "None"), ("None", "c", "revisit", "0"), *[("None", "d", "response", "None")] * 2, *[("7", "e", "response", "None")] * 2, ("7", "f", "response", "None"), ("8", "g", "revisit", "7")])
    empty = warc.write_archives(df.limit(0), folder)
    assert empty.count() == 0 and warc.read_records(empty, folder).count() == 0


def test_order_minhash(spark):
    rows = corpus()
    out = order_minhash.fingerprint_edits(frame(spark, rows)).collect()
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in out}
    for k, (i, _) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        h = len(a) // 2
        assert got[i].edited_sha256 == hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[60].fingerprint
    swap = frame(spark, [(0, " ".join(f"a{i}" for i in range(200))), (1, " ".join(f"a{i}" for i in [*range(100, 200), *range(100)]))])
    x, y = order_minhash.with_fingerprint(swap, "text", "fp").orderBy("doc_id").select("fp").collect()
    assert 0.2 < len({*x.fp} & {*y.fp}) / len(x.fp) < 0.9  # half the pairs change their order
    assert order_minhash.fingerprint_edits(frame(spark, rows).limit(0)).count() == 0


def brute_fingerprint(text):
    """For each share, the two elements that come first from its start on, round the end; told by the hashes the docstring names."""
    import re
    import struct

    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    high = lambda x: x % 2**64 >> order_minhash.PLACE_BITS

    def xx(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p, seed=seed)
        return seed

    words = re.findall(order_minhash.WORD, text, re.ASCII)
    seen, elements = {}, []
    for place in range(max(len(words) - 1, min(len(words), 1))):
        h = high(xx(*words[place : place + 2]))
        seen[h] = seen.get(h, 0) + 1
        if seen[h] > 1:
            h = high(xx(struct.pack("<q", h), struct.pack("<i", seen[h] - 1)))
        elements.append((signed(h << order_minhash.PLACE_BITS), place))
    elements.sort()
    out = []
    for share in range(order_minhash.SKETCHES if elements else 0):
        start = -(2**63) + share * 2**64 // order_minhash.SKETCHES
        turned = [x for x in elements if x[0] >= start] + [x for x in elements if x[0] < start]
        first = sorted(turned[: order_minhash.TUPLE], key=lambda x: x[1])
        out.append(share << 32 | xx(*(struct.pack("<q", high(h)) for h, _ in first)) & 0xFFFFFFFF)
    return out


def test_order_minhash_by_brute_force(spark):
    """Fingerprints and both likenesses, with repeated k-mers, one word, long words, a very long text, and a repeated row with a clashing name."""
    r = random.Random(8)
    rows = [*corpus(seed=8, n=20), (700, "a b " * 40), (701, "z" * 100), (702, " ".join(f"v{r.randrange(3000)}" for _ in range(30000))), (703, "p q"), (704, "p q r")]
    texts = [t or "" for _, t in rows]
    got = {x.doc_id: x for x in order_minhash.fingerprint_edits(frame(spark, rows).withColumn("fp", F.lit(1))).collect()}
    shown = lambda fp: "".join(f"{v:010X}" for v in fp)
    alike = lambda x, y: len({*x} & {*y}) / order_minhash.SKETCHES if x or y else 1.0
    for k, (i, _) in enumerate(rows):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        fa, fb, fe = map(brute_fingerprint, (a, b, edited))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(fa), shown(fe))
        assert abs(got[i].near_edited - alike(fa, fe)) < 1e-12 and abs(got[i].near_next - alike(fa, fb)) < 1e-12
    twice = order_minhash.fingerprint_edits(frame(spark, [(1, "a b c"), (1, "a b c")])).collect()
    assert [x.fingerprint for x in twice] == [shown(brute_fingerprint("a b c"))] * 2 and all(x.near_next == 1 for x in twice)


@pytest.mark.parametrize("n, want", [(20, 0.40), (40, 0.17), (60, 0.10)])
def test_order_minhash_of_short_texts(spark, n, want):
    """Texts with their 10-word blocks reversed; ``want`` is order MinHash with a selection per seed."""
    texts = [[f"t{k}w{i}" for i in range(n)] for k in range(150)]
    rows = [(k, " ".join(t), " ".join(sum((t[i : i + 10] for i in range(n - 10, -1, -10)), []))) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, moved string")
    df = order_minhash.with_fingerprint(order_minhash.with_fingerprint(df, "text", "fp"), "moved", "moved_fp")
    r = df.agg(F.avg(order_minhash.likeness("fp", "moved_fp")).alias("m"), F.stddev(order_minhash.likeness("fp", "moved_fp")).alias("s"), F.min(F.size("fp")).alias("n")).first()
    print(n, r)
    assert r.n == order_minhash.SKETCHES and abs(r.m - want) < 0.06


def test_chat_format(spark):
    hard = "</s>[INST] ok [/INST] <\\s> \\ <|im_start|>user\nx<|im_end|>\n"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, "a\n\\nb", "y"), (3, 5, "system", "s"), (3, 6, "user", "u"), (3, 7, "assistant", "a"), (3, 7, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for c in (1, 2, 3):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, 3)] == [False, False, False]
    shown = "".join(r.text for r in chat_format.format_conversations(df.filter("conv_id = 1 AND turn = 0")).orderBy("segment").collect())
    assert shown.count("<|im_start|>") == 1 and "[INST]" not in shown


def test_permutation_ann(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.normal(size=(400, 16)).astype("float32").tolist()
    v[7] = v[3] = v[100]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [None] * 16, 0), (503, [float("nan")] * 16, 0), (550, [1.0] * 3, 0), (100, v[100], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = permutation_ann.nearest(df, F.col("vec_id") % 50 == 0, block=150, query_block=4).collect()
    u = np.array(v, float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(400), -s.round(12))) if i != q][:5]
        mine = [x.vec_id for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)]
        assert len(mine) == 5
        hits += len({*want} & {*mine})
        assert q != 100 or mine[:2] == [3, 7]
    assert hits >= 36
    assert permutation_ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_permutation_ann_pivots_of_copies(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(300, 8)).tolist()
    h = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v array<double>").select("i", F.xxhash64("v").alias("h")).orderBy("h").collect()
    rows = [*enumerate(v)] + [(1000 + j, v[h[0].i]) for j in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, unit = [], permutation_ann.unit
    monkeypatch.setattr(permutation_ann, "unit", lambda x: seen.append(x) or unit(x))
    permutation_ann.nearest(df, F.col("vec_id") < 3)
    assert seen[0].tolist() == [v[r.i] for r in h[: permutation_ann.PIVOTS]]


def brute_substrings(rows, n):
    seen, out = {}, {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = [True] * n
            seen.setdefault(k, (i, s))
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_substring_dedup(spark, chunk, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(substring_dedup.seeds_of, "__defaults__", (chunk,))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()}
    for i, (n, removed, kept) in brute_substrings(rows, 20).items():
        assert got[i][:2] == (n, removed)
        assert got[i][2] == (kept if removed else rows[i][1])
    twice = frame(spark, rows).union(frame(spark, rows))
    assert sorted(set((r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(twice).collect())) == sorted((i, x[1]) for i, x in got.items())
    assert substring_dedup.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_substring_dedup_of_repeated_rows(spark, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup.seeds_of, "__defaults__", (chunk,))
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(5, a)] * 4500 + [(6, a + " tail"), (7, b), (7, f"x {c} {d}"), (8, c), (None, f"{d} y"), (None, "short"), (None, f"z {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.text): (r.n_removed, r.n) for r in substring_dedup.dedup_substrings(df).groupBy("doc_id", "text", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {(5, a): (0, 4500), (6, a + " tail"): (40, 1), (7, b): (40, 1), (7, f"x {c} {d}"): (40, 1), (8, c): (40, 1), (None, f"{d} y"): (0, 1), (None, "short"): (0, 1), (None, f"z {b}"): (0, 1)}


def brute_language(texts, model):
    """The rule with plain one-shot compression per block."""
    import zstandard as z

    def size(raw, lang_raw):
        d = z.ZstdCompressionDict(lang_raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        return sum(len(z.ZstdCompressor(level=9, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096))

    out = []
    for t in texts:
        raw = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()).encode()
        by_size = sorted(((size(raw, d), i, k) for i, (k, d) in enumerate(model.dictionaries))) if raw else []
        out.append((by_size[0][2], (by_size[1][0] - by_size[0][0]) / by_size[1][0] < language_id.MIN_MARGIN) if by_size else ("und", True))
    return out


def test_substring_dedup_of_hot_anchors_and_names(spark, monkeypatch):
    """One phrase before and after which everything differs, many near copies, a long text, columns with the names used inside."""
    monkeypatch.setattr(substring_dedup.seeds_of, "__defaults__", (3000,))
    r = random.Random(5)
    words = [f"v{i}" for i in range(30)]
    say = lambda n: " ".join(r.choices(words, k=n))
    phrase = "all rights are reserved by us"
    rows = [(i, f"{say(12)} {phrase} {say(12)}") for i in range(300)]
    base = [f"b{i}" for i in range(60)]
    rows += [(300 + i, " ".join(w if r.random() > 0.05 else r.choice(words) for w in base)) for i in range(200)]
    rows += [(500 + i, f"{phrase} {say(6)} {phrase} {say(6)} {phrase}") for i in range(100)]
    rows += [(700, say(20000)), (701, " ".join(["same"] * 500)), (702, None), (703, "")]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("__id", "__t", "__marks", "__d", "D", "m", "u", "t", "n", "start", "mask", "kept")})
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.dedup_substrings(df).collect()}
    for i, (n, removed, kept) in brute_substrings(rows, 20).items():
        assert got[i] == (n, removed, kept if removed else dict(rows)[i])
    assert sum(x[1] > 0 for x in got.values()) > 100
    short = {x.doc_id: x.n_removed for x in substring_dedup.dedup_substrings(frame(spark, rows), window=9, anchor=3).collect()}
    assert short == {i: x[1] for i, x in brute_substrings(rows, 9).items()}


def test_language_id(spark):
    r = random.Random(3)
    langs = {k: ["".join(r.choices(k * 3 + "aeiou", k=r.randrange(2, 8))) for _ in range(80)] for k in ("qxz", "mnp", "rst")}
    rows = [(i, " ".join(r.choices(langs[k], k=60)), k) for i, k in enumerate(["qxz", "mnp", "rst", "mnp"] * 40)]
    odd = [(900, None, "mnp"), (901, "", None), (902, "123 ?!", "rst"), (903, rows[0][1], None), (904, " ".join(r.choices(langs["mnp"], k=9000)), None), (905, "b", None), (906, "jkl vwy gfd bch", None), (None, rows[1][1], None)]
    df = spark.createDataFrame([*rows, *odd, odd[3]], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    model = language_id.fit(df.filter(~language_id.held_out()))
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert language_id.predict(df, model).count() == len(rows) + len(odd) + 1
    held = [x.doc_id for x in df.filter(language_id.held_out() & (F.col("doc_id") < 900)).collect()]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "qxz", "mnp", "mnp"]
    assert got[905].lang_rejected and not got[904].lang_rejected
    every = [*rows, *odd]
    assert [(got[i].lang_pred, got[i].lang_rejected) for i, _, _ in every] == brute_language([t for _, t, _ in every], model)
    assert all(0 <= x.lang_score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id.predict(df, language_id.fit(df.limit(0))).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_language_id_learns_every_language(spark):
    names = [f"l{i:03d}" for i in range(80)]
    rows = [(i, f"{n} " * 20 + f"word{i}", n) for i, n in enumerate(names)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(k for k, _ in model.dictionaries) == names


def brute_components(rows, n):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_minhash_dedup(spark, n):
    rows = corpus(seed=n)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame(spark, rows), shingle=n).collect()}
    assert got == brute_components(rows, n)
    assert minhash_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_minhash_dedup_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(None, a), (0, b), (5, a), (None, c), (None, c + " x"), (7, b + " x"), (8, d), (8, d), (9, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("given", "node", "n_shingles", "set_id", "kept")})
    got = minhash_dedup.near_duplicates(df).collect()
    by_id = {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by_id == {0: (0, True), 5: (5, True), 7: (0, False), 8: (8, True), 9: (9, True)} and len(got) == len(rows)
    nulls = sorted((r.component_id if r.component_id < 1 << 62 else "key", r.n_shingles, r.kept) for r in got if r.doc_id is None and r.component_id < 1 << 62)
    keys = [r for r in got if r.doc_id is None and r.component_id >= 1 << 62]
    assert nulls == [(5, 56, False)] and sorted((r.n_shingles, r.kept) for r in keys if r.n_shingles) in ([(56, True), (57, False)], [(56, False), (57, True)])
    assert len({r.component_id for r in keys if r.n_shingles}) == 1 and all(r.kept for r in keys if not r.n_shingles)


@pytest.mark.parametrize("block", [None, (2, 8)])
def test_minhash_dedup_of_long_and_borderline_texts(spark, block, monkeypatch):
    """Copies that differ in about a tenth of the shingles, so that many pairs lie round the threshold, and long texts."""
    if block:
        monkeypatch.setattr(minhash_dedup, "STRAYS", block[0])
        monkeypatch.setattr(minhash_dedup, "MEMBERS", block[1])
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        near = list(base)
        for _ in range(r.randrange(0, 5)):
            near[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(near))
    long = [f"l{r.randrange(10**6)}" for _ in range(20000)]
    texts += [" ".join(long), " ".join(long[:-1500]), " ".join(long[:9000])]
    rows = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("block", [(128, 1024), (4, 8)])
def test_minhash_candidates_of_one_long_list(spark, block, monkeypatch):
    """A value that all sets share: every pair that is apart and likely alike comes out once, however the list is cut."""
    monkeypatch.setattr(minhash_dedup, "STRAYS", block[0])
    monkeypatch.setattr(minhash_dedup, "MEMBERS", block[1])
    r = random.Random(5)
    pool = [r.randrange(-(2**63), 2**63) for _ in range(24)]
    sets = {i: sorted({*r.sample(pool, r.randrange(14, 22)), pool[0]}, key=lambda v: v % 2**64) for i in range(60)}
    where = {i: (i // 3, i // 2) for i in sets}
    lists = spark.createDataFrame([(pool[0], i) for i in sets], "v long, node long")
    state = spark.createDataFrame([(i, *where[i]) for i in sets], "node long, component long, centre long")
    classes = spark.createDataFrame([(i, s, 100) for i, s in sets.items()], "node long, sketch array<long>, n_shingles long")
    got = [tuple(x) for x in minhash_dedup.rivals(lists, state, classes, 16, 0.8, 0.7).collect()]
    low = lambda a, b: set(sorted({*a, *b}, key=lambda v: v % 2**64)[:16])
    apart = [(a, b) for a in sets for b in sets if a < b and all(x != y for x, y in zip(where[a], where[b]))]
    want = [(a, b) for a, b in apart if len(low(sets[a], sets[b]) & {*sets[a]} & {*sets[b]}) >= 0.7 * 16]
    assert sorted(got) == want and 0 < len(want) < len(apart)


def test_packing(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    odd = "hello <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> DON'T'LL 's''re Straße ΣΟΦΟΣ İ ﬁ ½² ª º × e\u0301 \u0301 \x1c x\x85y \u200b日本 12,5"
    rows = [*corpus(), (900, odd), (901, f"{odd} word\n" * 9000), (902, "x" * 600000), (903, odd)]
    tk = Tokenizer.from_file(path)
    few = packing.Encoder(path, most=20)
    for part in (rows[:30], rows[20:60], rows[:30]):
        assert [tk.encode(t or "", add_special_tokens=False).ids for _, t in part] == [np.frombuffer(x, "<u4").tolist() for x in few([t for _, t in part])]
    got = packing.pack(frame(spark, rows), path, with_ids=True).collect()
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in rows:
        want = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in parts) == b"".join(x.to_bytes(4, "little") for x in want)
        assert all(p.doc_tokens == len(want) for p in parts) and parts[0].start == 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    steps = {}
    for r in got:
        steps.setdefault((r.sequence_id >> 32, r.step_group), []).append(r.length)
    for p in {p for p, _ in steps}:
        assert [sum(x) for k, x in sorted(steps.items()) if k[0] == p][:-1] == [packing.STEP_TOKENS] * (sum(k[0] == p for k in steps) - 1)
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    rows = [(i, t) for i, t in corpus(n=20) if t and t.strip()]
    docs = frame(spark, rows).select(*cp.COLUMNS)
    near = cp.near_dedup(spark, docs, "")
    kept = {i for i, (_, _, k) in brute_components(rows, 5).items() if k}
    assert {r.doc_id for r in near.collect()} == kept
    cut = cp.substrings(spark, near, "")
    want = {i: (x[2] if x[1] else dict(rows)[i]) for i, x in brute_substrings([r for r in rows if r[0] in kept], 20).items() if not x[1] or x[1] < x[0]}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == list(cp.COLUMNS)
    assert {r.doc_id for r in cp.pack(spark, cut, "").collect()} == {*want}


def test_pipeline_language_stage(spark, tmp_path):
    """Rows with null, repeated and missing ids stay as often as they come, if the plain rule keeps their text."""
    import corpus_pipeline as cp

    r = random.Random(6)
    langs = {k: ["".join(r.choices(k * 3 + "aeiou", k=r.randrange(2, 8))) for _ in range(60)] for k in ("qxz", "mnp")}
    rows = [(i, " ".join(r.choices(langs[k], k=50)), k) for i, k in enumerate(["qxz", "mnp"] * 30)]
    rows += [(None, rows[0][1], None), (None, rows[0][1], None), (7, rows[1][1], "qxz"), (80, None, "qxz"), (81, "12 34", None), (82, "", None), (83, "wwww", None)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdicts = brute_language([t for _, t, _ in rows], language_id.fit(docs))
    want = sorted(((i, t) for (i, t, _), (_, gone) in zip(rows, verdicts) if not gone), key=str)
    kept = cp.language(spark, docs, str(tmp_path))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == want and kept.columns == list(cp.COLUMNS) and len(want) >= 60
    packed = cp.pack(spark, kept, "")
    assert packed.filter("start = 0").count() == len(want) and cp.pack(spark, kept.limit(0), "").count() == 0


def test_pipeline_keeps_rows_without_or_with_equal_ids(spark):
    import corpus_pipeline as cp

    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    rows = [(None, a), (None, b), (None, b), (0, c), (3, b + " x"), (4, d), (4, e), (4, e), (5, e + " y"), (6, None), (7, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    near = cp.near_dedup(spark, docs, "")
    want = sorted([(None, a), (0, c), (3, b + " x"), (4, d), (4, e), (6, None), (7, ""), (None, None), (None, "")], key=str)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == want
    assert sorted(((r.doc_id, r.text) for r in cp.substrings(spark, near, "").collect()), key=str) == want


def test_language_id_learns_every_language(spark):
    """Null and repeated ids: each language is learned, and the sample stays within its bound."""
    r = random.Random(5)
    words = {a: ["".join(r.choices(a, k=6)) for _ in range(40)] for a in ("abcd", "efgh", "ijkl")}
    text = lambda a: " ".join(r.choices(words[a], k=30))
    rows = [(None, text("abcd"), "de") for _ in range(400)] + [(3, text("efgh"), "fr") for _ in range(400)] + [(i, text("ijkl"), "en") for i in range(400)]
    rows += [(6, "mnop " * 20, "es")] * 1000 + [(7, "x", None), (8, None, "it"), (9, "", "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit(1)).repartition(4)
    model = language_id.fit(df)
    assert {k for k, _ in model.dictionaries} == {"de", "fr", "en", "es"} and model.dictionaries[0][0] == "es"
    parts = {k: v.split(b"\n") for k, v in model.dictionaries}
    assert len(parts["es"]) == 1 and all(100 < len(parts[k]) <= language_id.SAMPLE_DOCS for k in ("de", "fr", "en"))
    got = language_id.predict(df.filter("lang IS NOT NULL AND text <> ''"), model).collect()
    assert all(x.lang_pred == x.lang for x in got)
    assert language_id.fit(df.limit(0)).dictionaries == ()


def test_shared_shingles_in_slices(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    lists = lambda n: [r.choice(300, r.integers(0, 80), replace=False) for _ in range(n)]
    x, y = [*lists(9), np.zeros(0, np.int64)], lists(20)
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    for width in (7, 64, 8192):
        monkeypatch.setattr(minhash_dedup, "WIDTH", width)
        assert minhash_dedup.shared(x, y).tolist() == want
    assert minhash_dedup.shared([[], []], y).tolist() == [[0] * 20] * 2 and minhash_dedup.shared(x, [[]] * 3).tolist() == [[0] * 3] * 10
