"""Chains of wrong readings are undone, sound texts stay."""

from pyspark.sql import functions as F

from opinara.functions import text as X


def wrong(text, *codecs):
    for codec in codecs:
        if codec == "sloppy":  # windows-1252 with controls where it has no character
            text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
        else:
            text = text.encode().decode(codec)
    return text


SOUND = [
    "plain ascii", "", None, "Café, naïve, señor — fine", "größer “quoted” – öfter…", "CAFÉ…", "SCHÖ…", "ÉTÉ” dit-il", "Привет, мир", "नमस्ते बहुत अच्छा", "日本語のテスト", "価格は£5", "price: £5 or €4", "ÀÉÎÕÜ àéîõü", "„Ä“ und „Ö“",
    "😀 great 👍", "Iași, Țară, ơ ư", "a b", "x" * 5000 + " é", "tab\té\nline é",
]


def test_sound_texts_stay(spark):
    rows = spark.createDataFrame(list(enumerate(SOUND)), "i int, t string").select("i", X.descrambled(F.col("t")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == SOUND


def test_chains(spark):
    want, given = [], []
    for t in ["Café, naïve, señor", "it’s “fine” — really…", "größer öfter", "Привет, мир", "नमस्ते", "日本語", "😀 great 👍", "£5 or €4", "zażółć gęślą jaźń", "Iași, Țară"]:
        for chain in (["latin-1"], ["sloppy"], ["latin-1", "latin-1"], ["sloppy", "sloppy"], ["latin-1", "sloppy"], ["sloppy"] * 3, ["sloppy", "latin-1"]):
            want.append(t)
            given.append(wrong(t, *chain))
    # sound and scrambled words in one text, at different depths
    want.append("Café — naïve señor")
    given.append(f"Café — {wrong('naïve', 'sloppy')} {wrong('señor', 'sloppy', 'sloppy')}")
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", X.descrambled(F.col("t")).alias("t"))
    got = [r.t for r in rows.orderBy("i").collect()]
    assert [(g, w, x) for g, w, x in zip(given, want, got) if w != x] == []
