"""Text cleaning and scoring as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from opinara import schema as S

#: Words as both engines see them: letters, digits, underscore.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def one_space(text: Column) -> Column:
    """Every run of white space as one blank; only runs of several cost a regex match."""
    return F.regexp_replace(F.translate(text, "\t\n\x0b\f\r", "     "), " {2,}", " ")


def has_words(text: Column, least: int) -> Column:
    """Whether white space parts ``text`` into ``least`` strings; reads no further than that."""
    return text.rlike(r"\s" + r"\S+\s+" * (least - 3) + r"\S+\s" if least > 2 else r"\s" * (least - 1))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of ``terms`` occur in ``text`` as substrings."""
    return sum((F.contains(text, F.lit(k)).cast("int") for k in terms), F.lit(0))


def of_words(ws: Column, terms: list[str]) -> Column:
    """How many of the words are among ``terms``, with repetition."""
    return F.size(F.filter(ws, lambda w: w.isin(*terms)))


def emojis_to_tags(text: Column) -> Column:
    for emoji, tag in S.EMOJI_TAGS.items():
        text = F.replace(text, F.lit(emoji), F.lit(f" {tag} "))
    return F.trim(one_space(text))


def repaired(text: Column) -> Column:
    """Without NUL and zero-width characters, quotes made straight."""
    return F.translate(text, "‘’“”\x00​‌‍﻿᠎", "''\"\"")


def composed(text: Column) -> Column:
    """NFC. A text within Latin-1 is composed already and never leaves the JVM's row as a string to be changed."""
    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    beyond = text.rlike(r"[^\x{0}-\x{FF}]")
    return F.coalesce(nfc(F.when(beyond, text)), text)


def unscrambled(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1 is read again; texts with other characters, or not UTF-8 then, stay."""
    latin = F.encode(F.when(text.rlike(r"^[\x{0}-\x{FF}]*$") & text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]"), text), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(latin), latin).otherwise(text)


#: Characters that windows-1252 has where Latin-1 has controls, and these controls.
_SPECIAL = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_SPECIALS, _CONTROLS = "".join(_SPECIAL.values()), "".join(chr(b) for b, c in _SPECIAL.items() if c)
#: Bytes of one UTF-8 character of two to four bytes, as characters.
_SCRAMBLED = r"[\x{C2}-\x{DF}][\x{80}-\x{BF}]|[\x{E0}-\x{EF}][\x{80}-\x{BF}]{2}|[\x{F0}-\x{F4}][\x{80}-\x{BF}]{3}"
#: What reviews hardly contain: controls, rare Latin and phonetic letters, private use, and other alphabets' letters beside Latin ones.
_UNLIKELY = r"[\x{80}-\x{9F}\x{180}-\x{19F}\x{1A2}-\x{1AE}\x{1B1}-\x{217}\x{21C}-\x{2FF}\x{E000}-\x{F8FF}\x{FFFD}]|(?<=\p{IsLatin})[\x{370}-\x{7FF}]|[\x{370}-\x{7FF}](?=\p{IsLatin})"


def as_bytes(text: Column) -> Column:
    """The windows-1252 characters of ``text`` as the Latin-1 controls of the same bytes."""
    return F.translate(text, _SPECIALS, _CONTROLS)


def reread(text: Column) -> Column:
    """``text`` with its characters taken as bytes of windows-1252 or Latin-1, mixed or not, and read as UTF-8; null where that cannot be."""
    plain = as_bytes(text)
    latin = F.encode(F.when(plain.rlike(r"^[\x{0}-\x{FF}]*$") & plain.rlike(_SCRAMBLED), plain), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(latin), latin)


def badness(text: Column) -> Column:
    """How much of ``text`` looks scrambled: sequences that would be UTF-8, and unlikely characters."""
    return F.regexp_count(as_bytes(text), F.lit(_SCRAMBLED)) + F.regexp_count(text, F.lit(_UNLIKELY))


def descrambled(text: Column) -> Column:
    """UTF-8 that was read as windows-1252 or Latin-1, up to three times over, is read again.

    Each piece between blanks is repaired by itself, so that sound and scrambled words may stand
    in one text. Of the piece and what up to three steps make of it, the cheapest wins: two for
    each scrambled sequence or unlikely character, one a step; ties to fewer steps. Texts
    without a scrambled sequence (null, empty, ASCII, most others) are not taken apart.
    """
    def cheapest(*chain: Column) -> Column:
        priced = F.array(*[F.when(c.isNotNull(), F.struct((2 * badness(c) + i).alias("cost"), F.lit(i).alias("steps"), c.alias("text"))) for i, c in enumerate(chain)])
        return F.array_min(F.filter(priced, lambda x: x.isNotNull()))["text"]

    def piece(a: Column) -> Column:
        return F.when(as_bytes(a).rlike(_SCRAMBLED), let(reread(a), lambda b: let(reread(b), lambda c: let(reread(c), lambda d: cheapest(a, b, c, d))))).otherwise(a)

    pieces = F.split(F.when(as_bytes(text).rlike(_SCRAMBLED), text), r"(?<=[ \t\n\r])")
    return F.coalesce(F.array_join(F.transform(pieces, piece), ""), text)


def hinglish(text: Column) -> tuple[Column, Column]:
    """The share of Hindi words among the Latin ones (null without any), and whether there are any."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    counts = let(ws, lambda w: F.struct(of_words(w, S.HINDI_WORDS).alias("hindi"), F.size(w).alias("n")))
    return F.try_divide(counts["hindi"], counts["n"]), counts["n"] > 0


def review_language(text: Column) -> Column:
    """HINGLISH where over a fifth of the Latin words are Hindi, HI in an Indian script, EN where English function words are a tenth of the words, else OTHER."""
    def latin(ws: Column) -> Column:
        n = F.size(ws)
        return F.when(n == 0, "OTHER").when(of_words(ws, S.HINDI_WORDS) / n > 0.2, "HINGLISH").when(of_words(ws, S.ENGLISH_WORDS) / n >= 0.1, "EN").otherwise("OTHER")

    indian = F.coalesce(text, F.lit("")).rlike(r"[\x{900}-\x{D7F}]")
    return F.when(indian, "HI").otherwise(let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), latin))


def text_key(text: Column) -> Column:
    """MD5 of the lower-case text without blanks: equal for exact copies."""
    return F.md5(F.replace(F.lower(text), F.lit(" "), F.lit("")))


def expanded(text: Column) -> Column:
    for short, long in S.ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", long)
    return text


def normalized(text: Column) -> Column:
    """Shouted words in title case, repeated punctuation and letters shortened, tags and extra blanks gone."""
    def word(w: Column) -> Column:
        alone = F.regexp_replace(w, r"[^\p{L}]", "")
        return F.when((F.length(alone) > 1) & (F.upper(alone) == alone) & (F.lower(alone) != alone) & ~w.startswith("["), F.initcap(w)).otherwise(w)

    text = F.array_join(F.transform(F.split(F.trim(one_space(text)), " "), word), " ")
    return squeezed(text)


def squeezed(text: Column) -> Column:
    text = F.regexp_replace(text, r"([!?.])\1+", "$1")
    text = F.regexp_replace(text, r"([a-zA-Z])\1{2,}", "$1$1")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    return F.trim(one_space(text))


def quality_score(text: Column, product_terms: list[str] = S.PRODUCT_TERMS, personal_terms: list[str] = S.PERSONAL_TERMS) -> Column:
    """0 for blank text, 15 for tags alone, 10 under five words, else 50 to 80 by length plus 10 for product and for personal terms."""
    def score(plain: Column) -> Column:
        has = lambda terms: F.arrays_overlap(words(plain), literal_array(terms))
        # a text without blanks to part at is one word, or none
        n = F.when(plain == "", 0).otherwise(1 + F.length(plain) - F.length(F.translate(plain, " ", "")))
        bonus = lambda: F.when(has(product_terms), 10).otherwise(0) + F.when(has(personal_terms), 10).otherwise(0)
        return let(n, lambda n: F.when(n == 0, 15).when(n < 5, 10).otherwise(F.least(F.lit(100), F.ceil(F.when(n >= 20, 80.0).otherwise(50 + n * 1.5) + bonus()))).cast("int"))

    plain = F.trim(one_space(F.regexp_replace(text, r"\[[^\]]*\]", " ")))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0).otherwise(let(plain, score))


def local_sentiment(text: Column, rating: Column, negative: list[str] = S.NEGATIVE_WORDS, positive: list[str] = S.POSITIVE_WORDS) -> Column:
    """By the rating where there is one, else by which list has more of its terms in the text."""
    more = let(F.lower(F.coalesce(text, F.lit(""))), lambda t: hits(t, positive) - hits(t, negative))
    by_words = let(more, lambda m: F.when(m < 0, "negative").when(m > 0, "positive").otherwise("neutral"))
    return F.when(rating >= 4, "positive").when(rating <= 2, "negative").when(rating.isNotNull(), "neutral").otherwise(by_words)


def upper_ratio(text: Column) -> Column:
    """Share of the letters that are upper case, 0 without letters."""
    return let(F.regexp_replace(text, r"[^\p{L}]+", ""), lambda x: F.when(x != "", 1 - F.length(F.regexp_replace(x, r"\p{Lu}+", "")) / F.length(x)).otherwise(0.0))


def shouted(terms: list[str]) -> list[str]:
    return [t for t in terms if t.upper() == t and t.lower() != t and len(t) > 2]


def emotion(text: Column, sentiment: Column, emotions=None) -> Column:
    """struct(emotion, confidence, urgency, raw_score).

    Shouted signals are looked for as they are, the others in the lower-case text. The
    lower-case text, the share of capitals, the counts and the scores are made once each.
    """
    emotions = emotions or S.EMOTIONS
    names = [e[0] for e in emotions]

    def counted(low: Column) -> Column:
        return F.array(*[hits(text, shouted(e[5])) + hits(low, [t.lower() for t in e[5] if t not in shouted(e[5])]) for e in emotions])

    def result(x: Column) -> Column:
        counts, loud = x["counts"], x["up"] > 0.6
        count = lambda name: counts[names.index(name)]
        return let(F.array(*[counts[i] * e[1] + (F.when(loud, 30).otherwise(0) if e[0] == "furious" else 0) for i, e in enumerate(emotions)]), lambda scores: chosen(scores, (count("furious") >= 2) | loud | (count("delighted") >= 3)))

    def chosen(scores: Column, sure: Column) -> Column:
        total, best = F.aggregate(scores, F.lit(0), lambda a, v: a + v), F.array_max(scores)
        share = F.least(F.lit(0.95), best / total)
        share = F.when(sure, F.greatest(share, F.lit(0.85))).otherwise(share)
        fallback = F.coalesce(F.create_map(*[F.lit(x) for kv in S.SENTIMENT_EMOTION.items() for x in kv])[sentiment], F.lit("neutral"))
        first = F.element_at(literal_array(names), F.array_position(scores, best).cast("int"))
        return let(total, lambda t: F.struct(F.when(t == 0, fallback).otherwise(first).alias("name"), F.when(t == 0, 0.3).otherwise(F.round(share, 2)).alias("conf")))

    def labelled(x: Column) -> Column:
        of = lambda values: F.element_at(F.create_map(*[F.lit(v) for n, value in zip(names, values) for v in (n, value)]), x["name"])
        return F.struct(x["name"].alias("emotion"), x["conf"].alias("confidence"), of([e[2] for e in emotions]).alias("urgency"), of([e[3] + (e[4] - e[3]) // 2 for e in emotions]).alias("raw_score"))

    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    seen = let(F.lower(text), lambda low: F.struct(counted(low).alias("counts"), upper_ratio(text).alias("up")))
    return let(F.when(blank, F.struct(F.lit("neutral").alias("name"), F.lit(0.5).alias("conf"))).otherwise(let(seen, result)), labelled)


def sarcasm(text: Column, rules=None) -> Column:
    """struct(flags, confidence): each rule that matches adds its weight, at most 0.7."""
    rules = rules or S.SARCASM_RULES
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(float(w)).alias("weight"), text.rlike(p).alias("on")) for f, p, w in rules]), lambda r: r["on"])
    total = lambda rs: F.least(F.lit(0.7), F.round(F.aggregate(rs, F.lit(0.0), lambda a, r: a + r["weight"]), 2))
    return let(found, lambda rs: F.struct(F.array_join(F.transform(rs, lambda r: r["flag"]), ",").alias("flags"), total(rs).alias("confidence")))


def bot_signals(text: Column, rating: Column, username: Column, verified: Column | None = None) -> Column:
    """Signals of one review by itself, as an array of struct(signal, points). ``verified``: whether the purchase was; only false, or the text False, tells."""
    ws = words(text)
    n = F.size(ws)
    diversity = F.size(F.array_distinct(ws)) / n
    mismatch = ((rating >= 4) & (of_words(ws, S.BOT_NEGATIVE) > 3)) | ((rating <= 2) & (of_words(ws, S.BOT_POSITIVE) > 3))
    item = lambda when, name, points: F.when(when, F.struct(F.lit(name).alias("signal"), F.lit(points).alias("points")))
    return F.array_compact(F.array(
        item(F.coalesce(mismatch, F.lit(False)), "RATING_SENTIMENT_MISMATCH", 20),
        item((n > 0) & (diversity < 0.4), "LOW_LEXICAL_DIVERSITY", 20), item((n > 0) & (diversity >= 0.4) & (diversity <= 0.6), "SUSPICIOUS_LEXICAL_DIVERSITY", 10),
        item(n < 5, "TOO_SHORT", 15), item((n >= 5) & (of_words(ws, S.BOT_GENERIC) >= 5) & (of_words(ws, S.BOT_SPECIFIC) == 0), "GENERIC_PRAISE", 20),
        item(F.coalesce(username.rlike(r"(?i)^user_?\d+$"), F.lit(False)), "AUTO_GENERATED_USERNAME", 15),
        *([] if verified is None else [item(F.coalesce(verified.cast("string").isin("false", "False"), F.lit(False)), "UNVERIFIED_PURCHASE", 10)]),
    ))


def bot_status(score: Column) -> Column:
    return F.when(score <= 25, "TRUSTED").when(score <= 50, "LOW_SUSPICION").when(score <= 75, "HIGH_SUSPICION").otherwise("CONFIRMED_BOT")


#: Pictographs, and what may follow one: a variation selector and skin tones.
EMOJI, EMOJI_STYLE = r"[\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}]", r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]+"


def emoji_tags(text: Column) -> Column:
    """struct(text, tags): emojis as tags between blanks, and the distinct tags in order.

    Variants and skin tones count as the plain emoji. The fixed map first; any other by its Unicode name, which only rows that hold one
    pay for, in an Arrow batch.
    """
    @F.pandas_udf("string")
    def named(texts: pd.Series) -> pd.Series:
        import re
        import unicodedata

        one = re.compile("[\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff]")
        return texts.map(lambda t: one.sub(lambda m: f" [{unicodedata.name(m[0][0], 'EMOJI')}] ", t), na_action="ignore")

    # few texts have an emoji; only these are looked through for each one
    some = text.rlike("|".join([EMOJI, EMOJI_STYLE, "[" + "".join(sorted({rf"\x{{{ord(k[0]):X}}}" for k in S.EMOJI_TAGS})) + "]"]))
    known = F.when(some, emojis_to_tags(F.regexp_replace(text, EMOJI_STYLE, ""))).otherwise(text)
    done = F.coalesce(named(F.when(some & known.rlike(EMOJI), known)), known)
    return let(F.trim(one_space(done)), lambda t: F.struct(t.alias("text"), F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[[\p{Lu}\p{N}][\p{Lu}\p{N} \-]*\]"), F.lit(0))).alias("tags")))


def title_case(word: Column) -> Column:
    """Every run of letters with a capital first letter, the others small."""
    return F.array_join(F.transform(F.regexp_extract_all(word, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def is_shouted(word: Column) -> Column:
    return word.rlike(r"\p{L}.*\p{L}") & ~word.rlike(r"[^\p{Lu}\P{L}]")


#: Between blanks, two capitals and no other letter.
MAY_SHOUT = r"(?<![^ ])(?:[^\p{L} ]*+\p{Lu}){2,}+[^\p{L} ]*+(?![^ ])"


def calmed(text: Column) -> Column:
    """struct(text, caps): shouted words in title case, and whether there were any; then as ``squeezed``."""
    def of(ws: Column) -> Column:
        return F.struct(squeezed(F.array_join(F.transform(ws, lambda w: F.when(is_shouted(w), title_case(w)).otherwise(w)), " ")).alias("text"), F.exists(ws, is_shouted).alias("caps"))

    def result(plain: Column) -> Column:
        # only what may hold a shouted word is taken apart
        return F.when(plain.rlike(MAY_SHOUT), let(F.split(plain, " "), of)).when(plain.isNotNull(), F.struct(squeezed(plain).alias("text"), F.lit(False).alias("caps")))

    return let(F.trim(one_space(text)), result)


def word_facts(text: Column, product_terms: list[str] = S.PRODUCT_TERMS, personal_terms: list[str] = S.PERSONAL_TERMS) -> Column:
    """struct(n, product, personal): the number of words outside brackets, and whether there are product and personal terms."""
    n = F.size(F.filter(F.split(F.trim(one_space(text)), " "), lambda w: (w != "") & ~w.startswith("[")))
    has = lambda ws, terms: F.arrays_overlap(ws, literal_array(terms))
    return let(words(text), lambda ws: F.struct(n.alias("n"), has(ws, product_terms).alias("product"), has(ws, personal_terms).alias("personal")))


def flags_of(facts: Column, tags: Column) -> Column:
    lacks = lambda term, flag: F.when(~facts[term], flag)
    terms = F.array_compact(F.array(lacks("product", "no_product_terms"), lacks("personal", "no_personal_experience")))
    return F.when((facts["n"] == 0) & (F.size(tags) > 0), F.array(F.lit("only_emojis"))).when(facts["n"] < 5, F.array(F.lit("too_short"))).otherwise(terms)


def score_of(facts: Column, tags: Column) -> Column:
    n, bonus = facts["n"], F.when(facts["product"], 10).otherwise(0) + F.when(facts["personal"], 10).otherwise(0)
    return F.when((n == 0) & (F.size(tags) > 0), 15).when(n < 5, 10).otherwise(F.least(F.lit(100), F.ceil(F.when(n >= 20, 80.0).otherwise(50 + n * 1.5) + bonus))).cast("int")


def quality_flags(text: Column, tags: Column, product_terms: list[str] = S.PRODUCT_TERMS, personal_terms: list[str] = S.PERSONAL_TERMS) -> Column:
    """What lowers a text's quality: only_emojis, too_short, or missing product or personal terms; words in brackets do not count."""
    return let(word_facts(text, product_terms, personal_terms), lambda facts: flags_of(facts, tags))


def word_score(text: Column, tags: Column, product_terms: list[str] = S.PRODUCT_TERMS, personal_terms: list[str] = S.PERSONAL_TERMS) -> Column:
    """0 to 100 by the number of words outside brackets and by product and personal terms."""
    return let(word_facts(text, product_terms, personal_terms), lambda facts: score_of(facts, tags))


def preprocess(reviews: DataFrame, text: str = "review_text", translate=None) -> DataFrame:
    """``reviews`` with clean_text, language, emoji_tags, caps_intensity, quality_score, low_quality, flags, trust_score.

    Repair, emojis, language, normal form and score, one after the other. ``translate``
    takes the column of a text that is not English; by default texts stay. A null or blank
    text is empty, of quality 0, language EN, flagged empty_text.
    """
    c = F.col
    out = reviews.withColumn("__t", F.when(F.trim(one_space(c(text))) != "", c(text)))
    out = out.withColumn("__r", descrambled(c("__t"))).withColumn("__e", emoji_tags(repaired(composed(c("__r"))))).withColumn("__l", F.when(c("__t").isNull(), "EN").otherwise(review_language(c("__e.text"))))
    known = F.when(c("__l") != "EN", translate(c("__e.text"))).otherwise(c("__e.text")) if translate else c("__e.text")
    out = out.withColumn("__n", calmed(known)).withColumn("__tags", F.coalesce("__e.tags", F.array().cast("array<string>")))
    blank = c("__t").isNull()
    out = out.withColumn("__w", word_facts(c("__n.text")))
    out = out.withColumns({
        "clean_text": F.coalesce("__n.text", F.lit("")), "language": c("__l"), "emoji_tags": c("__tags"), "caps_intensity": F.coalesce("__n.caps", F.lit(False)),
        "quality_score": F.when(blank, 0).otherwise(score_of(c("__w"), c("__tags"))), "flags": F.when(blank, F.array(F.lit("empty_text"))).otherwise(flags_of(c("__w"), c("__tags"))),
    })
    return out.withColumns({"low_quality": c("quality_score") < 20, "trust_score": c("quality_score") / 100}).drop("__t", "__r", "__e", "__l", "__n", "__tags", "__w")


def sarcasm_decision(text: Column, confidence: Column, sentiment: Column, second_pass: Column | None = None) -> Column:
    """struct(flagged, needs_check, sarcastic, human_review, sentiment) from the rules and a second pass.

    A text is checked again if a rule matches, its sentiment is unsure (under 0.6) or mixed.
    ``second_pass`` says what a model finds; without one a checked text goes to a human. Sarcastic
    is what the model or rules of over 0.5 say; such a review becomes ambiguous.
    """
    def decide(s: Column) -> Column:
        flagged = F.coalesce(s["flags"] != "", F.lit(False))
        check = flagged | (F.coalesce(confidence, F.lit(1.0)) < 0.6) | F.coalesce(sentiment == "mixed", F.lit(False))
        found = F.coalesce(second_pass, F.lit(False)) if second_pass is not None else F.lit(False)
        sarcastic = check & (found | F.coalesce(s["confidence"] > 0.5, F.lit(False)))
        human = sarcastic | check if second_pass is None else sarcastic
        return F.struct(flagged.alias("flagged"), check.alias("needs_check"), sarcastic.alias("sarcastic"), human.alias("human_review"), F.when(sarcastic, "ambiguous").otherwise(sentiment).alias("sentiment"))

    return let(sarcasm(text), decide)


def needs_second_layer(confidence: Column) -> Column:
    """Whether an emotion of this confidence is put to a model, where one is at hand."""
    return (confidence >= 0.4) & (confidence <= 0.65)
