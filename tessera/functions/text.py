"""Name normalisation as column expressions; every step stays in the JVM.

Null and empty names give an empty normal form without tokens. The same functions serve corpus and queries.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Honorifics to drop.
HONORIFICS = (
    "MR", "MRS", "MS", "MISS", "DR", "PROF", "SIR", "MADAM", "SHEIKH", "SHEIK", "HAJI", "HAJJI", "GENERAL", "GEN", "COLONEL", "COL", "CAPTAIN", "CAPT",
    "IMAM", "MULLAH", "AYATOLLAH", "ENGINEER", "ENG", "HAJJ",
)
# Legal forms that all stand for one token.
LEGAL_FORMS = (
    "LLC", "LTD", "LIMITED", "CO", "COMPANY", "CORP", "CORPORATION", "INC", "INCORPORATED", "JSC", "OOO", "ZAO", "SA", "GMBH", "PLC", "BV", "AG", "FZE", "FZCO",
)
LEGAL_TOKEN = "SUFFIXCORP"
# Spellings of one name.
SPELLINGS = {
    "MOHAMMED": "MOHAMMAD", "MUHAMMAD": "MOHAMMAD", "MOHAMAD": "MOHAMMAD", "MUHAMMED": "MOHAMMAD", "MOHAMED": "MOHAMMAD", "MAHOMET": "MOHAMMAD",
    "ABDUL": "ABD", "YUSUF": "YOUSEF", "YOUSSEF": "YOUSEF", "YOUSIF": "YOUSEF", "HUSSEIN": "HUSSAIN", "HUSAIN": "HUSSAIN", "HUSSAYN": "HUSSAIN",
    "IBRAHIM": "IBRAHIM", "EBRAHIM": "IBRAHIM", "OSAMA": "USAMA", "USAMAH": "USAMA",
}
#: Latin letters that stand for two, with no decomposition of their own.
DIGRAPHS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ĳ": "IJ", "ĳ": "ij"}
STROKES = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ŧ": "T", "ŧ": "t"}
# Plain romanisations of other scripts, letter by letter; "-" stands for nothing.
GREEK = dict(zip("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "A B G D E Z I Th I K L M N X O P R S T Y F Ch Ps O".split()))
CYRILLIC = dict(zip("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "A B V G D E E Zh Z I I K L M N O P R S T U F Kh Ts Ch Sh Shch - Y - E Iu Ia".split()))
ARABIC = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآ", "a b t th j h kh d dh r z s sh s d t z ' gh f q k l m n h w y h a ' a i a".split()))
HEBREW = dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "a b g d h v z h t y k k l m m n n s a p p ts ts q r sh t".split()))
GEORGIAN = dict(zip("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h".split()))
ARMENIAN = dict(zip("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "a b g d e z e y t zh i l kh ts k h dz gh ch m y n sh o ch p j r s v t r ts w p k o f".split()))


def by_names(low: int, high: int, script: str) -> dict[str, str]:
    """Romanisation of an Indic block by Unicode's own names: consonants bring an A, signs replace it, a virama ends it."""
    out = {}
    for code in range(low, high):
        words = unicodedata.name(chr(code), "").split()
        if words[:1] == [script] and "LETTER" in words:
            out[chr(code)] = words[-1].lower()
        elif words[:1] == [script] and words[1:3] == ["VOWEL", "SIGN"]:
            out[chr(code)] = "\b" + words[-1].lower()
        elif words[:1] == [script] and words[1:] == ["SIGN", "VIRAMA"]:
            out[chr(code)] = "\b"
        elif words[:1] == [script] and words[1:] in (["SIGN", "ANUSVARA"], ["SIGN", "CANDRABINDU"]):
            out[chr(code)] = "n"
        elif words[:1] == [script] and words[1:] == ["SIGN", "VISARGA"]:
            out[chr(code)] = "h"
    return out


# The parts of a Hangul syllable, first consonants, vowels and last consonants in Unicode's order; "-" stands for nothing.
HANGUL_FIRST = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
HANGUL_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
HANGUL_LAST = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split()


SYLLABLES = ("가", "힣")


def hangul(ch: Column) -> Column:
    """A Hangul syllable romanised, by the arithmetic of its code point."""
    at, ends = F.ascii(ch) - ord(SYLLABLES[0]), len(HANGUL_LAST)
    part = lambda side, place: F.element_at(F.array(*[F.lit("" if p == "-" else p) for p in side]), place.cast("int") + 1)
    first, vowel = F.floor(at / (ends * len(HANGUL_VOWEL))), F.floor(at / ends) % len(HANGUL_VOWEL)
    return F.concat(part(HANGUL_FIRST, first), part(HANGUL_VOWEL, vowel), part(HANGUL_LAST, at % ends))


def hangul_sql(ch: str) -> str:
    """A Hangul syllable romanised, by the arithmetic of its code point."""
    places = (f"div {28 * len(HANGUL_VOWEL)}", f"% {28 * len(HANGUL_VOWEL)} div 28", "% 28")
    part = lambda side, place: f"element_at(array({', '.join(quoted('' if p == '-' else p) for p in side)}), CAST((ascii({ch}) - {0xAC00}) {place} AS INT) + 1)"
    return f"concat({', '.join(map(part, (HANGUL_FIRST, HANGUL_VOWEL, HANGUL_LAST), places))})"


def letter_table() -> dict[str, str]:
    """Every letter that is romanised on its own; Han characters stay as they are, Hangul syllables need no table."""
    out = {**ARABIC, **HEBREW, **GEORGIAN}
    for upper in (GREEK, CYRILLIC, {k.upper(): v.capitalize() for k, v in ARMENIAN.items()}):
        out |= upper | {k.lower(): v.lower() for k, v in upper.items()}
    out |= {"ς": "s", "և": "ev"}
    for low, script in ((0x900, "DEVANAGARI"), (0x980, "BENGALI"), (0xA00, "GURMUKHI"), (0xA80, "GUJARATI"), (0xB00, "ORIYA"), (0xB80, "TAMIL"), (0xC00, "TELUGU"), (0xC80, "KANNADA"), (0xD00, "MALAYALAM")):
        out |= by_names(low, low + 0x80, script)
    for code in range(0x370, 0x530):  # letters with accents
        out.setdefault(chr(code), out.get(unicodedata.normalize("NFD", chr(code))[:1], chr(code)))
    return {k: "" if v == "-" else v for k, v in out.items() if k != v}


def latin_table() -> tuple[str, str]:
    """Letters of the Latin blocks and what they are without marks, from Unicode's decompositions."""
    pairs = dict(STROKES)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[:1]
        if base.isascii() and base.isalpha() and chr(code) not in DIGRAPHS:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def strip_accents(c: Column) -> Column:
    """Latin letters without marks; combining marks go; other scripts stay."""
    source, target = latin_table()
    out = F.regexp_replace(F.translate(c, source, target), "[\\u0300-\\u036f]", "")
    for letter, pair in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def to_ascii(c: Column) -> Column:
    """strip_accents, then the letters of other alphabets romanised; letters without a table stay, other signs beyond ASCII go.

    Plain text passes both tests untouched; only what is left after the Latin letters is looked up letter by letter.
    """
    beyond = "[^\\x00-\\x7f]"
    latin = strip_accents(c)
    table = F.from_json(F.lit(json.dumps(letter_table())), "map<string,string>")  # one constant, not two thousand
    letters = F.array_join(F.transform(F.split(latin, ""), lambda ch: F.when(ch.rlike(beyond), F.when(ch.between(*SYLLABLES), hangul(ch)).otherwise(F.coalesce(F.try_element_at(table, ch), ch))).otherwise(ch)), "")
    # a sign that replaces the A before it
    joined = F.regexp_replace(letters, "a?\b", "")
    rest = F.regexp_replace(joined, "[^\\x00-\\x7f\\p{L}\\p{N}]", "")
    return F.when(c.rlike(beyond), F.when(latin.rlike(beyond), rest).otherwise(latin)).otherwise(c)


def cleaned(c: Column) -> Column:
    """Upper case, full stops dropped, other marks blank, blanks squeezed and trimmed; `_` and letters of any script stay."""
    t = F.replace(F.upper(F.lower(F.coalesce(c, F.lit("")))), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^\\w\\s\\p{L}\\p{N}]", " "), "\\s+", " "))


def name_tokens(c: Column) -> Column:
    """Tokens of a cleaned name: honorifics go, legal forms and spellings are mapped; duplicates stay."""
    forms = {**{f: LEGAL_TOKEN for f in LEGAL_FORMS}, **SPELLINGS}
    table = F.from_json(F.lit(json.dumps(forms)), "map<string,string>")
    kept = F.filter(F.split(c, " "), lambda t: (t != "") & ~t.isin(*HONORIFICS))
    return F.transform(kept, lambda t: F.coalesce(F.try_element_at(table, t), t))


def normalized(c: Column, transliterate: bool = True) -> Column:
    """struct(normalized, tokens, sorted_key) of a raw name."""
    tokens = name_tokens(cleaned(to_ascii(c) if transliterate else c))
    return F.struct(F.array_join(tokens, " ").alias("normalized"), tokens.alias("tokens"), F.array_join(F.array_sort(tokens), " ").alias("sorted_key"))


def with_name(df: DataFrame, c: Column, transliterate: bool = True) -> DataFrame:
    """df with tokens, normalized and sorted_key of the raw name c; the name is read once, however many of them are used."""
    tokens = name_tokens(cleaned(to_ascii(c) if transliterate else c))
    return df.select("*", F.explode(F.array(tokens)).alias("tokens")).withColumns({"normalized": F.array_join("tokens", " "), "sorted_key": F.array_join(F.array_sort("tokens"), " ")})


def trigrams(c: Column) -> Column:
    """The set of trigrams of lower-case words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two names; 0 when neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_functions() -> list[str]:
    """normalized() and trigram_similarity() as SQL functions, from the same tables; each is inlined, so it stays in the JVM."""
    source, target = latin_table()
    latin = f"regexp_replace(translate(name, {quoted(source)}, {quoted(target)}), '[\\\\u0300-\\\\u036f]', '')"
    for letter, pair in DIGRAPHS.items():
        latin = f"replace({latin}, {quoted(letter)}, {quoted(pair)})"
    table = lambda t: f"from_json({quoted(json.dumps(t))}, 'map<string,string>')"
    forms = {**{f: LEGAL_TOKEN for f in LEGAL_FORMS}, **SPELLINGS}
    beyond = quoted("[^\\x00-\\x7f]")
    letters = f"transform(split(name, ''), ch -> if(ch RLIKE {beyond}, if(ch BETWEEN '{SYLLABLES[0]}' AND '{SYLLABLES[1]}', {hangul_sql('ch')}, coalesce(try_element_at({table(letter_table())}, ch), ch)), ch))"
    joined = f"regexp_replace(array_join({letters}, ''), {quoted('a?' + chr(8))}, '')"
    upper = "replace(upper(lower(coalesce(name, ''))), '.', '')"
    plain = f"trim(regexp_replace(regexp_replace({upper}, {quoted('[^\\w\\s\\p{L}\\p{N}]')}, ' '), {quoted('\\s+')}, ' '))"
    honorifics = ", ".join(map(quoted, HONORIFICS))
    words = f"filter(split(lower(coalesce(name, '')), '[^a-z0-9]+'), w -> w <> '')"
    grams = f"array_distinct(flatten(transform(transform({words}, w -> concat('  ', w, ' ')), p -> transform(sequence(1, length(p) - 2), i -> substr(p, i, 3)))))"
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}" for head, body in (
        ("tessera_latin(name STRING) RETURNS STRING", latin),
        ("tessera_letters(name STRING) RETURNS STRING", f"if(name RLIKE {beyond}, regexp_replace({joined}, {quoted('[^\\x00-\\x7f\\p{L}\\p{N}]')}, ''), name)"),
        ("tessera_cleaned(name STRING) RETURNS STRING", plain),
        ("tessera_tokens(name STRING) RETURNS ARRAY<STRING>", f"transform(filter(split(name, ' '), t -> t <> '' AND t NOT IN ({honorifics})), t -> coalesce(try_element_at({table(forms)}, t), t))"),
        ("normalize_name(name STRING) RETURNS STRING", "array_join(tessera_tokens(tessera_cleaned(tessera_letters(tessera_latin(name)))), ' ')"),
        ("tessera_trigrams(name STRING) RETURNS ARRAY<STRING>", grams),
        ("tessera_overlap(both INT, a INT, b INT) RETURNS DOUBLE", "if(a + b > both, both / (a + b - both), 0D)"),
        ("trigram_similarity(a STRING, b STRING) RETURNS DOUBLE",
         "tessera_overlap(size(array_intersect(tessera_trigrams(a), tessera_trigrams(b))), size(tessera_trigrams(a)), size(tessera_trigrams(b)))"),
    )]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clamped_dot(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def parse_birth(c: Column) -> Column:
    """struct(exact, year) of a free date text: day month year, else the first four digits as a year."""
    form = r"^\s*(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})\s*$"
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    part = lambda i: F.regexp_extract(c, form, i)
    month = F.array_position(months, F.lower(F.substring(part(2), 1, 3)))
    exact = F.when(c.rlike(form) & (month > 0), F.try_to_date(F.format_string("%s-%02d-%02d", part(3), month, part(1).try_cast("int")), "yyyy-MM-dd"))
    year = F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")
    return F.struct(exact.alias("exact"), F.coalesce(F.year(exact), year).alias("year"))


def mrz_date(c: Column) -> Column:
    """A YYMMDD date; years from 50 on are of the last century; impossible dates are null."""
    yy = F.substring(c, 1, 2).try_cast("int")
    year = F.when(yy >= 50, 1900 + yy).otherwise(2000 + yy)
    return F.when(c.rlike(r"^\d{6}$"), F.try_to_date(F.concat(year.cast("string"), F.substring(c, 3, 4)), "yyyyMMdd"))


def mrz_check_digit(c: Column) -> Column:
    """The weighted sum 7-3-1 of digits, letters (A is 10) and fillers, modulo 10."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda ch: F.when(ch == "<", F.lit(0)).otherwise(F.instr(F.lit(alphabet), ch) - 1)
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.aggregate(F.transform(chars, lambda ch, i: value(ch) * F.get(weights, i % 3)), F.lit(0), lambda s, x: s + x) % 10
