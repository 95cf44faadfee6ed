import hashlib
import hmac
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import fuzzy, secrecy, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_normalized_names(spark):
    cases = {
        "Müller, Dr. Jürgen": "MULLER JURGEN", "ACME Trading L.L.C.": "ACME TRADING SUFFIXCORP", "Muhammad  Yusuf": "MOHAMMAD YOUSEF", "": "", None: "", "straße": "STRASSE",
        "Иван Петров": "IVAN PETROV", "O'Brien-Smith": "O BRIEN SMITH", "S.A. Foo_Bar": "SUFFIXCORP FOO_BAR",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string").select("raw", "want", text.normalized(F.col("raw")).alias("n")).collect()
    for r in rows:
        assert r["n"]["normalized"] == r["want"], r
        assert sorted(r["n"]["tokens"]) == (r["n"]["sorted_key"].split(" ") if r["n"]["sorted_key"] else [])


def test_normalized_is_stable_on_any_text(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x600, 0x660), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").select(text.normalized(F.col("raw")).alias("n"))
    first, again = df.collect(), df.collect()
    assert first == again
    for r in first:
        assert all(t and not any(ch.isspace() for ch in t) for t in r["n"]["tokens"])


def test_birth_dates(spark):
    cases = {"19 Jun 1951": ("1951-06-19", 1951), "circa 1965": (None, 1965), "1965 to 1967": (None, 1965), "unknown": (None, None), "": (None, None), None: (None, None), "31 Feb 1970": (None, 1970), "3 September 1980": ("1980-09-03", 1980)}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", text.parse_birth(F.col("raw")).alias("b")).collect()
    assert {r["raw"]: (str(r["b"]["exact"]) if r["b"]["exact"] else None, r["b"]["year"]) for r in rows} == cases


def test_document_dates_and_check_digits(spark):
    rows = spark.createDataFrame([("490101",), ("500101",), ("991332",), ("abc",), (None,)], "d string").select(text.mrz_date(F.col("d")).alias("x")).collect()
    assert [str(r["x"]) if r["x"] else None for r in rows] == ["2049-01-01", "1950-01-01", None, None, None]
    digits = spark.createDataFrame([("L898902C3",), ("740812",), ("120415",), ("<<<",)], "d string").select(text.mrz_check_digit(F.col("d")).alias("x")).collect()
    assert [r["x"] for r in digits] == [6, 2, 9, 0]


def test_trigrams(spark):
    assert sorted(one(spark, text.trigrams(F.col("a")), a="Cat")) == ["  c", " ca", "at ", "cat"]
    assert one(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == 4 / 11
    assert one(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0.0


def naive_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_subsequence(a, b):
    assert fuzzy.common_subsequence(a, b) == naive_subsequence(a, b)
    assert 0 <= fuzzy.token_set(a, b) <= 100 and 0 <= fuzzy.token_sort(a, b) <= 100
    assert fuzzy.token_set(a, b) == fuzzy.token_set(b, a)


def test_ratios():
    assert fuzzy.token_set("MOHAMMAD ALI", "ALI MOHAMMAD HASSAN") == 100.0
    assert fuzzy.token_sort("B A", "A B") == 100.0
    assert fuzzy.token_set("", "A") == 0.0 and fuzzy.token_sort("", "") == 100.0
    assert round(fuzzy.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(fuzzy.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133
    assert fuzzy.jaro_winkler("", "") == 1.0 and fuzzy.jaro_winkler("", "A") == 0.0


def test_phonetic_codes():
    assert fuzzy.nysiis("KNIGHT") == fuzzy.nysiis("NIGHT") == "NAGT"
    assert fuzzy.nysiis("PHILLIPSON") == "FALAPSAN"
    assert fuzzy.nysiis("") == "" and fuzzy.metaphone("") == ""
    assert fuzzy.nysiis("BROWN") == fuzzy.nysiis("BROWNE")
    assert [fuzzy.metaphone(w) for w in ("THUMB", "NATION", "WHITE", "GNOME", "DODGE")] == ["0M", "NXN", "WT", "NM", "TJ"]
    assert fuzzy.metaphone("PHONE") == "FN"


def test_keyed_hash_masks_and_json(spark):
    for key in (b"k", b"x" * 80):
        assert one(spark, secrecy.hmac_sha256(key, F.col("a")), a="Ünï") == hmac.new(key, "Ünï".encode(), hashlib.sha256).hexdigest()
    assert one(spark, secrecy.blind_index(b"k", F.col("a")), a="  ABC ") == hmac.new(b"k", b"abc", hashlib.sha256).hexdigest()
    df = secrecy.masked(spark.createDataFrame([("a", "b", None)], "Full_Name string, other string, dob string"))
    assert df.first().asDict() == {"Full_Name": "***", "other": "b", "dob": "***"}
    raw = '{"b": [1, {"z": null, "a": "é"}], "a": 1.5}'
    assert one(spark, secrecy.canonical_json(F.col("a")), a=raw) == json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"))
    assert one(spark, secrecy.canonical_json(F.col("a")), a="no json") is None


def test_sql_registration(spark):
    fuzzy.register(spark)
    assert spark.sql("SELECT round(token_sort_ratio('b a', 'a b'), 1) AS x, nysiis('KNIGHT') AS n").first()["x"] == 100.0
