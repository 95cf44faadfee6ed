"""All ten functions by SQL, against their column forms and the standard library; Hangul by syllables."""

import hashlib
import hmac
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import fuzzy, text

NAMES = ["Dr. Mohammed  O'Neil-Łukasz", "ACME Trading Co., Ltd.", "Владимир Путин", "محمد علي", "Straße Æon", "김민수", "王小明", "नरेंद्र मोदी", "étoile_x", "", None, "Mr", "back\\slash 'q' \"d\"", "Καλημέρα ßs"]


def test_ten_functions(spark):
    fuzzy.register(spark)
    df = spark.createDataFrame([(n, NAMES[(i + 1) % len(NAMES)]) for i, n in enumerate(NAMES)], "a string, b string")
    both = df.select("a", "b", F.expr("normalize_name(a)").alias("sql"), text.normalized(F.col("a"))["normalized"].alias("own"),
                     F.expr("trigram_similarity(a, b)").alias("sim"), text.trigram_similarity(F.col("a"), F.col("b")).alias("own_sim"), F.expr("hmac_sha256('kéy', a)").alias("mac"), F.expr("hmac_sha256(repeat('k', 80), a)").alias("mac2"))
    for r in both.collect():
        assert r.sql == r.own and r.sim == r.own_sim, r
        for mac, key in ((r.mac, "kéy".encode()), (r.mac2, b"k" * 80)):
            assert mac == (None if r.a is None else hmac.new(key, r.a.encode(), hashlib.sha256).hexdigest())
    one = spark.sql("SELECT nysiis('KNIGHT') AS n, metaphone('KNIGHT') AS m, indel_ratio('ab', 'ab') AS i, token_sort_ratio('b a', 'a b') AS s, token_set_ratio('a b', 'b a a') AS t, "
                    "jaro_winkler('abc', 'abc') AS j, canonical_json('{\"b\": 1, \"a\": null}') AS c, trigram_similarity('', '') AS z").first()
    assert (one.i, one.s, one.t, one.j, one.c, one.z) == (100.0, 100.0, 100.0, 100.0, '{"a":null,"b":1}', 0.0) and one.n and one.m


def test_hangul(spark):
    made = {i: text.HANGUL_FIRST[(i - 0xAC00) // 588].replace("-", "") + text.HANGUL_VOWEL[(i - 0xAC00) % 588 // 28] + text.HANGUL_LAST[(i - 0xAC00) % 28].replace("-", "") for i in range(0xAC00, 0xD7A4)}
    assert len(made) == 11172 and made[ord("김")] == "gim"
    for i in (0xAC00, 0xC774, 0xD7A3):  # the order of the parts is Unicode's own
        assert unicodedata.name(chr(i)).split()[-1].lower() == made[i]
    chars = spark.createDataFrame([(i, chr(i)) for i in made], "i int, c string").select("i", text.to_ascii(F.col("c")).alias("n")).collect()
    assert {r.i: r.n for r in chars} == made
    want = {"김민수": "GIMMINSU", "한글": "HANGEUL", "서울 은행": "SEOUL EUNHAENG", "가 힣": "GA HIH", "박 Mr": "BAG"}
    got = spark.createDataFrame([(k,) for k in want], "a string").select("a", text.normalized(F.col("a"))["normalized"].alias("n")).collect()
    assert {r.a: r.n for r in got} == want
    assert spark.createDataFrame([("김민수", "김민소")], "a string, b string").select(text.trigram_similarity(text.to_ascii(F.col("a")), text.to_ascii(F.col("b")))).first()[0] > 0.4


def test_one_file_is_dealt_to_all_cores(spark, tiny):
    """Before, the customers' one file was one task."""
    from tessera.plans import catalog

    assert catalog.queries()["sql_functions"](spark, tiny).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
