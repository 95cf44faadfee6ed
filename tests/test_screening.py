"""The flagship's retrieval and full score against a plain version over every pair of some 300 names."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy, text
from tessera.operators import screening as S

FIRST = "MARIA IVAN OSCAR LUCIA HENRI PAULA DIANA BORIS FELIX GRETA".split()
LAST = "PETROV GARCIA MULLER ROSSI NOVAK KELLER MORENO LAURENT FISCHER DUBOIS HASSAN OKAFOR".split()


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    names = []
    for i in range(300):
        parts = [rng.choice(FIRST), rng.choice(FIRST + LAST), rng.choice(LAST)][rng.randrange(2):]
        names.append((i, i // 3, " ".join(parts), rng.choice(["1960-05-01", None]), rng.choice([1960, 1990]), rng.choice(["Iran", "Cuba", None]), rng.choice([f"id{i}", None]), rng.choice(["Individual", "Entity", None]), rng.random() < 0.2))
    asked = [(1000 + k, text_, "1960-05-01" if k % 3 else None, ["Iran ", "", None][k % 3], f"ID{3 * k}" if k % 4 == 0 else None, ["individual", "entity", None][k % 3])
             for k, text_ in enumerate([*[" ".join(reversed(n[2].split())) for n in names[:20]], *[n[2][:-1] + "X" for n in names[20:40]], "", "ZZZ QQQ"])]
    n = spark.createDataFrame(names, "name_id long, entity_id long, raw string, born string, year int, nation string, ident string, sdn_type string, weak boolean")
    n = text.with_name(n, F.col("raw")).withColumns({
        "phonetic": fuzzy.phonetic_keys("tokens"), "embedding": S.hashed_embedding(F.col("normalized")), "is_active": F.lit(True), "dobs": F.array_compact(F.array(F.to_date("born"))),
        "dob_years": F.array("year"), "nationalities": F.array_compact(F.array("nation")), "id_numbers": F.array_compact(F.array("ident"))})
    q = text.with_name(spark.createDataFrame(asked, "query_id long, raw string, born string, nationality string, id_number string, query_type string"), F.col("raw"))
    q = q.withColumns({"phonetic": fuzzy.phonetic_keys("tokens"), "embedding": S.hashed_embedding(F.col("normalized")), "birth": F.to_date("born")})
    return q.cache(), n.cache()


def plain_scores(queries, names):
    """(query, name) -> (methods, score) by every pair."""
    count, held = {}, {n.name_id: set(n.tokens) for n in names}
    for n in names:
        for t in n.tokens:
            count[t] = count.get(t, 0) + 1
    idf = {t: math.log(len(names) / k) for t, k in count.items()}
    grams = lambda s: {("  " + w + " ")[i:i + 3] for w in s.lower().split() for i in range(len(w) + 1)}
    out = {}
    for q in queries:
        own, g = list(dict.fromkeys(q.tokens)), grams(q.normalized)
        block = [t for t in own if idf.get(t, 99.0) >= 2.0] or own
        best = lambda found: [i for _, i in sorted(found)[:50]]
        by = {
            "token": best([(-round(sum(idf.get(t, 1.0) for t in own if t in held[n.name_id]), 9), n.name_id) for n in names if held[n.name_id] & set(block)]),
            "trigram": best([(-len(g & grams(n.normalized)) / len(g | grams(n.normalized)), n.name_id) for n in names if g and len(g & grams(n.normalized)) / len(g | grams(n.normalized)) >= 0.35]),
            "vector": best([(d, n.name_id) for n in names if q.embedding and (d := 1 - float(np.array(q.embedding, float) @ np.array(n.embedding, float) / np.linalg.norm(q.embedding) / np.linalg.norm(n.embedding))) < 0.35]),
            "phonetic": best([(n.name_id, n.name_id) for n in names if len(q.tokens) <= 2 and set(q.phonetic) & set(n.phonetic)]),
        }
        for n in names:
            methods = sorted(m for m, ids in by.items() if n.name_id in ids)
            if not methods:
                continue
            cosine = 100 * max(0.0, min(1.0, float(np.array(q.embedding, float) @ np.array(n.embedding, float))))
            score = 0.35 * fuzzy.token_set(q.normalized, n.normalized) + 0.25 * fuzzy.token_sort(q.normalized, n.normalized) + 0.25 * 100 * fuzzy.jaro_winkler(q.sorted_key, " ".join(sorted(n.tokens))) + 0.15 * cosine
            score -= min(25, 8 * sum(t not in n.tokens for t in q.tokens if idf.get(t, 0) > 2.0))
            if q.id_number and q.id_number.strip().upper() in {i.strip().upper() for i in n.id_numbers}:
                out[q.query_id, n.name_id] = (methods, 100.0)
                continue
            if q.birth:
                score += 10 if q.birth in n.dobs else 5 if q.birth.year in n.dob_years else -25 if min(abs(q.birth.year - y) for y in n.dob_years) > 2 else 0
            if q.nationality and n.nationalities:
                score += 5 if q.nationality.strip().lower() in {x.strip().lower() for x in n.nationalities} else -10
            if q.query_type and n.sdn_type and (q.query_type == "individual") != (n.sdn_type == "Individual"):
                score -= 30
            out[q.query_id, n.name_id] = (methods, max(0.0, min(100.0, min(score, 80.0) if n.weak else score)))
    return out


def test_scores_of_every_candidate(world):
    queries, names = world
    stats = S.token_stats(names)
    got = {(r.query_id, r.name_id): (list(r.methods), r.score) for r in S.scored(S.candidates(queries, names, stats), queries, names, stats).collect()}
    want = plain_scores(queries.collect(), names.collect())
    assert {k: m for k, (m, _) in got.items()} == {k: m for k, (m, _) in want.items()}
    assert all(abs(got[k][1] - s) < 0.006 for k, (_, s) in want.items()) and len(want) > 300


def test_ratios_in_batches(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABCDE") for _ in range(rng.randrange(0, 9)))
    rows = [(" ".join(word() for _ in range(rng.randrange(0, 5))), " ".join(word() for _ in range(rng.randrange(0, 5)))) for _ in range(400)]
    rows += [("", ""), ("A", ""), ("A" * 64, "A" * 63 + "B"), ("AB" * 50, "BA" * 50), ("ÄÖ X", "ÄO X"), ("A  B", "B A"), (None, "A")] + rows[:5]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", fuzzy.indel_ratio("a", "b").alias("i"), fuzzy.jaro_winkler_ratio("a", "b").alias("j"), fuzzy.token_sort_ratio("a", "b").alias("s"), fuzzy.token_set_ratio("a", "b").alias("t")).collect()
    for r in got:
        want = (None,) * 4 if r.a is None else (fuzzy.indel(r.a, r.b), 100 * fuzzy.jaro_winkler(r.a, r.b), fuzzy.token_sort(r.a, r.b), fuzzy.token_set(r.a, r.b))
        assert all(x is y is None or abs(x - y) < 1e-9 for x, y in zip((r.i, r.j, r.s, r.t), want)), (r, want)


def test_names_of_every_script(spark):
    raw = {"王小明": "王小明", "דוד כהן": "DVD KHN", "राम कुमार": "RAAMA KUMAARA", "შოთა": "SHOTA", "Αθήνα": "ATHINA", "Иван Петров": "IVAN PETROV", "Արամ": "ARAM", "김철수": "GIMCHEOLSU", "Þór Æsir": "THOR AESIR", "Dr. A-B 12": "A B 12"}
    got = text.with_name(spark.createDataFrame([(r,) for r in raw], "raw string"), F.col("raw")).collect()
    assert {r.raw: r.normalized for r in got} == raw


def test_casefolded(spark):
    from tessera.functions import secrecy

    words = ["Straße", "ΟΔΟΣ", "ﬁx", "İI", "ılık", "ſ", "µ"] + [chr(i) for i in range(0x21, 0x2000) if chr(i).isprintable() and not 0x13A0 <= i <= 0x13FF and not 0x1C80 <= i <= 0x1C8F]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrecy.casefolded(F.col("w")).alias("f")).collect()
    assert [(r.w, r.f) for r in got if r.f != r.w.casefold()] == []
