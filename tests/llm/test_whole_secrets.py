"""op3: a secret that is joined to ordinary words is found, and ordinary words are not."""

import random

from tessera.llm import secret_scan

PREFIXES = ("", "com/service/user/account/", "com/example/service/handler/user/account/settings/of/the/", "my-long-")


def test_joined_secrets(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(40)]
    texts = [f"see {p}{s} now" for p in PREFIXES for s in made] + [f"x {made[0]}/the/service/for/every/user/account/and/handler/of/the/application/{made[1]} y"]
    texts += [f"{p}configuration_manager-for-every-service" for p in PREFIXES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov")] for r in secret_scan.scan_with_own_model(docs).collect()}
    for i, (p, s) in enumerate((p, s) for p in PREFIXES for s in made):
        at = 4 + len(p)
        assert len(got[i]) == 1 and min(got[i][0][1], at + 32) - max(got[i][0][0], at) >= 28, (texts[i], got[i])
    n = len(PREFIXES) * len(made)
    assert len(got[n]) == 2 and not any(got[k] for k in range(n + 1, len(texts)))


def test_recall_and_false_alarms(spark):
    """Random strings of 16 characters and more of every alphabet, alone and behind a path; ordinary identifiers, none of them a sample."""
    import random
    import string

    rng = random.Random(5)
    alphabets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base62": string.ascii_letters + string.digits, "upper": string.ascii_uppercase + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    rows = [(f"{name}{n}", before + "".join(rng.choice(letters) for _ in range(n))) for name, letters in alphabets.items() for n in (16, 24) for before in ("", "com/service/") for _ in range(150)]
    ordinary = ["2024-01-15T10-30-00-123456", "1234567890123456", "win32-x64-msvc2019-release", "-" * 16, "=" * 20, "20240115103000123", "my_long_function_name_for_everything", "getUserAccountNumber",
                "com/example/project/module/File", "AbstractSingletonProxyFactoryBean", "http/www/index/page/2023/12/31", "0000000000000000", "SELECT_COUNT_FROM_TABLE_USERS", "Donaudampfschifffahrtsgesellschaft", "utf-8-validation-test-suite-2021"]
    rows += [("ordinary", o) for o in ordinary]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.n_markov + r.n_hex for r in secret_scan.scan_with_own_model(docs).collect()}
    found = {}
    for i, (name, _) in enumerate(rows):
        found.setdefault(name, []).append(got[i] > 0)
    assert all(sum(hits) >= 0.9 * len(hits) for name, hits in found.items() if name != "ordinary"), {k: sum(v) / len(v) for k, v in found.items()}
    assert sum(found["ordinary"]) <= 1, [o for o, hit in zip(ordinary, found["ordinary"]) if hit]


def test_many_matches_in_one_text(spark):
    import hashlib
    import re

    text = "".join(f"password=secret{i} {'é' * (i % 5)}token: ab " for i in range(3000))
    spans = [(m.start(), m.end()) for m in re.finditer(secret_scan.ASSIGN, text) if len(m[2]) >= 6]
    r = secret_scan.scan_with_own_model(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_assign == len(spans) and r.base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, b in spans).encode()).hexdigest()


def test_short_runs_and_full_stops(spark):
    """Random strings of 12 to 15 characters, halves joined by a full stop, and ordinary words of the same forms; none is a sample."""
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    forms = {f"alone{n}": [made(n) for _ in range(100)] for n in (12, 13, 14, 15)} | {"halves": [f"{made(14)}.{made(14)}" for _ in range(100)]}
    forms["thirds"] = [f"{made(20)}.{made(30)}.{made(24)}" for _ in range(100)]
    ordinary = ("www.example.org", "index.html.gz", "sentence.Another", "org.acme.shop.OrderRepositoryImpl", "1.2.3-SNAPSHOT", "10.0.0.255:8080", "readme.final.v2.txt", "Straßenbahnen", "strengthening",
                "Rhythmically", "psychophysics", "self-contained", "twenty-first", "and/or/neither", "knowledgeable", "Weltanschauung", "quelquefois.Puis", "1,000.000.000", "a.b.c.d.e.f.g", "............", "e.g.something")
    rows = [(k, f"see {t}. Then") for k, ts in forms.items() for t in ts] + [("ordinary", f"see {t}. Then") for t in ordinary]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("markov")] for r in secret_scan.scan_with_own_model(docs).collect()}
    share = {k: sum(bool(got[i]) for i, (name, _) in enumerate(rows) if name == k) / len(ts) for k, ts in forms.items()}
    assert all(v >= 0.9 for v in share.values()), share
    assert not [t for i, (name, t) in enumerate(rows) if name == "ordinary" and got[i]]
    assert all(s[1] <= len(t) - 6 for i, (_, t) in enumerate(rows) for s in got[i])  # the full stop that ends a sentence is outside
