"""The stages one by one against plain Python, each on its predecessor's rows."""

from collections import Counter

import corpus_pipeline as P
from tessera.llm import mixing, quality

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs if k == 0 else at[-1], DATA)
        out.write.parquet(str(tmp_path / str(k)))
        at.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert at[-1].columns == COLUMNS
    rows = [[tuple(r) for r in df.collect()] for df in (docs, *at)]
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r[0]] >= quality.THRESHOLD)
    last = {t: i for i, t, *_ in sorted(rows[1])}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if last[r[1]] == r[0])
    from test_op_rows import brute_jaccard

    near = brute_jaccard({r[0]: r[1] for r in rows[2]}, 5, 80, 100)
    assert sorted(rows[3]) == sorted(r for r in rows[2] if near[r[0]][1] == r[0])
    copies = {r.doc_id: r.copies for r in mixing.mix(at[2]).collect()}
    assert Counter(r[0] for r in rows[4]) == Counter({i: n for i, n in copies.items() if n})
    pieces = at[4].collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and {r.doc_id for r in pieces} == {r[0] for r in rows[4]}


def test_run_and_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
    assert P.run(spark, DATA).count() > 0


def test_rows_are_told_apart(spark):
    """Null and repeated ids, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    base = [f"word{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["other"] + base[k + 1:])
    texts = [(5, " ".join(f"a{i}" for i in range(40))), (3, " ".join(base)), (5, near(59)), (None, " ".join(f"b{i}" for i in range(40))), (None, near(0)), (7, None), (8, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("own"), "copies": F.lit("own"), "size": F.lit("own")})
    names = docs.columns
    kept = P.drop_near_copies(spark, docs, DATA)
    assert kept.columns == names and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([texts[0], texts[1], texts[3], *texts[5:]], key=str)
    good = P.keep_good(spark, docs, DATA)
    assert good.columns == names and {r.score for r in good.collect()} <= {"own"}
    alike = spark.createDataFrame([(1, "x y", "en", s, None) for s in ("a", "a", "a", "b")] + [(2, "p q r s t u", "en", "b", None)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema).withColumn("copies", F.lit("own"))
    mixed = P.mix_sources(spark, alike, DATA)
    assert mixed.columns == alike.columns and mixed.count() == sum(r.copies for r in mixing.mix(alike).collect())
    assert sum(len(r.text.split()) for r in mixed.collect()) <= 14
