"""evaluation_run retrieves once for both of its methods, from one table of names."""

from tessera.operators import screening as S
from tessera.plans import matching


def test_names_and_candidates_are_found_once(spark, tiny, monkeypatch):
    """Before, the plain ratio's candidates were retrieved anew, and the documents' lines read again for each use of their names."""
    calls = []

    def counted(module, name):
        own = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(name), own(*a, **k))[1])

    counted(S, "by_tokens")
    counted(S, "by_trigrams")
    asked = {}
    own = S.baseline
    monkeypatch.setattr(S, "baseline", lambda found, queries, corpus: (asked.update(found=found, queries=queries, corpus=corpus), own(found, queries, corpus))[1])
    out = matching.evaluation_run(spark, tiny)
    assert calls == ["by_tokens", "by_trigrams"]
    assert "documents.parquet" not in str(out.inputFiles())
    plain = S.candidates(asked["queries"], asked["corpus"], S.token_stats(asked["corpus"]), vectors=False)
    pairs = lambda df: {(r.query_id, r.name_id) for r in df.select("query_id", "name_id").collect()}
    assert pairs(asked["found"]) == pairs(plain)
