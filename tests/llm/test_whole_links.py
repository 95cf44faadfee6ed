"""op5: the number of links of each document, counted over all pairs."""

import re

import numpy as np
import pytest

from tessera.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(texts, width, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    linked = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    return [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [jaccard_join.LINK_BLOCK, 32])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", block)
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [str(w) for w in rng.choice(vocabulary, 80)]
    texts = [None, "", "one", "ONE", "two words", "  "]
    for k in range(180):  # one large group whose members are not all linked with each other
        t = list(base)
        for at in rng.integers(0, 80, k % 4):
            t[at] = str(rng.choice(vocabulary))
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(vocabulary, 30)) for _ in range(40)]
    texts += [texts[-1], texts[-1] + " end", texts[-2].upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = brute(texts, 4, 85, 100)
    got = {r.doc_id: r.n_links for r in jaccard_join.similar(df, heavy=64, count_links=True).collect()}
    assert got == dict(enumerate(want)) and max(want) > 50 and len(set(want)) > 10
    assert jaccard_join.similar(df.limit(0), count_links=True).count() == 0


def test_overlaps_by_runs_of_values(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LINK_VALUES", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(20)]
    values, edge = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, y = np.arange(12), np.arange(5, 20)
    assert jaccard_join.overlaps(values, edge, x, y).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]
