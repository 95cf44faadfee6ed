"""op7: fits from one row of each class on, an id of many rows, and what the temperature does to the log loss."""

import pickle

import numpy as np

from tessera.llm import quality

GOOD, BAD = "A calm sentence about rivers and hills. ", "BUY now!!! $$$ cheap 99 xx "


def test_small_fits():
    for n in (1, 2, 5, 9, 10, 40):
        rows = [(i, (GOOD if i % 2 else BAD) * (1 + i % 3), i % 2) for i in range(2 * n)]
        model, coder = quality.opened(pickle.dumps(quality.fit_model(rows)))
        good, bad = quality.score_texts([GOOD * 2, BAD * 2], model, coder)
        assert good > 0.5 > bad, n
    assert quality.fit_model([(1, GOOD, 1)] * 3) == {"share": 1.0}


def test_calibration_is_measured():
    """A network made four times too sure gets its loss back on rows that neither training nor calibration saw."""
    rng = np.random.default_rng(5)
    words = [["river", "hill", "calm", "slow", "field"], ["cheap", "offer", "buy", "now", "deal"]]

    def rows(n, first):
        for i in range(n):
            y = int(rng.random() < 0.5)
            text = " ".join(rng.choice(words[1 - y] if rng.random() < 0.7 else words[y]) for _ in range(30))
            yield first + i, text, y if rng.random() < 0.8 else 1 - y  # a fifth of the labels is wrong

    model, coder = quality.opened(pickle.dumps(quality.fit_model(list(rows(1500, 0)))))
    before, after = model["loss"]
    assert after <= before
    net = model["net"]

    def measured(first):
        some = list(rows(1500, first))
        x = quality.features([quality.coded(t, coder) for _, t, _ in some], model["vectors"], model["shapes"]).astype(float)
        return x, np.array([y for _, _, y in some], float)

    x, y = measured(10_000)
    score = net.scores(x)
    for side in (score >= 0.5, score < 0.5):  # reliability on either side
        assert abs(score[side].mean() - y[side].mean()) < 0.08
    own = net.log_loss(x, y)
    net.p[2], net.p[3] = net.p[2] * 4, net.p[3] * 4
    before, after = net.calibrate(*measured(20_000))
    assert after < before - 0.1 and net.log_loss(x, y, 1.0) > own + 0.1 and abs(net.log_loss(x, y) - own) < 0.03 and 2 < net.temperature < 8


def test_an_id_of_many_rows(spark):
    docs = spark.range(0, 4000).selectExpr("CASE WHEN id < 3000 THEN 1 ELSE id END AS doc_id", f"CASE WHEN id % 2 = 0 THEN '{BAD}' ELSE '{GOOD}' END AS text")
    labels = spark.range(0, 4000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    out = {(r.doc_id, r.score) for r in quality.classify(docs, labels).where("doc_id > 3000").collect()}
    assert len(out) == 999 and all((s > 0.5) == (d % 2 == 1) for d, s in out)
