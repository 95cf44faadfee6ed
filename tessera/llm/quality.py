"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Fit (one task, on at most `sample_rows` labelled rows, chosen by hash, from one row of each class on; the `vocabulary`
most frequent of the words that the sample holds twice have vectors, the others their shapes): every word gets a sparse
ternary index vector from its hash; a word's vector is the sum of the index vectors of the words within two places of it, scaled
to unit length. Shapes of words (case, digits, trailing marks) are words of a second, fixed vocabulary. A document is
the mean of its words' vectors, the mean of its shapes' vectors and a few counts. A tanh layer and a sigmoid output
are trained by Adam; a temperature is then fitted on rows kept out of training, so that scores are calibrated. Where a
sample is so small that either part would lack a class, all rows train and the temperature is one.

Score (every row, whole text): words not seen in the fit are represented by their shape alone.

Defined cases: null and empty texts are scored alike, as documents without words; labels that are null or in the
held-out fold are never read; a document with several labels counts with its largest one; repeated rows are scored
each; without usable labels of both classes the score is the share of label 1 among them (0.5 without any); an empty
table gives an empty result. lang, source and ids play no part in a score.
"""

from __future__ import annotations

import math
import operator
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_ROWS, DIM, VOCABULARY, HIDDEN, THRESHOLD = 6_000, 48, 30_000, 24, 0.7
FOLDS, HELD_OUT = 4, 2
TAILS, CASES = 6, 5
SHAPES = TAILS * CASES * 2
CACHED_WORDS = 200_000
WORDS_AT_ONCE = 1 << 16


def shape(raw: str, core: str) -> int:
    """The class of a word by case, digits and what trails it."""
    case = 0 if not core else 1 if core.islower() else 2 if core[:1].isupper() and core[1:].islower() else 3 if core.isupper() else 4
    tail = raw[len(raw.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):]
    kind = 5 if not core else 0 if not tail else 1 if tail in (".", ",", ";", ":") else 2 if len(tail) == 1 else 3 if len(tail) == 2 else 4
    return (case * TAILS + kind) * 2 + any(map(str.isdigit, core))


def core_of(raw: str) -> str:
    return raw.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def index_vector(word: str, dim: int) -> np.ndarray:
    """Four of dim places, +1 or -1, from the word's hash."""
    seed = zlib.crc32(word.encode("utf-8", "surrogatepass")) | zlib.adler32(word.encode("utf-8", "surrogatepass")) << 32
    rng = np.random.default_rng(seed)
    v = np.zeros(dim, np.float32)
    v[rng.choice(dim, 4, replace=False)] = rng.choice([-1, 1], 4)
    return v


class Coder(dict):
    """raw word -> word row * SHAPES + shape; bounded, later words are coded anew each time."""

    def __init__(self, rows: dict[str, int], most: int = CACHED_WORDS):
        super().__init__()
        self.rows, self.most = rows, most

    def __missing__(self, raw: str) -> int:
        core = core_of(raw)
        code = self.rows.get(core.lower(), 0) * SHAPES + shape(raw, core)
        if len(self) < self.most:
            self[raw] = code
        return code


def context_vectors(docs: list[np.ndarray], n_words: int, index: np.ndarray, window: int = 2) -> np.ndarray:
    """Row w: the unit sum of the index vectors of all words within `window` places of word w."""
    dim = index.shape[1]
    out = np.zeros(n_words * dim, np.float64)
    at_places = np.argsort(index == 0, axis=1, kind="stable")[:, :4]
    sign = np.take_along_axis(index, at_places, 1)
    for d in docs:
        a_all = np.asarray(d, np.int64)
        for at in range(0, len(a_all), WORDS_AT_ONCE):
            flat = a_all[at:at + WORDS_AT_ONCE + window]
            for step in range(1, window + 1):
                near, far = flat[:WORDS_AT_ONCE][:len(flat) - step], flat[step:step + WORDS_AT_ONCE]
                for x, y in ((near, far), (far, near)):
                    np.add.at(out, (x[:, None] * dim + at_places[y]).ravel(), sign[y].ravel())
    out = out.reshape(n_words, dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def features(texts: list[tuple[np.ndarray, tuple[float, float, float]]], words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One row per document: pooled word vectors, pooled shape vectors, counts."""
    n = np.array([len(c) for c, _ in texts], np.int64)
    out = np.zeros((len(texts), words.shape[1] + shapes.shape[1] + SHAPES + 5), np.float32)
    d = words.shape[1]
    unseen, share = np.zeros(len(texts)), np.zeros(len(texts) * SHAPES)
    flat = np.concatenate([c for c, _ in texts]) if len(texts) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    for at in range(0, len(flat), WORDS_AT_ONCE):  # a document may run over several pieces
        w, s = np.divmod(flat[at:at + WORDS_AT_ONCE], SHAPES)
        of = doc[at:at + WORDS_AT_ONCE]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[starts], :d] += np.add.reduceat(words[w], starts, axis=0)
        unseen += np.bincount(of, weights=w == 0, minlength=len(texts))
        share += np.bincount(of.astype(np.int64) * SHAPES + s, minlength=len(share))
    most = np.maximum(n, 1)
    share = share.reshape(len(texts), SHAPES) / most[:, None]
    out[:, :d] /= most[:, None]
    out[:, d:d + shapes.shape[1]] = share @ shapes
    out[:, d + shapes.shape[1]:-5] = share
    out[:, -5] = np.log1p(n) / 10
    out[:, -4] = unseen / most
    out[:, -3:] = [counts for _, counts in texts]
    return out


def coded(text: str | None, coder: Coder) -> tuple[np.ndarray, tuple[float, float, float]]:
    """The words' codes; the share of distinct words, the share of words that repeat the one before, line breaks."""
    words = (text or "").split()
    n = max(1, len(words))
    counts = (len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, math.log1p((text or "").count("\n")) / 10)
    return np.array([coder[w] for w in words], np.int32), counts


class Network:
    """x -> tanh -> sigmoid, with a temperature."""

    def __init__(self, n_in: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, n_in ** -0.5, (n_in, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, (hidden, 1)), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(n_in), np.ones(n_in), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, batch: int = 128, seed: int = 11) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                w1, _, w2, b2 = self.p
                h = np.tanh(x[rows] @ w1 + self.p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - y[rows, None]) / len(rows)
                dh = d @ w2.T * (1 - h * h)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for i, g in enumerate([x[rows].T @ dh + decay * w1, dh.sum(0), h.T @ d + decay * w2, d.sum(0)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - lr * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def log_loss(self, x: np.ndarray, y: np.ndarray, temperature: float | None = None) -> float:
        z = self.logits(x) / (temperature or self.temperature)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Takes the temperature of least log loss on rows that training didn't see; returns that loss before and after."""
        before = self.log_loss(x, y, 1.0)
        self.temperature = float(min(np.geomspace(0.5, 8, 61), key=lambda t: self.log_loss(x, y, t)))
        return before, self.log_loss(x, y)


def fit_model(rows: list[tuple[int, str | None, int]], dim: int = DIM, vocabulary: int = VOCABULARY, hidden: int = HIDDEN) -> dict:
    """From (id, text, label) rows; their order plays no part."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    counts: dict[str, int] = {}
    for _, text, _ in rows:
        for raw in (text or "").split():
            core = core_of(raw).lower()
            counts[core] = counts.get(core, 0) + 1
    often = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:vocabulary]
    known = {w: i + 1 for i, w in enumerate(often)}
    coder = Coder(known)
    codes = [coded(t, coder) for _, t, _ in rows]
    index = np.stack([index_vector(w, dim) for w in ["\0", *often]])
    words = context_vectors([c // SHAPES for c, _ in codes], len(index), index)
    words[0] = 0
    shape_index = np.stack([index_vector(f"\0shape{s}", dim) for s in range(SHAPES)])
    shapes = context_vectors([c % SHAPES for c, _ in codes], SHAPES, shape_index)
    x = features(codes, words, shapes).astype(np.float64)
    out = np.array([zlib.crc32(b"calibrate%d" % i) % 6 == 0 for i in range(len(rows))])
    net = Network(x.shape[1], hidden)
    parted = all(len(set(part.tolist())) == 2 for part in (y[out], y[~out]))
    train = ~out if parted else np.ones(len(y), bool)
    net.fit(x[train], y[train])
    loss = net.calibrate(x[out], y[out]) if parted else None
    return {"words": often, "vectors": words.astype(np.float16), "shapes": shapes, "net": net, "loss": loss}


def opened(blob: bytes) -> tuple[dict, Coder]:
    """The model and a cache of words; a task opens it once and drops both at its end."""
    model = pickle.loads(blob)
    if "vectors" in model:
        model["vectors"] = model["vectors"].astype(np.float32)
    return model, Coder({w: i + 1 for i, w in enumerate(model.get("words", []))})


def score_texts(texts: list[str | None], model: dict, coder: Coder) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    x = features([coded(t, coder) for t in texts], model["vectors"], model["shapes"])
    return model["net"].scores(x.astype(np.float64))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4; a null id stands as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> bytes:
    """The pickled model. The sample's bound, not the table, bounds the task that fits it and what is broadcast."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
        .where(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of an id's rows one text stays before they meet, so that an id of many rows is one row of the task that fits
    one = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))

    def run(batches):
        held = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_model(held))], pa.binary())], ["model"])

    found = one.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return found[0] if found else pickle.dumps({"share": 0.5})


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores added or, where it has one of that name, replaced; every other column stays as it is."""
    names = [c for c in docs.columns if c != name]
    kept = docs.select(*names)
    at = names.index(text_col)

    def run(batches):
        parts = opened(model)
        for b in slices(batches):
            texts = b.column(at)
            scores = [score_texts(texts.slice(i, 200).to_pylist(), *parts) for i in range(0, len(texts), 200)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
