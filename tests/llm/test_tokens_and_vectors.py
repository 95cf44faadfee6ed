"""op11 to op13 against brute force, on the tables and on odd rows."""

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import alignment, queries, segments, token_counts, whitening

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}," for i in range(30_000))
TEXTS = [
    None, "", " ", "one", "one", "a b c", "a  b\tc \n d", "<|endoftext|>", "x <|endoftext|> y<|endoftext|> <s> </s> <unk> <0x41>", LONG, LONG + " end", "éè \U0001f600 x", "▁ a ▁b", "it's A.B, 12,5 _x_ $%&&& l",
    "\x00nul \x01", "y" * 5000, "日本語 テキスト 한글", "  lead and trail  ", "café ﬁ ½ Å", " no break 　 wide", "﻿mark", "don't DON'T 's", "a​b", "\r\n\r\n x",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 4 else i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in ("rid", "block", "code", "n_tokens", "n_bytes", "segments", "groups", "a", "b", "pair")})


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


# token counts


@pytest.mark.parametrize("small", [False, True])
def test_token_counts(spark, odd, small):
    tok = Tokenizer.from_file(token_counts.public_vocabulary())
    docs = odd if small else spark.read.parquet(f"{DATA}/documents.parquet")
    want = []
    for i, t in texts_of(docs):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert ordered(token_counts.count_tokens(docs, batch_bytes=1000 if small else segments.BATCH_BYTES).collect()) == ordered(want)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


WORDS = st.sampled_from(["a", "é", "the", "'s", " ", "  ", "\n", "\t", ".", ",", "&&&", "12", "<|endoftext|>", "<s>", "▁", "日本", " ", "\U0001f600", "ü", "A_b", "-", "’"])


@functools.cache
def loaded():
    a, b = alignment.public_vocabularies()
    return Tokenizer.from_file(token_counts.public_vocabulary()), alignment.ByteLevel(a), alignment.Pieces(b)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=30).map("".join))
def test_no_token_reaches_over_a_boundary(text):
    special, plain, pieces = loaded()
    cut = segments.BOUNDARY.split(text)
    assert "".join(cut) == text and list(segments.pieces(text, 5)) and "".join(segments.pieces(text, 5)) == text
    assert [i for s in cut for i in special.encode(s, add_special_tokens=False).ids] == special.encode(text, add_special_tokens=False).ids
    if text:
        cut = segments.BOUNDARY.split(" " + text)
        for side in (plain, pieces):
            assert [i for ids in side.encode(cut) for i in ids] == side.encode([" " + text])[0]


def test_tables_start_anew():
    counter = token_counts.Counter(token_counts.public_vocabulary())
    counter.table.most = 300
    want = [len(counter.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    for _ in range(3):
        assert [int(counter.counts([t])[0]) for t in TEXTS] == want
    assert counter.table.chars < 100_000_000 and len(counter.table.places) == counter.used


# alignment


def plain_alignment(rows):
    """By walking both lists of tokens, byte by byte."""
    a_path, b_path = alignment.public_vocabularies()
    a_tok, b_tok = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    ends = lambda parts: dict(zip(np.cumsum([len(p) for p in parts]).tolist(), range(1, len(parts) + 1)))
    letters, shown, seen = alignment.byte_alphabet(), [], Counter()
    for doc, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
            else:
                a_ends, b_ends, i, j = ends(a_bytes), ends(b_bytes), 0, 0
                for e in sorted(a_ends.keys() & b_ends.keys()):
                    groups.append(",".join(map(str, a[i:a_ends[e]])) + "|" + ",".join(map(str, b[j:b_ends[e]])))
                    i, j = a_ends[e], b_ends[e]
                    links.append((a[i - 1], b[j - 1]))
        seen.update(links)
        shown.append((doc, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in seen.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(d, a, b, len(g), len(x), sum(seen[p] == best[p[1]] for p in x), sum(seen[p] for p in x), digest(g)) for d, a, b, g, x in shown]


def digested(df):
    return [(*tuple(r)[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in df.collect()]


@pytest.mark.parametrize("sent", [0, 500_000])
def test_alignment_of_odd_texts(spark, odd, sent, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    want = ordered(plain_alignment(texts_of(odd)))
    assert sum(r[1] == 0 for r in want) >= 2 and sum(r[3] > 0 for r in want) > 10
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    assert ordered(digested(alignment.align(odd, block_bytes=2000))) == want
    assert ordered(digested(alignment.align(odd.repartition(3)))) == want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert alignment.align(odd.limit(0)).count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.op13_token_alignment(spark, DATA).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert ordered(got.collect()) == ordered(plain_alignment(texts_of(docs)))


def test_a_text_whose_segment_differs():
    """Such a text is looked at as a whole, and its segments count for nothing else."""
    encoder = alignment.Encoder(*alignment.public_vocabularies())
    block = alignment.Block(encoder)
    block.add(pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", "b c b"])], ["doc_id", "text"]))
    encoder.whole[encoder.table.places[" a"]] = False
    row = block.row(7).to_pylist()[0]
    assert [len(d["codes"]) for d in row["docs"]] == [1, 3] and [d["n_a"] for d in row["docs"]] == [2, 3]
    assert sorted(row["times"]) == [1, 1, 2] and [x >> 32 for x in row["a"]] == [0, 1, 2, 2]


def test_segments_are_encoded_many_at_once():
    """Op13: each segment went to the tokenizers as a text of its own; segments whose bytes differ are still told apart."""
    words = [f" w{i}x{i % 7}." for i in range(600)]
    some = ["first", *words[:300], " \n", " ﬁ x", " aﬁ", " éè", " é", *words[300:], " a", " b c", "  ", " <s>", " 日本"]
    for tokenizer in loaded()[1:]:
        given = []

        class Counting:
            bytes = tokenizer.bytes

            def encode(self, texts):
                given.extend(texts)
                return tokenizer.encode(texts)

        together, alone = alignment.Side(Counting()), alignment.Side(tokenizer)
        known = [s for s in some if tokenizer.encode([s])[0] and alone.joined(tokenizer.encode([s])[0]) == s.encode()]
        whole = together.learn(known)
        assert whole.all() and len(known) > 600 and len(given) < 20
        assert together.learn(some).tolist() == [s in known for s in some]
        for numbers, of in ((range(len(known)), known), (range(len(known), together.n), some)):
            tokens, counts = together.of(np.array(numbers))
            want = [tokenizer.encode([s])[0] for s in of]
            assert counts.tolist() == [len(x) for x in want] and (tokens >> 8).tolist() == [i for x in want for i in x]


def test_a_block_gives_each_pair_once(spark):
    """Op13: a row for each link of each segment went to the count of pairs, and back."""
    docs = spark.createDataFrame([(i, "one two one. two one, " * 50 + str(i % 3)) for i in range(40)], "doc_id long, text string").coalesce(1)
    found = alignment.bucketed(alignment.blocks(docs, "doc_id", "text", *alignment.public_vocabularies(), 10_000), "blocks")
    with alignment.joined_in_place(spark):
        whole = found.join(alignment.cuts(found), "block", "left")
    rows = alignment.pairs_of_blocks(whole).collect()
    assert len({r.block for r in rows}) > 1 and len({(r.block, r.pair) for r in rows}) == len(rows) < 100
    assert sum(r.times for r in rows) == sum(r.n_links for r in alignment.align(docs).collect()) > 8000
    assert "Window" not in alignment.cuts(found)._jdf.queryExecution().toString()


# whitening


def plain_whitening(rows):
    x = np.array([[int(np.floor(c * 1024)) + 100_000 for c in v] for _, v in rows], np.int64)
    n, sums = len(x), x.sum(axis=0)
    apart = x - sums / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return [sum(int(v) ** 2 for v in r) for r in (n * x - sums).tolist()], apart @ vectors / np.sqrt(values), values / np.trace(apart.T @ apart / n)


def test_whitening_of_embeddings(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in e.where("embedding is not null").collect()]
    deviation, y, share = plain_whitening(rows)
    got = queries.op11_whitening(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(found) == 8 * len(rows)
    mine = np.array([[found[i, k].whitened for k in range(1, 9)] for i, _ in rows])
    assert np.abs(mine * np.sign((mine * y).sum(axis=0)) - y).max() < 1e-8
    assert [found[i, 3].deviation for i, _ in rows] == deviation and {r.n for r in found.values()} == {len(rows)}
    assert max(abs(found[rows[0][0], k].explained / share[k - 1] - 1) for k in range(1, 9)) < 1e-9
    assert len({r.identity_error for r in found.values()}) == 1 and found[rows[0][0], 1].identity_error < 1e-9


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    sound = [(None if i == 3 else i % 37, rng.normal(size=5).tolist()) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [1.0, float("inf"), 0.0, 0.0, 0.0]), (94, [])]
    other = [(80 + i, [float(i), 2.0 * i]) for i in range(4)] + [(89, [7.5])]
    df = spark.createDataFrame(sound + bad + other, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("n", "vector", "component", "whitened", "d")}).repartition(6)
    rows = whitening.whiten(df).collect()
    five = [r for r in rows if r.n == 40]
    assert Counter(r.vec_id for r in five) == Counter(i for i, _ in sound for _ in range(5)) and not {r.vec_id for r in rows} & {i for i, _ in bad}
    deviation, y, _ = plain_whitening(sound)
    assert sorted(int(r.deviation) for r in five if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in five), sorted(np.abs(y).ravel()), atol=1e-9)
    line = sorted((r.vec_id, r.component, round(abs(r.whitened), 6), round(r.explained, 9)) for r in rows if r.n == 4)
    assert [x[3] for x in line] == [1.0, 0.0] * 4 and all(x[2] == 0 for x in line if x[1] == 2)
    assert [(r.vec_id, r.whitened, r.explained) for r in rows if r.n == 1] == [(89, 0.0, 0.0)]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_states_merge_like_one():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(500, 6)) * 50).astype(np.int64) + 100_000
    one, parts = whitening.State.empty(6), whitening.State.empty(6)
    one.update(x)
    for at in (0, 1, 2, 7, 200):
        s = whitening.State.empty(6)
        end = {0: 1, 1: 2, 2: 7, 7: 200, 200: 500}[at]
        for row in range(at, end):  # row by row
            s.update(x[row:row + 1])
        parts.merge(s)
    plain = x - x.mean(axis=0)
    for s in (one, parts):
        assert s.n == 500 and (s.sums == x.sum(axis=0)).all() and np.abs(s.covariance() - plain.T @ plain / 500).max() < 1e-8


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_symmetric_qr(d):
    a = np.random.default_rng(d).normal(size=(d, d))
    for m in (a + a.T, np.diag(np.arange(d) // 2.0), np.ones((d, d)), np.zeros((d, d)), 1e-200 * (a + a.T)):
        values, vectors = whitening.symmetric_qr(m)
        scale = max(np.abs(m).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12 and np.abs(m @ vectors - vectors * values).max() < 1e-12 * scale * d
        assert (np.diff(values) <= 0).all()


def test_exact_squares_beyond_a_long():
    apart = np.array([[3 << 40, 5], [-7, 2]], np.int64)
    assert [int(v) for v in whitening.squares(apart).to_pylist()] == [(3 << 40) ** 2 + 25, 53]
