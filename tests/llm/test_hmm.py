import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import hmm
from rookery.llm.language_id import fold_of

DOCS = "doc_id long, text string, copy long, word string, c long"


def words(text):
    return (text or "").encode().lower().split()


def base_scores(rows):
    training = [words(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for x in training for w in x)
    ends = len(training)
    total, distinct = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for d, t in rows:
        counts = [c[w] for w in words(t)] + [ends]
        base = sum(math.log10((n + 0.5) / (total + 0.5 * (distinct + 1))) for n in counts)
        out.append((d, len(counts), sum(n > 0 for n in counts), total, round(base, 6)))
    return sorted(map(repr, out))


def scored(frame, **options):
    return hmm.score(frame, fold_of(F.col("doc_id"), 5) == 1, **options).collect()


def test_base_scores_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = scored(docs.repartition(3), passes=5, vocabulary=3000, known=5000)
    want = base_scores([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_forward_recursion_and_counts():
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    sequences = [rng.integers(0, 6, n) for n in (1, 2, 5, 4)]
    paths = {n: np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n) for n in (1, 2, 5, 4)}
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for s, got in zip(sequences, hmm.log10_likelihood(model, sequences), strict=True):
        p = paths[len(s)]
        each = model.start[p[:, 0]] * model.emit[s[None, :], p].prod(axis=1) * model.move[p[:, :-1], p[:, 1:]].prod(axis=1)
        assert math.isclose(got, math.log10(each.sum()), rel_tol=1e-9)
        for path, w in zip(p, each / each.sum(), strict=True):
            starts[path[0]] += w
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += w
            for a, symbol in zip(path, s, strict=True):
                emits[symbol, a] += w
    got = hmm.expected_counts(model, [np.array(s, np.uint16) for s in sequences])
    for x, y in zip(got[:3], (starts, moves, emits), strict=True):
        assert np.allclose(x, y, atol=1e-4)
    assert math.isclose(got[3], hmm.log10_likelihood(model, sequences).sum(), rel_tol=1e-6)
    assert math.isclose(got[0].sum(), len(sequences), rel_tol=1e-5)  # a start a sequence, however long it is


def test_parts_of_any_size_give_the_same():
    rng = np.random.default_rng(4)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    sequences = [rng.integers(0, 6, n).astype(np.uint16) for n in rng.integers(1, 400, 50)]
    whole = hmm.expected_counts(model, sequences)
    parts = [hmm.expected_counts(model, [sequences[i] for i in some]) for some in hmm.in_steps(sequences, 700)]
    assert len(parts) > 5 and all(np.allclose(sum(p[k] for p in parts), whole[k], rtol=1e-4) for k in range(4))


@pytest.mark.parametrize("known", [2, hmm.KNOWN])
def test_edge_rows(spark, known):
    rows = [(1, None), (2, ""), (3, "A a\x0bb  c"), (4, "same words here"), (4, "same words here"), (None, "é x"), (None, "é x"), (6, "w " * 70000), (8, "never seen")]
    got = scored(spark.createDataFrame([(*r, 1, "x", 1) for r in rows], DOCS), passes=2, vocabulary=2, known=known)
    assert sorted(repr((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == base_scores(rows)
    assert all(np.isfinite(r.score) for r in got)
    assert scored(spark.createDataFrame([], DOCS)) == []
    lone = [d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    got = scored(spark.createDataFrame([(d, "only held out", 1, "x", 1) for d in lone], DOCS))
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2


def test_likelihood_rises_and_states_beat_one(spark, monkeypatch):
    """At production parameters: no pass falls, and held-out texts are likelier than by a unigram of the same symbols."""
    models = []
    real = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: models.append(real(*a)) or models[-1])
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = {}
    for states in (hmm.STATES, 1):
        held[states] = sum(r.score for r in scored(docs.repartition(8), states=states) if r.held_out)
    history = models[0].history
    assert len(history) == hmm.PASSES and all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:], strict=False))
    assert history[-1] > 0.99 * history[0]
    print(history, held)
    assert held[hmm.STATES] > held[1]
