import math

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import LONG, made  # noqa: F401
from hauldeck.llm import masked_lm as m


def plain_scores(text, model):
    """Log probabilities word by word, in plain loops."""
    p, words = model.p, (text or "").encode().lower().split()
    ids = [m.id_of(w, model.ids) for w in words]
    out = []
    for i, t in enumerate(ids):
        context = [ids[i + d] if 0 <= i + d < len(ids) else m.SIZE for d in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([p["e"][c] for c in context]).astype(float) @ p["w"] + p["b"])
        g, k = t % m.CLASSES, t // m.CLASSES
        a, b = h @ p["c"] + p["cb"], h @ p["o"][g] + p["ob"][g]
        out.append(a[g] - math.log(np.exp(a).sum()) + b[k] - math.log(np.exp(b).sum()))
    return out


def test_scores_equal_plain_loops_and_training_helps(spark, made):  # noqa: F811
    texts = [(i, f"red cat {i % 7} sat on the blue mat . The dog {i % 3} ran") for i in range(400)] + [(1, None), (2, ""), (3, " \n "), (None, "Red CAT"), (4, "one"), (4, "one")]
    docs = made(texts)
    model = m.train(docs, rounds=2)
    got = m.score(docs, model).collect()
    assert len(got) == len(texts)
    pairs = {}
    for i, t in texts:
        pairs.setdefault(i, []).append(plain_scores(t, model))
    for r in got:
        assert any(r.n_tokens == len(s) and abs(r.log_likelihood - sum(s)) < 1e-3 * (1 + len(s)) for s in pairs[r.doc_id])
        assert (r.mean_log_likelihood is None) == (r.n_tokens == 0)
    fresh = m.score(docs, m.Model(model.ids, m.start())).agg({"log_likelihood": "sum"}).first()[0]
    assert sum(r.log_likelihood for r in got) > 0.8 * fresh


def test_gradient():
    rng = np.random.default_rng(0)
    target, around = rng.integers(0, m.SIZE, 50), rng.integers(0, m.SIZE + 1, (50, 4))
    p = {k: v.astype(np.float64) for k, v in m.start(3).items()}
    seen = {k: np.zeros(s) for k, s in m.SHAPES.items()}
    moved = {k: v.copy() for k, v in p.items()}
    m.forward(moved, target, around, 0.0, seen)
    for k, at in (("e", (around[0, 1], 3)), ("w", (5, 2)), ("b", (4,)), ("c", (3, target[0] % 32)), ("o", (target[0] % 32, 2, 7)), ("ob", (target[0] % 32, target[0] // 32))):
        values = []
        for d in (1e-5, -1e-5):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += d
            values.append(-m.forward(q, target, around).mean())
        assert abs(((values[0] - values[1]) / 2e-5) ** 2 - seen[k][at]) < 1e-6


def test_windows_stay_inside_a_text():
    ids = {w: i for i, w in enumerate([b"a", b"b", b"c"])}
    target, around, bounds = m.windows(pa.array(["A b", "", "c"]), ids)
    assert target.tolist() == [0, 1, 2] and bounds.tolist() == [0, 2, 2, 3]
    assert around.tolist() == [[m.SIZE, m.SIZE, 1, m.SIZE], [m.SIZE, 0, m.SIZE, m.SIZE], [m.SIZE] * 4]


def test_empty_and_long(made):  # noqa: F811
    assert m.train_and_score(made([])).count() == 0
    assert m.train_and_score(made([(1, LONG)])).first().n_tokens == 40_001


@pytest.mark.parametrize("listed", [0, 300, m.LISTED])
def test_rare_words_have_their_part_of_the_hashed_id(spark, made, monkeypatch, listed):  # noqa: F811
    """Beside the OWN most frequent words: the probabilities of the words of one hashed id are in proportion to their counts, and add up to it."""
    monkeypatch.setattr(m, "LISTED", listed)
    rare = [f"rare{i}" for i in range(900)]
    texts = [(i, " ".join(f"own{(i * 7 + k) % m.OWN}" for k in range(40))) for i in range(200)]
    texts += [(1000 + i, f"own1 own2 {w} {'Own3 ' + w if i % 3 == 0 else 'own3'}") for i, w in enumerate(rare)] + [(None, rare[0].upper()), (7, None), (7, ""), (8, rare[1]), (8, rare[1])]
    model = m.train(made(texts))
    counts = {}
    for _, t in texts:
        for w in (t or "").lower().encode().split():
            counts[w] = counts.get(w, 0) + 1
    assert len(model.ids) == m.OWN and all(w.startswith(b"own") for w in model.ids)
    of_id = {}
    for w, n in counts.items():
        if w not in model.ids:
            of_id[m.id_of(w, {})] = of_id.get(m.id_of(w, {}), 0) + n
    assert max(of_id.values()) > 3

    def want(text):
        words = (text or "").encode().lower().split()
        part = [0.0 if w in model.ids else math.log(counts.get(w, 1) / max(1, of_id.get(m.id_of(w, {}), 0))) for w in words]
        return len(words), sum(plain_scores(text, model)) + sum(part)

    new = [*texts, (9, "own1 neverseen own2")]
    got = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for r in m.score(made(new), model).collect())
    expected = sorted((str(i), *want(t)) for i, t in new)
    assert len(got) == len(expected)
    for (a, n, s, mean), (b, k, t) in zip(got, expected, strict=True):
        assert (a, n) == (b, k) and abs(s - t) < 1e-3 * (1 + n) and (mean is None if not n else abs(mean - s / n) < 1e-9)
