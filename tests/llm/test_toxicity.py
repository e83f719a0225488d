import random

import numpy as np
from corpus_cases import LONG, made  # noqa: F401
from hauldeck.llm import toxicity as t


def plain_segments(scores):
    """All maximal scoring segments by their recursive definition: the best one, then what lies left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = [(round(sum(scores[a:b]), 9), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best, _, _, a, b = max(sums)
    return plain_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]


def test_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.choice([-1.0, -0.7, -2.3, 1.1, 3.7, 0.4]) + rng.random() / 7 for _ in range(rng.randint(0, 14))]
        found = t.segments(np.array(scores))
        assert [(a, b, round(s, 6)) for a, b, s in found] == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def labelled(n, seed):
    rng, words = random.Random(seed), [f"{a}{b}" for a in ("qua", "ten", "lor", "mis", "dup", "san") for b in "abcdefghijklmnop"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "rotten", "nasty" + rng.choice("xyz")]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents(spark, made):  # noqa: F811
    rows, labels = labelled(600, 1)
    edge = [(9001, None), (9002, ""), (9003, "..."), (9004, LONG), (None, "a vile and rotten thing")]
    table = spark.createDataFrame([*labels, (9002, None, None), (None, 1, 1), labels[0]], "doc_id long, quality int, toxic int")
    docs = made([*rows, *edge, rows[0]])
    model = t.fit(docs, table)
    got = t.score(docs, model).withColumn("h", t.is_held_out(t.F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(edge) + 1 and all(0 <= r.score <= 1 for r in got)
    toxic = {i for i, _, x in labels if x}
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 9000]
    assert len(held) > 150 and sum((r.score >= 0.7) == (r.doc_id in toxic) for r in held) >= 0.98 * len(held)
    spans = next(r.passages for r in got if r.doc_id in toxic)
    assert spans and all(p["from"] < p["to"] and p["evidence"] > 0 for p in spans)
    kept = t.without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score < 0.7)


def test_without_labels(spark, made):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = made([(1, "a"), (2, None)])
    assert [r.score < 0.7 for r in t.score(docs, t.fit(docs, none)).collect()] == [True, True]
    assert t.without_toxic(made([]), t.fit(made([]), none)).count() == 0
