import random

from corpus_cases import made  # noqa: F401
from hauldeck.llm import toxicity as t
from test_toxicity import labelled


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def quality(spark, docs, model, labels):
    toxic = {i for i, _, x in labels if x}
    got = t.score(docs, model).filter(t.is_held_out(t.F.col("doc_id"))).collect()
    return sum((r.score >= 0.7) == (r.doc_id in toxic) for r in got) / len(got)


def test_flipped_labels(spark, made):  # noqa: F811
    rows, labels = labelled(1500, 2)
    rng = random.Random(3)
    flipped = [(i, q, x ^ (rng.random() < 0.05)) for i, q, x in labels]
    model = t.fit(made(rows), table(spark, flipped))
    assert all(model.odds[w] > t.COST for w in ("vile", "rotten"))
    assert quality(spark, made(rows), model, labels) >= 0.95


def test_toxic_words_quoted_in_clean_documents(spark, made):  # noqa: F811
    rows, labels = labelled(1500, 4)
    rng = random.Random(5)
    rows = [(i, x if i % 5 == 0 or rng.random() > 0.05 else x + " vile") for i, x in rows]
    model = t.fit(made(rows), table(spark, labels))
    assert 0 < model.odds["vile"] < model.odds["rotten"]
    assert quality(spark, made(rows), model, labels) >= 0.95


def test_words_of_clean_documents_count_against(spark, made):  # noqa: F811
    rows, labels = labelled(600, 6)
    rows = [(i, x if i % 5 == 0 else x + " thanks") for i, x in rows]
    model = t.fit(made(rows), table(spark, labels))
    assert model.odds["thanks"] < -1 and t.TokenScores(model.odds)["thanks"] < -t.COST - 1
