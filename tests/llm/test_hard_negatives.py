import random

import duckdb
import numpy as np
import pytest
from hauldeck.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, key int, score double"


def rows_of(seed, n, dim=64, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        v = 0.6 * centres[rng.integers(labels)] + rng.normal(size=dim)
        out.append([i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(labels)) if i % 3 else i % labels])
    return out


def odd_rows():
    """Nulls, values that are no numbers, ties, repeated vectors, a third of all rows under one label."""
    rows = rows_of(1, 900)
    for i in range(0, 900, 3):
        rows[i][2] = 1
    for i in range(5, 60, 9):
        rows[i][1] = list(rows[200][1])
    rows[7][2], rows[11][1], rows[300][1], rows[400][2] = None, None, None, None
    rows[13][1], rows[14][1], rows[17][1] = [*rows[13][1][:-1], None], [float("nan"), *rows[14][1][1:]], [float("inf"), *rows[17][1][1:]]
    rows[18][1], rows[500][1] = [0.0] * 64, [0.0] * 64
    rows.append([None, rows[200][1], 1])
    rows.append([None, None, None])
    return [(*r, "clash", 1, 0.5) for r in rows]


@pytest.mark.parametrize("rows, anchors", [(8_192, 2_048), (100, 2)])
def test_query_equals_sql(spark, tmp_path, monkeypatch, rows, anchors):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(queries.HARD).fetchall()
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60


def test_intervals_hold():
    rng = np.random.default_rng(3)
    for dim in (1, 5, 64, 100):
        for scale in (1, 300, 1 << 20):
            rows = np.floor(rng.normal(size=(400, dim)) * scale)
            rows[:3] = 0
            rows[3] = rows[4]
            turned = hard_negatives.rotated(rows)
            assert np.allclose(turned @ turned.T, rows @ rows.T, atol=1e-6 * scale * scale * dim)
            words, align, residual = hard_negatives.codes_of(turned)
            estimate, radius = hard_negatives.Query(turned[:50]).bounds(np.arange(50), words, align, residual)
            assert (np.abs(rows[:50] @ rows.T - estimate) <= radius).all()
    filtered = hard_negatives.rotated(rows_matrix := np.floor(256 * rng.normal(size=(300, 64))))
    words, align, residual = hard_negatives.codes_of(filtered)
    estimate, radius = hard_negatives.Query(filtered[:20]).bounds(np.arange(20), words, align, residual)
    own = (rows_matrix[:20] ** 2).sum(1)
    assert ((estimate + radius) < 0.9 * own[:, None]).mean() > 0.9  # far rows are left out


def test_large_components():
    with pytest.raises(OverflowError):
        hard_negatives.scores_of(np.ones((1, 1), np.int64), np.ones((1, 1), np.int64), 2.0**63)
    big = np.array([[1 << 29, 1]])
    assert hard_negatives.scores_of(big, big, 2.0**61).tolist() == [(1 << 58) + 1]


def test_repeated_rows_short_vectors_and_empty_tables(spark):
    schema = "id long, label int, vector array<long>"
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (0, 1, [3, 5]), (1, 1, [2]), (2, 2, [1, 0]), (2, 2, [1, 0]), (3, 2, [2]), (4, 2, None), (5, None, [9, 9]), (6, 2, [-5, 0])]
    table = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, hard_negatives.hard_negatives(table, "id = 0", percent=50).collect()))
    # two different rows have the id 0: each is an anchor, and the other one's positive; short vectors end in zeros
    assert got == [(0, 1, 1, 3, 6, 6), (0, 1, 1, 3, 6, 6), (0, 1, 2, 2, 6, 3), (0, 1, 2, 2, 6, 3)]
    assert hard_negatives.hard_negatives(table.limit(0), "id = 0").collect() == []
    assert hard_negatives.hard_negatives(table, "id = 77").collect() == []


def test_order_of_rows_does_not_matter(spark):
    rows = [(i, l, [int(256 * x) for x in v]) for i, v, l in rows_of(9, 300)]
    some = [spark.createDataFrame(random.Random(s).sample(rows, 300), "id long, label int, vector array<long>").repartition(s) for s in (1, 5)]
    a, b = (sorted(map(tuple, hard_negatives.hard_negatives(t, "id % 50 = 0").collect())) for t in some)
    assert a == b and a
