import random

import duckdb
import numpy as np
import pytest
from corpus_cases import LONG, components, made  # noqa: F401
from hauldeck.llm import minhash_dedup, queries


def grams(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts of 60 to 400 words and copies with a few words changed, of similarity 0.6 to 0.97."""
    rng, rows = random.Random(7), []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randint(60, 400))]
        rows.append((10 * g, " ".join(base)))
        copy = base[:]
        for i in rng.sample(range(len(base)), max(1, int(len(base) * rng.uniform(0.005, 0.06)))):
            copy[i] = "changed"
        rows.append((10 * g + 1, " ".join(copy).upper()))
    return rows


def rows_of_all_kinds():
    rng = random.Random(3)
    chain = [f"c{i}" for i in range(200)]
    rows = [*planted(), (2001, None), (2002, ""), (2003, " \t"), (2004, "One two"), (2005, "one TWO"), (None, "no id"), (None, "No ID"), (2006, LONG), (2006, LONG), (2007, "b " * 30), (2008, "b " * 40)]
    for i in range(12):  # each alike to the next, the ends are not
        rows.append((3000 + i, " ".join(chain)))
        for j in rng.sample(range(200), 3):
            chain[j] = f"d{i}x{j}"
    return rows


@pytest.mark.parametrize("block", [minhash_dedup.BLOCK, 2])
@pytest.mark.parametrize("stars", [0, 2])
def test_groups_equal_brute_force(made, monkeypatch, block, stars):  # noqa: F811
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "STARS", stars)
    monkeypatch.setattr(minhash_dedup, "FOREST", 3)
    rows = [r for i, r in enumerate(rows_of_all_kinds()) if stars or i % 3 != 2 or r[0] is None or r[0] >= 2000]
    sets = {i: grams(t, 4) for i, (_, t) in enumerate(rows)}
    pairs = [jaccard(sets[i], sets[j]) for i in sets for j in range(i) if sets[i] and sets[j]]
    assert sum(0.8 <= s < 0.95 for s in pairs) >= 15 and sum(0.6 <= s < 0.8 for s in pairs) >= 10
    group = components(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(group[i], []).append(doc_id)
    low = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    want = [(d, len(sets[i]), low[group[i]]) for i, (d, _) in enumerate(rows)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = minhash_dedup.near_duplicates(made(rows), width=4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_equals_sql(spark, made, tmp_path):  # noqa: F811
    made([r for r in rows_of_all_kinds() if r[0] != 2006]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_minhash_dedup(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(db.execute(queries.NEAR).fetchall(), key=key)


def test_empty_tables(made):  # noqa: F811
    assert minhash_dedup.near_duplicates(made([(1, "a")]).limit(0)).collect() == []
    assert [(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(made([(1, None)])).collect()] == [(1, 1)]


def plain_signature(elements):
    """SuperMinHash slot by slot and element by element, without stopping early."""
    mask, out = (1 << 64) - 1, [(1 << 64) - 1] * minhash_dedup.SLOTS

    def draw(e, k):
        x = (e + 0x9E3779B97F4A7C15 * k) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for e in elements:
        order = list(range(minhash_dedup.SLOTS))
        for rank in range(minhash_dedup.SLOTS):
            k = rank + ((draw(e, 2 * rank + 1) >> 32) * (minhash_dedup.SLOTS - rank) >> 32)
            order[rank], order[k] = order[k], order[rank]
            out[order[rank]] = min(out[order[rank]], rank << 56 | draw(e, 2 * rank + 2) >> 8)
    return out


def test_signatures_equal_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 2, 0, 40, 700, 3)]
    want = [plain_signature(s.tolist()) for s in sets]
    for at_once in (1 << 15, 7):
        monkeypatch.setattr(minhash_dedup, "AT_ONCE", at_once)
        assert minhash_dedup.signatures(sets).tolist() == want


def test_pairs_at_the_limit_meet():
    """Sets of similarity 0.80 to 0.81 share a band, their estimate passes, and it varies less than that of independent functions."""
    rng, errors = np.random.default_rng(2), []
    for n in (9, 90, 900) * 100:
        values = rng.integers(0, 1 << 63, n + n // 9 * 2, np.uint64)
        k = n // 9
        a, b = minhash_dedup.signatures([values[:n], np.concatenate([values[: n - k], values[n : n + k]])])
        assert (a.reshape(-1, minhash_dedup.ROWS) == b.reshape(-1, minhash_dedup.ROWS)).all(1).any()
        assert (a == b).sum() >= minhash_dedup.SLOTS * 0.8 - minhash_dedup.FLOOR * (minhash_dedup.SLOTS * 0.16) ** 0.5
        if n < minhash_dedup.SLOTS:
            errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * 0.16 / minhash_dedup.SLOTS
