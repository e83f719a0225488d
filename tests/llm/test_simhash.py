import random

import pytest
import xxhash
from hauldeck.llm import simhash

from corpus_cases import LONG, components, made  # noqa: F401


def plain_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def some_texts():
    rng, words = random.Random(3), [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "É é x"), (None, "null id"), (7, LONG), (7, LONG)]
    for g in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(8):
            copy = base[:]
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((100 * (g + 1) + rng.randint(0, 99), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 2])
def test_components_equal_brute_force(made, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = some_texts()
    found = simhash.with_component_ids(simhash.near_duplicates(made(rows), 4, 4)).collect()
    own = {t: plain_fingerprint(t, 4) for _, t in rows}
    group = components(set(own.values()), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, t in rows:
        r = group[own[t]]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=key) == sorted(((i, own[t], least[group[own[t]]]) for i, t in rows), key=key)


@pytest.mark.parametrize("radius", [1, 3, 4, 5])
def test_every_pair_within_the_radius_meets(radius):
    rng, family = random.Random(radius), [m & (1 << 64) - 1 for m in simhash.masks(radius)]
    assert len(family) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(m & flips == 0 for m in family)


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """Many labels in one bucket: every two of them share a group."""
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(12), 6)) for _ in range(60)})
    df = spark.createDataFrame([(f, f if i % 3 else fps[0]) for i, f in enumerate(fps)], "fp long, label long")
    groups = {}
    for r in simhash._meetings(df, 1).collect():
        groups.setdefault((r.t, r.key, r.i, r.j), set()).add((r.fp, r.label))
    met = {(a, b) for g in groups.values() for a, la in g for b, lb in g if la != lb}
    label = {f: f if i % 3 else fps[0] for i, f in enumerate(fps)}
    for a in fps:
        for b in fps:
            if label[a] != label[b] and bin(a ^ b).count("1") <= 1:
                assert (a, b) in met


def test_exploded_rows_are_not_broadcast(spark):
    """Spark takes rows of many masks for as few as the fingerprints they come from; broadcast, they fill the driver."""
    fps = spark.range(300).selectExpr("id * 7 % 256 as fp", "id % 5 as label")
    for df in (simhash._inside(fps.select("fp"), 4), simhash._mixed(simhash._buckets(fps, simhash.masks(4)))):
        assert df.collect() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_one_of_each(made, spark):
    text = " ".join(f"t{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (9, text + " end"), (1, "another text that stands alone here"), (None, text), (8, None), (4, "")]
    kept = simhash.one_of_each(made(rows))
    assert kept.columns == made(rows).columns
    assert sorted((r.doc_id, r.text[:3] if r.text else r.text) for r in kept.collect()) == [(1, "ano"), (3, "t0 "), (4, "")]
    assert simhash.one_of_each(made([])).count() == 0 and simhash.near_duplicates(made([])).count() == 0
