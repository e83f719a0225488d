import random

import pytest
from hauldeck.llm import decontaminate as d

from corpus_cases import LONG, made  # noqa: F401


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def case(spark, made):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (None, "an item that has no id at all"), (5, "a second row of item five is here")]
    docs = [(1, None), (2, ""), (3, LONG), (None, "x an ITEM that has no id at all y")]
    for k in range(120):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            own = items[rng.randrange(40)][1].upper().split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = "other"
            at = rng.randint(0, len(parts))
            parts[at:at] = own
        docs.append((k % 100, " ".join(parts)))
    docs.append(docs[-1])
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    sets = {}
    for i, t in items:
        sets.setdefault(i, set()).update(grams(t))
    expected = sorted([(i, k, len(s & grams(t)), len(s)) for i, t in docs for k, s in sets.items() if s and len(s & grams(t)) >= d.needed(len(s))], key=str)
    return made(docs), table, expected, docs


@pytest.mark.parametrize("most", [d.BROADCAST_SHINGLES, 0])
def test_both_ways_equal_brute_force(case, most):
    docs, items, expected, rows = case
    assert len(expected) > 30
    assert sorted([tuple(r) for r in d.contained(docs, items, most=most).collect()], key=str) == expected
    hit = {(e[0], e[1]) for e in expected}
    sets = {}
    kept = d.without_items(docs, items, most=most)
    assert kept.columns == docs.columns
    dirty = {t for i, t in rows if any(i == h[0] for h in hit)}
    clean = [(i, t) for i, t in rows if t not in dirty]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(c in got for c in clean) and not sets


@pytest.mark.parametrize("most", [d.BROADCAST_SHINGLES, 0])
def test_empty_tables(spark, made, most):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contained(made([(1, "a b c d e f")]), none, most=most).count() == 0
    assert d.without_items(made([(1, "a b c d e f")]), none, most=most).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.contained(made([]), some, most=most).count() == 0


def test_needed():
    assert [d.needed(n) for n in (1, 4, 5, 10, 31)] == [1, 4, 4, 8, 25]
