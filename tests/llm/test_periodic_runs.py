import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus_cases import LONG, made  # noqa: F401
from hauldeck.llm import periodic_runs, queries


def brute(words, least=6, exponent=4):
    """All (start, length, period): for each period the maximal stretches, smallest period first."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                stretch = words[i : j + q]
                if not any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def texts(rng, count):
    for _ in range(count):
        kind, out = rng.randrange(4), []
        for _ in range(rng.randint(1, 6)):
            root = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
            out += root * rng.randint(1, 6) + root[: rng.randrange(len(root))]
            out += [rng.choice("abcdefgh") for _ in range(rng.randrange(6))]
        yield [w if kind else w * 2 for w in out]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, exponent):
    some = [*texts(random.Random(least), 1200), [], ["a"], ["a"] * 5, ["a"] * 6, list("ab" * 50)]
    found = periodic_runs.runs_in_block([[w.encode() for w in t] for t in some], least, exponent)
    assert found == [brute(t, least, exponent) for t in some]
    assert sum(map(len, found)) > 300


def test_suffix_array():
    rng = random.Random(5)
    ids = np.array([*(rng.randrange(3) for _ in range(500)), *([1, 2] * 200), 9])
    order, rank, common = periodic_runs.suffix_array(ids)
    want = sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
    assert order.tolist() == want and rank[order].tolist() == list(range(len(ids)))
    for k, c in enumerate(common.tolist()):
        a, b = ids[want[k] :], ids[want[k + 1] :]
        assert (a[:c] == b[:c]).all() and a[c] != b[c]


def test_long_periodic_text_is_quick():
    words = [b"x%d" % (i % 7) for i in range(150_000)]
    assert periodic_runs.runs_in_block([words], 6, 4) == [[(0, 150_000, 7)]]


def changed(doc_id, words):
    """The stated change of every tenth text."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_equals_brute_force(spark, tmp_path, made):  # noqa: F811
    rng = random.Random(11)
    rows = [(i, " ".join(t) + rng.choice(["", " ", "\n", "　x"])) for i, t in enumerate(texts(rng, 300))]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, LONG), (1003, LONG), (1004, "A a " * 4), (1005, "say " * 6), (None, "tick tock " * 5)]
    rows += [(2000 + i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(60)))) for i in range(200)]
    made(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        if i is not None:
            words = changed(i, words)
        runs = [(0, 40_000, 1)] if i == 1003 and len(set(words[:40_000])) == 1 else brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
        sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(kept))]
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x or 0) for x in r[:5]) + r[6:]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 100


def test_empty_table(made):  # noqa: F811
    assert periodic_runs.periodic_runs(made([(1, "a")]).limit(0)).collect() == []
