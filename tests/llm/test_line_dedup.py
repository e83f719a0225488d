import random

import pytest
from hauldeck.llm import line_dedup
from hauldeck.llm.shared import content_key
from pyspark.sql import functions as F

from corpus_cases import LONG, components, edit_distance, made  # noqa: F401


def some_docs():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(24, 60))) for _ in range(12)]
    docs = [(1, None), (2, ""), (3, "\n \n"), (None, base[0]), (4, LONG), (4, LONG + "y"), (5, "short"), (6, "short\nshore")]
    for k in range(50):
        lines = []
        for _ in range(rng.randint(1, 5)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                i, op = rng.randrange(len(s)), rng.randrange(3)
                s[i : i + (op != 0)] = [] if op == 1 else [rng.choice("xyzé")]
            lines.append("".join(s))
        docs.append((10 + k % 45, "\n".join(lines)))
    return [*docs, docs[-1]]


def expected_removed(docs, edits):
    rows = sorted({(i is None, i or 0, _key(t), p, line) for i, t in docs for p, line in enumerate((t or "").split("\n"))})
    lines = {r[4] for r in rows if r[4].strip(" \t\r\x0b\x0c")}
    group = components(lines, lambda a, b: min(len(a), len(b)) >= line_dedup.SHORTEST and abs(len(a) - len(b)) <= edits and len(a) < 1000 and edit_distance(a, b) <= edits or len(a) > 1000 and a[:-1] == b or len(b) > 1000 and b[:-1] == a)
    seen, out = set(), {}
    for none, i, key, p, line in rows:
        out.setdefault((None if none else i, key), [])
        if line.strip(" \t\r\x0b\x0c") and group[line] in seen:
            out[None if none else i, key].append(p)
        seen.add(group.get(line))
    return out


def _key(text):
    import hashlib

    return hashlib.md5((text or "").encode()).digest()


@pytest.mark.parametrize("members,block", [(line_dedup.MEMBERS, line_dedup.BLOCK), (2, 3)])
def test_equals_brute_force(made, monkeypatch, members, block):
    monkeypatch.setattr(line_dedup, "MEMBERS", members)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    docs = some_docs()
    got = {(r.doc_id, bytes(r.doc)): r.removed for r in line_dedup.removed_lines(made(docs)).collect()}
    expected = expected_removed(docs, line_dedup.EDITS)
    assert sum(map(len, expected.values())) > 60 and got == expected


@pytest.mark.parametrize("links", [1, 2])
def test_rounds_equal_brute_force(made, monkeypatch, links):
    """Lines that gave as many links as they may are asked again, however few that are."""
    for name, value in (("MEMBERS", 2), ("BLOCK", 5), ("LINKS", links)):
        monkeypatch.setattr(line_dedup, name, value)
    docs = some_docs()
    assert {(r.doc_id, bytes(r.doc)): r.removed for r in line_dedup.removed_lines(made(docs)).collect()} == expected_removed(docs, line_dedup.EDITS)


def test_lines_of_few_links_are_asked_once(made, monkeypatch):
    """24 lines meet at their beginning, each has one partner: the first round finds all links and is the last."""
    rng, rounds, real = random.Random(4), [], line_dedup._block_links
    monkeypatch.setattr(line_dedup, "_block_links", lambda *a: rounds.append(1) or real(*a))
    ends = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    docs = [(2 * k + copy, "one common beginning" + end[:-1] + "xy"[copy]) for k, end in enumerate(ends) for copy in (0, 1)]
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(made(docs)).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(24)} and len(rounds) == 1


def test_shuffle_instead_of_broadcast(made, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOOKED_UP", 0)
    docs = some_docs()
    assert {(r.doc_id, bytes(r.doc)): r.removed for r in line_dedup.removed_lines(made(docs)).collect()} == expected_removed(docs, line_dedup.EDITS)


def test_texts(made):
    a, b = "the first line of this document", "another line that is long enough"
    docs = made([(1, f"{a}\n\n{b}"), (2, f"own text of the second one\n{a}!\n\n"), (3, b), (4, None), (3, b)])
    got = sorted([(r.doc_id, r.text, r.n_chars) for r in line_dedup.without_repeated_lines(docs).collect()], key=str)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert got == [(1, f"{a}\n\n{b}", 65), (2, "own text of the second one\n\n", 28), (3, "", 0), (3, "", 0), (4, None, None)]
    assert line_dedup.without_repeated_lines(made([])).count() == 0 and line_dedup.removed_lines(made([])).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_band_equals_edit_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(400):
        a = [rng.choice("ab😀é") for _ in range(rng.randint(5, 30))]
        b = a[:]
        for _ in range(rng.randint(0, edits + 2)):
            i, op = rng.randrange(len(b)), rng.randrange(3)
            b[i : i + (op != 0)] = [] if op == 1 and len(b) > 5 else [rng.choice("abc")]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w"), (F.levenshtein("a", "b", edits) >= 0).alias("l")).collect()
    assert all(r.w == r.l == (edit_distance(r.a, r.b) <= edits) for r in got) and len({r.w for r in got}) == 2


def test_no_python_in_the_plan(made):
    assert "Python" not in line_dedup.removed_lines(made([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert content_key(F.lit("x")) is not None


def test_lines_of_white_space_stay(made):  # noqa: F811
    docs = [(1, "a line of text\n\t\n \r\nend one"), (2, "another line\n\t\n \r\nend two"), (3, "\t")]
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(made(docs)).collect()} == {1: [], 2: [], 3: []}
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(made(docs)).collect()} == dict(docs)


def test_key_code_is_small_enough_to_be_compiled(spark):
    """The JVM never compiles a method of more than 8,000 bytes; one expression per probe made a larger one."""
    docs = spark.createDataFrame([(1, "a line that is long enough to be matched")], "doc_id long, text string")
    lines = line_dedup.lines_of(docs).select(F.xxhash64("line").alias("id"), "line")
    keys = line_dedup._keys(lines, line_dedup.EDITS)
    assert keys.count() == 12 and keys.filter("offered = 1").count() == line_dedup.EDITS + 1
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(keys._jdf.queryExecution().executedPlan())
    assert parts.size() and all(parts.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(parts.size()))
