import pytest

LONG = "word " * 40_000 + "x" * 50_000


@pytest.fixture(scope="session")
def made(spark):
    """documents from (doc_id, text) rows, with a further column whose name clashes with inner ones."""

    def build(rows):
        rows = [(i, t, "en", "s", None if t is None else len(t), "clash", 1) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, root int").repartition(3)

    return build


def components(nodes, linked):
    """Union-find over all pairs: {node: smallest node reachable}."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
