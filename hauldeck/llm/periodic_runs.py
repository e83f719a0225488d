"""Periodic runs of words by an enhanced suffix array.

A run is a stretch of words with a smallest period q that cannot be extended.
Its last square (two periods of words, e being the end) starts at i = e-2q;
the suffixes i and i+q agree in exactly q words, so both lie in the LCP
interval of depth q, in different children: a branching tandem repeat. For
each LCP interval the suffixes of all children but the largest ask, through
the inverse suffix array, whether their neighbours `depth` words before or
after are in the interval, too. Each square found is rotated left as far as
its period holds, and squares of one end that lie in a run of a smaller period
are merged into it. LCP intervals are met on a stack; no tree is stored.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import blocks

BLOCK_BYTES = 1 << 20  # bytes of text whose suffixes are sorted together
AT_ONCE = 1 << 18  # suffixes that ask for their neighbours at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the common words of neighbours, of a text in which no suffix begins another.

    Prefix doubling: only suffixes that still have an equal are sorted again.
    A rank is the first slot of its group; the ranks of each round give the
    common lengths by binary lifting.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ids[order[1:]] != ids[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        order[slots], first[slots] = at, new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank)
        h *= 2
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][order[:-1] + common] == levels[k][order[1:] + common]
        common[same] += 1 << k
    return order, rank, common


def _smaller_children(common: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (from, to, depth, child's from, child's to), all slots inclusive, of every child but the largest of each LCP interval that may hold a run.

    Of a run's words those a whole number of periods before its end begin
    suffixes of the interval of its last square; the first of them and the
    next agree in all whole periods but one. Intervals without that depth
    below them hold no run.
    """
    if not len(common):
        return np.empty((0, 5), np.int64)
    edges = np.flatnonzero(np.diff(common > 0)) + 1
    starts = np.concatenate([[0], edges])
    deep = np.maximum.reduceat(common, starts) >= shortest_repeat(least, exponent)
    out = []
    for a, b in zip(starts[deep].tolist(), np.append(edges, len(common))[deep].tolist(), strict=True):
        stack: list = []  # [depth, first slot, deepest below, children's last slots]
        for k, d in enumerate([*common[a:b].tolist(), 0], a):
            left, deepest = k, d
            while stack and stack[-1][0] > d:
                depth, left, below, cuts = stack.pop()
                deepest = max(deepest, below)
                if deepest >= max(exponent, least // depth) * depth - depth:
                    bounds = [left - 1, *cuts, k]
                    sizes = [y - x for x, y in zip(bounds, bounds[1:])]
                    skip = sizes.index(max(sizes))
                    out.extend((left, k, depth, bounds[c] + 1, bounds[c + 1]) for c in range(len(sizes)) if c != skip)
            if stack and stack[-1][0] == d:
                stack[-1][3].append(k)
                stack[-1][2] = max(stack[-1][2], deepest)
            elif d:
                stack.append([d, left, deepest, [k]])
    return np.array(out, np.int64).reshape(-1, 5)


def _branching_squares(order: np.ndarray, rank: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Distinct (end, period) of the branching tandem repeats, ascending."""
    found = [np.empty((0, 2), np.int64)]
    upto = np.cumsum(children[:, 4] - children[:, 3] + 1)
    a = 0
    while a < len(children):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + AT_ONCE)))
        some = children[a:b]
        sizes = some[:, 4] - some[:, 3] + 1
        low, high, depth, own, last = np.repeat(some, sizes, axis=0).T
        at = order[own + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        for start, other in ((at, at + depth), (at - depth, at - depth)):
            there = other >= 0
            slot = rank[np.where(there, other, 0)]
            meets = there & (slot >= low) & (slot <= high) & ((slot < own) | (slot > last))
            found.append(np.stack([start[meets] + 2 * depth[meets], depth[meets]], 1))
        a = b
    return np.unique(np.concatenate(found), axis=0)


def _rotated(ids: np.ndarray, start: int, period: int) -> int:
    """The first word from which the period holds up to `start`."""
    step = 16
    while start:
        a = max(0, start - step)
        differ = np.flatnonzero(ids[a:start] != ids[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return start


def shortest_repeat(least: int, exponent: int) -> int:
    """So many words at least occur twice in a text that has a run."""
    return min(max((exponent - 1) * q, least - q) for q in range(1, least + 1))


def runs_of(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, of at least `least` words and `exponent` (2 or more) periods, in a text that ends in a word of its own."""
    order, rank, common = suffix_array(ids)
    out, end, low = [], -1, 0
    for e, q in _branching_squares(order, rank, _smaller_children(common, least, exponent)).tolist():
        if e == end and e - 2 * q >= low:
            continue  # part of a run of a smaller period
        start = _rotated(ids, e - 2 * q, q)
        end, low = e, start if e != end else min(low, start)
        if e - start >= max(least, exponent * q):
            out.append((start, e - start, q))
    return sorted(out)


def runs_in_block(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (list of words), by start and period.

    All texts make one row of words, each text's words being its own and its
    end a word that nothing else equals. Texts in which no word group as long
    as `shortest_repeat` occurs twice have no run and are not sorted.
    """
    names: dict[bytes, int] = {}
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.array([names.setdefault(w, len(names) + 1) for t in texts for w in (*t, b"")], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = flat + owner * (len(names) + 1)
    width = shortest_repeat(least, exponent)
    out: list[list] = [[] for _ in texts]
    if len(ids) <= width:
        return out
    mixed = np.zeros(len(ids) - width + 1, np.uint64)
    for i in range(width):
        mixed = (mixed ^ ids[i : i + len(mixed)].astype(np.uint64)) * _MIX
        mixed ^= mixed >> np.uint64(29)
    by = np.argsort(mixed)
    twice = np.flatnonzero(mixed[by[1:]] == mixed[by[:-1]])
    wanted = np.zeros(len(texts), bool)
    wanted[owner[by[twice]]] = True
    chosen = np.flatnonzero(wanted)
    if not len(chosen):
        return out
    first = np.concatenate([[0], np.cumsum(sizes[chosen])])
    for start, length, period in runs_of(np.unique(ids[wanted[owner]], return_inverse=True)[1], least, exponent):
        k = int(np.searchsorted(first, start, "right")) - 1
        out[chosen[k]].append((start - int(first[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that repeat an earlier period of a run."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()] if runs else words)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns, `runs` (start, length, period in words; by start, then period) and `collapsed` of every whole text.

    Words are runs without ASCII white space, as they are written. Null,
    empty and wordless texts have no runs and an empty collapsed text.
    Repeated rows stay; other columns are not read. Nothing is shuffled; a
    very long text is a block of its own, in memory linear in its words.
    """
    keep = list(keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "").cast(pa.binary())
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                words = [t.split() for t in texts.slice(a, b - a).to_pylist()]  # of bytes: ASCII white space only
                found = runs_in_block(words, least, exponent)
                spans = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                short = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(spans, kind), short], [*keep, "runs", "collapsed"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, text).mapInArrow(run, f"{head}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
