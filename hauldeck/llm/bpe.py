"""Byte-level BPE: texts to token ids and back, by replaying the merges over all words of a block of documents.

The vocabulary (ranks of byte strings) is a parameter and has a fixed size,
so it is broadcast. Every task works on its own documents in blocks of
bounded size; nothing is shuffled, and a lost task is repeated from the input.
"""

import base64
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

BLOCK_BYTES = 4 << 20  # bytes of text that are replayed together
REMEMBERED = 60_000  # words a task keeps from block to block, twice at most
LONG = 64  # characters; longer words are merged one by one
ONE = [bytes([b]) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The vocabulary's merges as a sorted table: pair of tokens -> rank of what they make."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.one = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[w[:i]] * self.size + ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks)
        self.pairs, self.made = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where the pair is none."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)


class Index:
    """From a rank to the positions of its pair, ranks in order."""

    def __init__(self):
        self.where, self.order = {}, []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        real = ranks >= 0
        ranks, positions = ranks[real], positions[real]
        if not len(ranks):
            return
        by = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[by], positions[by]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for r, a, b in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            if r not in self.where:
                heappush(self.order, r)
                self.where[r] = []
            self.where[r].append(positions[a:b])

    def pop(self):
        """The lowest rank and its positions, ascending and distinct."""
        r = heappop(self.order)
        found = self.where.pop(r)
        return r, np.unique(np.concatenate(found) if len(found) > 1 else found[0])


def replay(words: list[bytes], merges: Merges) -> list[np.ndarray]:
    """Token ids of each word; a word that is a token itself is that token.

    All words lie in one row of tokens. An inverted index leads from a pair's
    rank to the positions where it occurs; ranks are applied in order, each to
    all its positions at once, and only the merged pairs' neighbours are looked
    up anew. Of one word only the leftmost position is merged at a time, the
    others go back into the index: a merge may open a pair of lower rank, which
    comes first then. So every word sees its merges lowest rank first, leftmost first.
    """
    out = [np.array([r], np.int32) if (r := merges.ranks.get(w)) is not None else None for w in words]
    rest = [k for k, x in enumerate(out) if x is None]
    lengths = np.array([len(words[k]) for k in rest], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    size = int(start[-1])
    token = merges.one[np.frombuffer(b"".join(words[k] for k in rest), np.uint8)]
    owner = np.repeat(np.arange(len(rest)), lengths)
    after, before, alive = np.arange(1, size + 1), np.arange(-1, size - 1), np.ones(size, bool)
    filled = lengths > 0
    before[start[:-1][filled]] = -1
    after[start[1:][filled] - 1] = -1
    index = Index()
    p = np.flatnonzero(after >= 0)
    index.add(merges.rank(token[p], token[p + 1]), p)
    while index.order:
        r, p = index.pop()
        p = p[alive[p] & (after[p] >= 0)]
        p = p[merges.rank(token[p], token[after[p]]) == r]
        if not len(p):
            continue
        first = np.ones(len(p), bool)
        first[1:] = owner[p[1:]] != owner[p[:-1]]
        if not first.all():
            index.add(np.full(len(p) - int(first.sum()), r), p[~first])
            p = p[first]
        q = after[p]
        n, b = after[q], before[p]
        token[p], alive[q], after[p] = r, False, n
        right, left = n >= 0, b >= 0
        before[n[right]] = p[right]
        index.add(np.concatenate([merges.rank(token[p[right]], token[n[right]]), merges.rank(token[b[left]], token[p[left]])]), np.concatenate([p[right], b[left]]))
    ends = np.concatenate([[0], np.cumsum(alive)])[start]
    ids = token[alive].astype(np.int32)
    for j, k in enumerate(rest):
        out[k] = ids[ends[j] : ends[j + 1]]
    return out


def replay_long(word: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The same for one long word, position by position, in time n log n even if one pair fills it."""
    if word in ranks:
        return np.array([ranks[word]], np.int32)
    piece: list = [ONE[b] for b in word]
    size = len(piece)
    after, before = [*range(1, size), -1], list(range(-1, size - 1))
    rank = ranks.get
    queue = [(r, p) for p in range(size - 1) if (r := rank(piece[p] + piece[p + 1])) is not None]
    heapify(queue)
    while queue:
        r, p = heappop(queue)
        if piece[p] is None or (q := after[p]) < 0 or rank(whole := piece[p] + piece[q]) != r:
            continue
        piece[p], piece[q], after[p] = whole, None, (n := after[q])
        if n >= 0:
            before[n] = p
        for a, c in ((before[p], p), (p, n)):
            if a >= 0 and c >= 0 and (s := rank(piece[a] + piece[c])) is not None:
                heappush(queue, (s, a))
    return np.array([ranks[x] for x in piece if x is not None], np.int32)


class Memory:
    """Remembers values of the last keys, in two generations of bounded size."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """Keys without a value; known ones are kept for this block, and old ones renewed."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        out = []
        for k in keys:
            if k not in self.new:
                if k in self.old:
                    self.new[k] = self.old[k]
                else:
                    out.append(k)
        return out


class Encoder:
    """Texts to ids with one vocabulary and one word pattern.

    Text is cut at single spaces first: a space can only start a match, so the
    matches of ' word' do not depend on what stands around it, unless a space
    touches other white space. Texts where that happens go through the
    pattern as a whole.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.spaced, self.first, self.words = Memory(), Memory(), Memory()

    def _learn(self, matches) -> None:
        new = self.words.missing(matches)
        short, long = [w for w in new if len(w) <= LONG], [w for w in new if len(w) > LONG]
        for w, ids in zip(short, replay([w.encode() for w in short], self.merges), strict=True):
            self.words.new[w] = ids.tobytes()
        for w in long:
            self.words.new[w] = replay_long(w.encode(), self.merges.ranks).tobytes()

    def _values(self, memory: Memory, chunks: list[str], lead: str) -> list:
        """Ids of lead + chunk for each chunk; None where only the whole text tells."""
        new = memory.missing(chunks)
        found = {c: None if c and (c[0].isspace() or c[-1].isspace()) or lead and not c else self.find(lead + c) for c in new}
        self._learn({w for m in found.values() if m for w in m})
        ids = self.words.new
        for c, m in found.items():
            memory.new[c] = None if m is None else b"".join([ids[w] for w in m])
        return [memory.new[c] for c in chunks]

    def block(self, texts: pa.StringArray) -> pa.ListArray:
        """For each text its ids; no text is null."""
        parts = pc.split_pattern(texts, " ")
        ends = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        heads = pc.take(parts.values, pa.array(ends[:-1])).dictionary_encode()
        values = self._values(self.spaced, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), " ")
        codes[ends[:-1]] = len(values) + heads.indices.to_numpy()
        values += self._values(self.first, heads.dictionary.to_pylist(), "")
        odd = np.array([v is None for v in values], bool)
        alone = np.diff(ends) > 1  # an empty head is a text that starts with a space, or is empty
        odd_text = np.logical_or.reduceat(odd[codes], ends[:-1]) | alone & np.array([not x for x in heads.to_pylist()], bool)
        values = [v or b"" for v in values]
        size = np.array([len(v) // 4 for v in values], np.int64)
        flat = np.frombuffer(b"".join(values), np.int32)
        sizes = size[codes]
        upto = np.cumsum(sizes)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate([[0], upto])[ends]
        if not odd_text.any():
            return id_lists(bounds, ids)
        rows = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd_text).tolist():
            matches = self.find(texts[i].as_py())
            self._learn(set(matches))
            rows[i] = np.frombuffer(b"".join([self.words.new[w] for w in matches]), np.int32)
        return id_lists(np.cumsum([0, *map(len, rows)]), np.concatenate(rows))


def blocks(sizes: list[int], most: int = BLOCK_BYTES):
    """(from, to) of consecutive rows whose sizes sum up to about `most`; a row is never cut."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def id_lists(bounds: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


_held: dict = {}


def held(key, make):
    """One object of fixed size per Python worker, the last one asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def pieces_of(ranks: dict[bytes, int]) -> list:
    """The bytes of each id."""
    back: list = [None] * (max(ranks.values()) + 1 if ranks else 0)
    for piece, r in ranks.items():
        back[r] = piece
    return back


def decoded(ids: pa.ListArray, pieces: list) -> pa.Array:
    """The bytes that each list of ids stands for; null lists give null, unknown ids fail."""
    get = pieces.__getitem__
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
    real = ids.is_valid().to_numpy(zero_copy_only=False).tolist()
    return pa.array([b"".join(map(get, values[a:b].tolist())) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], real, strict=True)], pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] = ("doc_id",), text: str = "text", back: bool = False) -> DataFrame:
    """The `keep` columns and `ids` array<int> of every row's whole text; with `back` also `decoded`, the bytes of the ids.

    Null and empty texts have no ids. Repeated rows stay; other columns are
    not read. Very long texts are a block of their own. Words are remembered
    within a task only, so a worker's memory does not grow from task to task.
    """
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    key = (pattern, len(ranks), zlib.crc32(b"".join(b"%d %b " % (r, w) for w, r in ranks.items())))

    def run(batches):
        merges = held(key, lambda: Merges(shared.value[0]))
        encoder, pieces = Encoder(merges, shared.value[1]), pieces_of(merges.ranks) if back else []
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            for a, b in blocks(pc.binary_length(texts).to_pylist()):
                ids = encoder.block(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), ids, *([decoded(ids, pieces)] if back else [])], [*keep, "ids", *(["decoded"] if back else [])])

    fields = [*(docs.select(c).schema[0] for c in keep), StructField("ids", ArrayType(IntegerType())), *([StructField("decoded", BinaryType())] if back else [])]
    return docs.select(*keep, text).mapInArrow(run, StructType(fields))


def decode(spark: SparkSession, ranks: dict[bytes, int]):
    """A function from a column of id arrays to the bytes they stand for; null arrays give null, unknown ids fail."""
    shared = spark.sparkContext.broadcast(pieces_of(ranks))

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        return decoded(ids, shared.value)

    return run
