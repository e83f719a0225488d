"""Hard negatives: high-scoring rows of another label, found by rotated one-bit codes.

Every vector is rotated by random signs and Walsh-Hadamard steps and keeps one
bit per coordinate, the sign. With x the unit vector of the signs, the row
stores how long it is along x (its alignment). A query's product with x is
estimated from popcounts of its bit planes; the rest of both vectors is
orthogonal to x, so by Cauchy-Schwarz their product differs from alignment
times estimate by no more than the product of the two residual lengths, plus
what the bit planes leave out. The interval is certain, not likely: rows whose
interval cannot reach the answer are left out, all others are scored with
whole numbers. No row is lost.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import sorted_groups, stage

ROWS = 8_192  # rows of a block
ANCHORS = 2_048  # anchors of a block
SLICE = 1 << 17  # pairs whose intervals are held at a time
SCORED = 1 << 14  # pairs that are scored at a time
PLANES = 8  # bits per coordinate of a rotated anchor
SEED = 42
SLACK = 1e-6  # share of the lengths' product that rounding may cost
EXACT = float(1 << 53)


def padded_size(dim: int) -> int:
    """Coordinates after rotation: a power of two, whole words of 64 bits."""
    return max(64, 1 << max(0, dim - 1).bit_length())


def rotated(vectors: np.ndarray) -> np.ndarray:
    """The rows of a matrix, rotated: three times random signs, then a Walsh-Hadamard transform. Lengths and products stay."""
    n, dim = vectors.shape
    size = padded_size(dim)
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (3, size))
    out = np.zeros((n, size))
    out[:, :dim] = vectors
    for s in signs:
        out *= s
        h = 1
        while h < size:
            halves = out.reshape(n, -1, 2, h)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], 2).reshape(n, size)
            h *= 2
        out /= np.sqrt(size)
    return out


def codes_of(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits as 64-bit words, the alignment with the signs' unit vector, and the length of what is left."""
    words = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    align = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return words, align, np.sqrt(np.maximum((turned**2).sum(1) - align**2, 0))


class Query:
    """Anchors' bit planes, and what is needed to bound their products with coded rows."""

    def __init__(self, turned: np.ndarray):
        self.size = turned.shape[1]
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None])
        left = turned - self.low[:, None] - whole * self.step[:, None]
        self.error = np.abs(left).sum(1) / np.sqrt(self.size)
        whole = whole.astype(np.int64)
        self.planes = [np.packbits((whole >> p & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
        self.total = (whole * self.step[:, None] + self.low[:, None]).sum(1)
        self.square = (turned**2).sum(1)

    def bounds(self, which: np.ndarray, words: np.ndarray, align: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate of each product of the anchors `which` with the coded rows, and how far the product can be from it."""
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        above = np.zeros((len(which), len(words)), np.int64)
        for p, plane in enumerate(self.planes):
            for w in range(words.shape[1]):
                above += np.bitwise_count(plane[which, w][:, None] & words[None, :, w]).astype(np.int64) << p
        along = (2 * (self.low[which, None] * ones + self.step[which, None] * above) - self.total[which, None]) / np.sqrt(self.size)
        error = self.error[which, None]
        least = np.maximum(np.abs(along) - error, 0)
        across = np.sqrt(np.maximum(self.square[which, None] - least**2, 0))
        return align * along, align * error + residual * across + SLACK * (np.sqrt(self.square[which, None]) * (align + residual) + 1)


def scores_of(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Whole-number products of the rows of two matrices; `most` bounds every product."""
    if most < EXACT:  # doubles hold these sums exactly
        return np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("components are too large for 64-bit scores")
    return np.einsum("ij,ij->i", left, right)


def matrix_of(column: np.ndarray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(len(column), dim)


def indexed(rows: DataFrame, id: str, label: str, vector: str) -> tuple[DataFrame, int]:
    """id, label, key, vec, code, align, residual of every distinct row; and the vectors' size.

    Rows without an id, a label or a vector, or with a missing component, take
    no part. Shorter vectors are filled with zeros. Rows that are equal in id,
    label and vector are one; the key tells rows of one id apart.
    """
    real = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"))
    real = real.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    once = stage(real.withColumn("key", F.xxhash64("id", "label", "v")).dropDuplicates(["id", "key"]), "vectors")
    dim = max(1, once.agg(F.max(F.size("v"))).first()[0] or 0)

    def run(batches):
        for batch in batches:
            lists, n = batch.column(3), batch.num_rows
            sizes = np.diff(lists.offsets.to_numpy())
            whole = np.zeros((n, dim), np.int64)
            whole[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            words, align, residual = codes_of(rotated(whole.astype(np.float64)))
            packed = (pa.array([x.tobytes() for x in m], pa.binary()) for m in (whole, words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed, pa.array(align), pa.array(residual)], ["id", "label", "key", "vec", "code", "align", "residual"])

    coded = once.select("id", "label", "key", "v").mapInArrow(run, "id long, label long, key long, vec binary, code binary, align double, residual double")
    return stage(coded, "codes"), dim


def _met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """Rows and anchors dealt so that each block of rows meets each block of anchors once: i, j, and the columns of both, anchors with `wanted` set."""
    deal = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["id", "label", "key", "vec", "code", "align", "residual"]
    left = rows.select(deal(blocks[0], 1).alias("i"), every(blocks[1]).alias("j"), *cols, F.lit(None).cast("binary").alias("wanted"))
    right = anchors.select(every(blocks[0]).alias("i"), deal(blocks[1], 2).alias("j"), *cols, "wanted")
    return left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j")


class Block:
    """One block of rows and one of anchors."""

    def __init__(self, columns: list[np.ndarray], dim: int):
        _, _, self.id, self.label, self.key, vec, code, self.align, self.residual, wanted = columns
        self.vec = matrix_of(vec, dim)
        self.words = np.frombuffer(b"".join(code), np.uint64).reshape(len(code), -1)
        asks = np.array([w is not None for w in wanted])
        self.asked, self.rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        self.wanted = [np.frombuffer(wanted[k], np.int64) for k in self.asked.tolist()]
        self.query = Query(rotated(self.vec[self.asked].astype(np.float64))) if len(self.asked) else None
        self.most = float(np.abs(self.vec).max(initial=0)) ** 2 * dim

    def slices(self, rows: np.ndarray, asked: np.ndarray):
        """(anchors, estimate, radius) for a few anchors at a time."""
        step = max(1, SLICE // max(1, len(rows)))
        for a in range(0, len(asked), step):
            some = asked[a : a + step]
            yield some, *self.query.bounds(some, self.words[rows], self.align[rows], self.residual[rows])

    def score(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        parts = [slice(a, a + SCORED) for a in range(0, len(rows), SCORED)]
        return np.concatenate([np.empty(0, np.int64), *(scores_of(self.vec[self.asked[anchors[p]]], self.vec[rows[p]], self.most) for p in parts)])

    def floor_of(self, estimate: np.ndarray, allowed: np.ndarray, some: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """A score that `count` allowed rows of each anchor reach: the lowest of those with the best estimates; least possible if there are fewer."""
        guess = np.where(allowed, estimate, -np.inf)
        k = min(count, len(rows))
        best = np.argpartition(-guess, k - 1, axis=1)[:, :k]
        scores = self.score(np.repeat(some, k), rows[best.reshape(-1)]).reshape(len(some), k).astype(np.float64)
        return np.where(allowed.sum(1) >= count, scores.min(1), -np.inf)


def _first(group: np.ndarray, score: np.ndarray, id: np.ndarray, key: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first `count` of each group, higher scores first, then smaller ids and keys."""
    order = np.lexsort((key, id, -score, group))
    g = group[order]
    start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
    return order[place < count]


def _positives_of(block: Block, count: int):
    """(anchor, row, score) of the best rows of each anchor's label; the anchor itself is none."""
    for label in np.unique(block.label[block.asked]).tolist():
        rows = block.rows[block.label[block.rows] == label]
        asked = np.flatnonzero(block.label[block.asked] == label)
        if not len(rows):
            continue
        for some, estimate, radius in block.slices(rows, asked):
            own = block.asked[some]
            allowed = (block.id[own][:, None] != block.id[rows][None, :]) | (block.key[own][:, None] != block.key[rows][None, :])
            least = block.floor_of(estimate, allowed, some, rows, count)
            x, y = np.nonzero(allowed & (estimate + radius >= least[:, None]))
            score = block.score(some[x], rows[y])
            kept = _first(x, score, block.id[rows[y]], block.key[rows[y]], count)
            yield some[x[kept]], rows[y[kept]], score[kept]


def _negatives_of(block: Block, count: int, percent: int):
    """(anchor, place of the positive, row, score) of the best rows of other labels between `percent` of the positive's score and all of it."""
    for some, estimate, radius in block.slices(block.rows, np.arange(len(block.asked))):
        rows = block.rows
        other = block.label[block.asked[some]][:, None] != block.label[rows][None, :]
        wanted = [block.wanted[k] for k in some.tolist()]
        high = np.array([w.max(initial=-1) for w in wanted], np.float64)  # negative scores have no band
        low = np.array([w[w >= 0].min(initial=np.iinfo(np.int64).max) for w in wanted], np.float64) * (percent / 100)
        # a row that is certainly below the band of the lowest positive, or above that of the highest, is in none
        x, y = np.nonzero(other & (estimate + radius >= low[:, None] - 1) & (estimate - radius <= high[:, None]))
        if not len(x):
            continue
        score = block.score(some[x], rows[y])
        starts = np.searchsorted(x, np.arange(len(some) + 1))
        for a, goals in enumerate(wanted):
            s, r = score[starts[a] : starts[a + 1]], rows[y[starts[a] : starts[a + 1]]]
            for k, goal in enumerate(goals.tolist()):
                fits = np.flatnonzero((100 * s >= percent * goal) & (s <= goal))
                kept = fits[_first(np.zeros(len(fits), np.int64), s[fits], block.id[r[fits]], block.key[r[fits]], count)]
                if len(kept):
                    yield np.full(len(kept), some[a]), np.full(len(kept), k), r[kept], s[kept]


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, percent: int = 80, id: str = "id", label: str = "label", vector: str = "vector") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is an SQL condition on `id`. An anchor's positives are the first
    other rows of its label by whole-number inner product (ties by smaller id);
    for each of them come the first rows of other labels whose score is from
    `percent` per cent of the positive's score to all of it. Positives with
    a negative score have none. See `indexed` for rows that take no part and
    for repeated ones; an empty table or no anchor gives no row.

    All anchors meet all rows, in blocks; each block gives a few rows per
    anchor, which a ranking without a shuffle of more merges exactly.
    """
    index, dim = indexed(rows, id, label, vector)
    asking = index.filter(anchors)
    counts = [max(1, -(-df.count() // size)) for df, size in ((index, ROWS), (asking, ANCHORS))]

    def near(batches):
        for columns in sorted_groups(batches, 2):
            block = Block(columns, dim)
            if len(block.asked) and len(block.rows):
                for a, r, s in _positives_of(block, positives):
                    own = block.asked[a]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.id[own], block.key[own], block.id[r], block.key[r], s)], ["anchor_id", "anchor_key", "id", "key", "score"])

    none = F.lit(None).cast("binary")
    unasked = asking.withColumn("wanted", F.lit(b""))
    met = _met(index.withColumn("wanted", none), unasked, counts)
    found = met.mapInArrow(near, "anchor_id long, anchor_key long, id long, key long, score long")
    order = [F.col("score").desc(), "id", "key"]
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor_id", "anchor_key").orderBy(*order))).filter(F.col("place") <= positives)
    first = stage(first.select("anchor_id", "anchor_key", (F.col("place") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    goals = first.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("g"))

    def packed(batches):
        for batch in batches:
            goals = [np.array([x["positive_score"] for x in g], np.int64).tobytes() for g in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(goals, pa.binary())], ["id", "key", "wanted"])

    wanted = goals.mapInArrow(packed, "id long, key long, wanted binary")

    def hard(batches):
        for columns in sorted_groups(batches, 2):
            block = Block(columns, dim)
            if len(block.asked) and len(block.rows):
                for a, k, r, s in _negatives_of(block, negatives, percent):
                    own = block.asked[a]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.id[own], block.key[own], k.astype(np.int32), block.id[r], block.key[r], s)], ["anchor_id", "anchor_key", "place", "id", "key", "score"])

    met = _met(index, stage(asking.join(wanted, ["id", "key"]), "goals"), counts)
    bad = met.mapInArrow(hard, "anchor_id long, anchor_key long, place int, id long, key long, score long")
    ranked = bad.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    return ranked.join(first, ["anchor_id", "anchor_key", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
