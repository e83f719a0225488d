"""Benchmark items inside documents.

Containment search with size-partitioned MinHash: an item of n distinct
five-word shingles counts as found if at least 0.8 n of them occur in a
document. Items are partitioned by n; within a partition the sketch of an item
is its k smallest shingle hashes, k being one more than the shingles that may
be missing, so a document that holds the item always holds one of them. A
document's sketch is all its shingle hashes up to the partition's largest
sketch hash. What meets there is verified on the shingles themselves.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_key, stage, texts_of

WIDTH, SHARE = 5, 0.8
BROADCAST_SHINGLES = 200_000  # items with more shingles in all are joined by a shuffle instead
WORDS = 300_000  # word hashes a task remembers
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """Distinct shingles of lower-cased words; a text of fewer words has none."""
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def needed(n: int, share: float = SHARE) -> int:
    return max(1, math.ceil(share * n - 1e-9))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """A 64-bit hash per shingle, in text order: a mixed sum over the word hashes."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out += h[k : k + n] * FACTORS[k] if n > 0 else out
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Sketches:
    """The items' index: per size partition the sorted sketch hashes, their items and the largest hash."""

    def __init__(self, items: list[tuple], width: int, share: float):
        self.width, self.share = width, share
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        parts: dict[int, list] = {}
        words = WordHashes()
        for k, s in enumerate(self.sets):
            h = np.sort(np.concatenate([shingle_hashes(x.split(b" "), words, width) for x in s]))
            parts.setdefault(len(s).bit_length(), []).extend((v, k) for v in h[: len(s) - needed(len(s), share) + 1].tolist())
        self.parts = []
        for rows in parts.values():
            rows.sort()
            self.parts.append((np.array([v for v, _ in rows], np.uint64), np.array([k for _, k in rows])))

    def found_in(self, text: bytes, hashes: WordHashes) -> list[tuple]:
        """(item, shared shingles, item's shingles) of every item the text contains."""
        words = text.lower().split()
        own = shingle_hashes(words, hashes, self.width)
        candidates: set[int] = set()
        for values, owners in self.parts:
            sketch = own[own <= values[-1]]
            at = np.minimum(np.searchsorted(values, sketch), len(values) - 1)
            hit = np.unique(sketch[values[at] == sketch])
            if len(hit):
                candidates.update(owners[np.isin(values, hit)].tolist())
        if not candidates:
            return []
        have = shingles(text, self.width)
        counts = [(k, len(self.sets[k] & have)) for k in sorted(candidates)]
        return [(self.ids[k], c, len(self.sets[k])) for k, c in counts if c >= needed(len(self.sets[k]), self.share)]


def _item_shingles(items: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(i, s) for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True) for s in sorted(shingles(t, width))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], batch.schema.field(0).type), pa.array([s for _, s in rows], pa.binary())], ["item_id", "shingle"])

    kind = dict(items.select("item_id").dtypes)["item_id"]
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, shingle binary").distinct()


def _sketches(shingled: DataFrame, width: int, share: float) -> Sketches:
    rows: dict = {}
    for i, s in shingled.collect():
        rows.setdefault(i, set()).add(bytes(s))
    return Sketches(sorted(rows.items(), key=lambda r: (r[0] is None, r[0] or 0)), width, share)


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for every row of docs and every item it contains.

    Rows of one item_id form one item. Items and documents of fewer than
    `width` words, null and empty ones have no shingles and are in no result.
    Up to `most` shingles of all items go to every task (the count is checked
    first); beyond that both sides are shuffled by shingle hash.
    """
    shingled = stage(_item_shingles(items, width), "items")
    if shingled.count() > most:
        keyed = docs.select("doc_id", "text").withColumn("_key", content_key(F.col("text")))
        found = _contained_by_join(keyed, shingled, width, share)
        return keyed.select("doc_id", "_key").join(found, "_key").select("doc_id", "item_id", "n_shared", "n_shingles")
    shared = docs.sparkSession.sparkContext.broadcast(_sketches(shingled, width, share))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [(k, *f) for k, t in enumerate(texts_of(batch.column(1))) for f in shared.value.found_in(t, hashes)]
            at, item, c, n = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind), pa.array(c, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "item_id", "n_shared", "n_shingles"])

    doc, item = (dict(d.dtypes)[c] for d, c in ((docs, "doc_id"), (items, "item_id")))
    kind = {"int": pa.int32(), "bigint": pa.int64()}.get(item, pa.string())
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, item_id {item}, n_shared int, n_shingles int")


def _contained_by_join(keyed: DataFrame, shingled: DataFrame, width: int, share: float) -> DataFrame:
    """(_key, item_id, n_shared, n_shingles) by shuffles only; every text is searched once however often it occurs."""
    sizes = shingled.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n_shingles"))
    k = F.col("n_shingles") - F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * share - 1e-9)) + 1
    part = F.floor(F.log2("n_shingles"))
    of_item = sizes.withColumnRenamed("item_id", "_item")
    hashed = shingled.join(of_item, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "shingle", F.xxhash64("shingle").alias("h"), k.alias("k"), part.alias("part"))
    sketch = hashed.groupBy("item_id", "k", "part").agg(F.array_sort(F.collect_list("h")).alias("hs")).select("item_id", "part", F.explode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("h"))
    limit = sketch.agg(F.max("h")).first()[0]
    if limit is None:
        limit = -(1 << 63)

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                rows = sorted(shingles(text, width))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.binary()), pa.array(rows, pa.binary())], ["_key", "shingle"])

    own = keyed.select("_key", "text").dropDuplicates(["_key"]).mapInArrow(run, "_key binary, shingle binary").withColumn("h", F.xxhash64("shingle"))
    candidates = own.filter(F.col("h") <= F.lit(limit)).select("_key", "h").join(sketch.select("item_id", "h"), "h").select("_key", "item_id").distinct()
    pairs = stage(candidates, "candidates")
    have = own.join(pairs.select("_key").distinct(), "_key", "left_semi").select("_key", "shingle")
    wanted = pairs.join(shingled.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).select("_key", "item_id", "shingle")
    counts = wanted.join(have, ["_key", "shingle"]).groupBy("_key", "item_id").agg(F.count(F.lit(1)).cast("int").alias("n_shared"))
    full = counts.join(of_item, F.col("item_id").eqNullSafe(F.col("_item"))).select("_key", "item_id", "n_shared", "n_shingles")
    return full.filter(F.col("n_shared") >= F.greatest(F.lit(1), F.ceil(F.col("n_shingles") * share - 1e-9)))


def without_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of docs, with all columns, that contain no item."""
    shingled = stage(_item_shingles(items, width), "items")
    if shingled.count() > most:
        keyed = docs.withColumn("_key", content_key(F.col("text")))
        return keyed.join(_contained_by_join(keyed, shingled, width, share), "_key", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(_sketches(shingled, width, share))
    at = docs.columns.index("text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.found_in(t, hashes) for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
