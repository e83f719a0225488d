"""SimHash near-duplicates with covering masks.

For radius r the covering family (Pagh 2016) has 2^(r+1)-1 bit masks: bit i
gets a vector m(i) of r+1 bits, and the mask of a vector v keeps the bits with
odd <m(i), v>. Up to r differing bits span at most r dimensions, so some v is
orthogonal to all of them: under its mask both fingerprints are equal. Every
pair within the radius therefore meets in some bucket.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import content_key, free_name, same, sorted_groups, stage, texts_of

BITS = 64
BLOCK = 8192  # fingerprints of a bucket that meet in one task, per side
SHINGLES = 1 << 16  # shingles that are hashed at a time


def fingerprint(text: bytes, width: int) -> int:
    """Bit b is set if over half of the shingles' hashes have it; a text without words has 0."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    n = max(1, len(words) - width + 1)
    if not words:
        return 0
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, SHINGLES):
        b = min(n, a + SHINGLES)
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(a, b)), "<u8", b - a)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns and the fingerprint `fp` (a signed long with these bits) of every whole text.

    Words are runs without ASCII white space, A-Z lower-cased; shingles count
    as often as they occur; with fewer words than `width` all words are one
    shingle; null, empty and wordless texts have 0.
    """
    keep = list(keep)

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, width) for t in texts_of(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.int64())], [*keep, "fp"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, text).mapInArrow(run, f"{head}, fp long")


def masks(radius: int) -> list[int]:
    """The covering family as signed longs."""
    vectors = (1 << radius + 1) - 1
    kept = [[bin((i % vectors + 1) & v).count("1") & 1 for i in range(BITS)] for v in range(1, vectors + 1)]
    return [_signed(sum(b << i for i, b in enumerate(bits))) for bits in kept]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _buckets(fps: DataFrame, family: list[int]) -> DataFrame:
    """One row per fingerprint and mask: t, key and the given columns."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(family))))
    return fps.withColumn("_b", each).select("_b.t", "_b.key", *fps.columns)


def _never_broadcast(keyed: DataFrame) -> DataFrame:
    """Rows that an explode has multiplied: Spark sizes them as if it had not, and would send many times its limit through the driver."""
    return keyed.hint("merge")


def _inside(fps: DataFrame, radius: int) -> DataFrame:
    """Links between fingerprints that differ in one group of `radius` neighbouring bits only.

    All members of such a bucket are within the radius of each other, so links to the smallest member say it all.
    """
    groups = [_signed(~(((1 << min(radius, BITS - a)) - 1) << a) & (1 << 64) - 1) for a in range(0, BITS, radius)]
    keyed = _buckets(fps, groups)
    low = keyed.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    return _never_broadcast(keyed).join(low, ["t", "key"]).filter("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def _meetings(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (t, key, i, j, fp, label) of the buckets of `radius`, see dealt."""
    return dealt(_buckets(fps, masks(radius)))


def _mixed(keyed: DataFrame) -> DataFrame:
    """The rows of buckets with more than one label, and the number `n` of the bucket's rows."""
    mixed = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("t", "key", "n")
    return _never_broadcast(keyed).join(mixed, ["t", "key"])


def dealt(keyed: DataFrame, size: int | None = None) -> DataFrame:
    """Rows (t, key, i, j, fp, label), dealt so that every two members of a bucket (t, key) with different labels share a group (t, key, i, j).

    Buckets of one label hold nothing new. Others of up to `size` (BLOCK) members are
    one group. In larger ones the most frequent label's members lie in blocks
    i and need no meeting among themselves; the others lie in blocks j and
    meet each block i and each other. So no group exceeds about two blocks.
    """
    size = size or BLOCK
    rows = stage(_mixed(keyed), "buckets")
    small = rows.filter(F.col("n") <= size).select("t", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "label")
    large = rows.filter(F.col("n") > size)
    by_label = large.groupBy("t", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = by_label.groupBy("t", "key").agg(F.max(F.struct("c", "label")).alias("m")).select("t", "key", F.col("m.label").alias("main"), F.col("m.c").alias("c"))
    numbered = large.join(main, ["t", "key"]).withColumn("p", F.ceil(F.col("c") / size).cast("int")).withColumn("q", F.ceil((F.col("n") - F.col("c")) / size).cast("int"))
    block = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    mains = numbered.filter("label = main").withColumn("i", block(F.col("p"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    others = numbered.filter("label != main").withColumn("own", block(F.col("q")))
    at_main = others.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("j", F.col("own"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: F.struct((-1 - F.least(k, F.col("own"))).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    among = others.withColumn("_p", F.explode(pairs)).withColumn("i", F.col("_p.i")).withColumn("j", F.col("_p.j"))
    cols = ["t", "key", "i", "j", "fp", "label"]
    return small.unionByName(mains.select(cols)).unionByName(at_main.select(cols)).unionByName(among.select(cols))


def _links_of(fp: np.ndarray, label: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of different labels that have fingerprints within the radius; the largest label is not compared with itself."""
    names, code, count = np.unique(label, return_inverse=True, return_counts=True)
    others = np.flatnonzero(code != count.argmax())
    bits, found = fp.view(np.uint64), []
    step = max(1, (1 << 21) // len(fp))
    for a in range(0, len(others), step):
        rows = others[a : a + step]
        near = (np.bitwise_count(bits[rows][:, None] ^ bits[None, :]) <= radius) & (code[rows][:, None] != code[None, :])
        x, y = np.nonzero(near)
        if len(x):
            u, v = code[rows[x]], code[y]
            found.append(np.unique(np.minimum(u, v) * np.int64(len(names)) + np.maximum(u, v)))
    if not found:
        return np.empty((0, 2), np.int64)
    pairs = np.unique(np.concatenate(found))
    return np.stack([names[pairs // len(names)], names[pairs % len(names)]], 1)


def components_of(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for the fingerprints that have a link, from distinct non-null fingerprints `fp`.

    First come links that need no comparison; the labels they give leave only
    buckets of different labels to compare. The links between labels complete
    the graph exactly.
    """
    first = stage(connected(_inside(fps, radius)), "first")
    labelled = stage(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("label")), "labels")

    def run(batches):
        for _, _, _, _, fp, label in sorted_groups(batches, 4):
            pairs = _links_of(fp, label, radius)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    cols = ["t", "key", "i", "j"]
    links = _meetings(labelled, radius).repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, "a long, b long")
    joined = connected(links)
    top = labelled.join(joined, labelled["label"] == joined["node"], "left").select("fp", F.coalesce("root", "label").alias("root"))
    return top.filter(F.col("root").isNotNull())


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns, `fp` and `root` of every row; rows of one root are near-duplicates, directly or through others.

    Equal texts, null and wordless ones included, have equal fingerprints and so one root. Repeated rows stay.
    """
    rows = stage(fingerprints(docs, width, keep, text), "fingerprints")
    roots = components_of(rows.select("fp").distinct(), radius)
    return rows.join(roots, "fp").select(*keep, "fp", "root")


def with_component_ids(found: DataFrame) -> DataFrame:
    """Adds `component_id`: the smallest doc_id of the root's rows; null only if none has an id."""
    low = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(low, "root")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """All columns of one row per near-duplicate group (near_duplicates): the row of the smallest doc_id (null last), then of the smallest content key.

    Null, empty and wordless texts are one group, as their fingerprints are equal.
    """
    k, n = (free_name(x, docs.columns) for x in ("_key", "_n"))
    keyed = docs.withColumn(k, content_key(F.col("text")))
    found = near_duplicates(keyed, width, radius, ["doc_id", k])
    counted = found.groupBy("root", "doc_id", k).agg(F.count(F.lit(1)).alias(n))
    least = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", k, n)).alias("least"))
    first = stage(least.select("least.doc_id", f"least.{k}", f"least.{n}"), "first")
    kept = keyed.join(first, same(keyed, first, ["doc_id", k])).drop(first["doc_id"], first[k])
    once = kept.filter(F.col(n) == 1)
    if not first.filter(F.col(n) > 1).isEmpty():  # rows that are equal in id and text: one of them
        once = once.unionByName(kept.filter(F.col(n) > 1).dropDuplicates(["doc_id", k]))
    return once.select([f"`{c}`" for c in docs.columns])
