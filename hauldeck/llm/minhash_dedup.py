"""Near-duplicates by the Jaccard similarity of word shingles, found with SuperMinHash.

SuperMinHash (Ertl 2017): every element deals the ranks 0, 1, 2, … to the
slots of the signature in an order of its own and draws a number in each
round; a slot keeps the smallest (rank, number). As a slot gets different
ranks from one element, slots are negatively correlated and the estimate
varies less than that of independent hash functions. Once every slot of a text
holds a value of an earlier rank, later rounds cannot change it, so a text
of many shingles stops after one round.

BANDS x ROWS slots: two sets of similarity s agree in a whole band, and so
meet, with probability 1-(1-s^ROWS)^BANDS; at 0.8 one pair in about 20 million
is missed. What meets is verified on all shingles of both texts.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bpe import blocks
from .components import connected
from .shared import content_key, join_groups, same, sorted_groups, stage, texts_of

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
STARS = 2  # rounds in which each meeting's members are compared with one of them only
FLOOR = 5.0  # standard deviations that a signature's estimate may lie below the similarity before the pair is not verified
AT_ONCE = 1 << 15  # shingles that deal out their ranks at a time
PAIRS = 1 << 17  # pairs whose signatures are compared at a time
BLOCK = 1024  # texts of a meeting that meet in one task, per side
FOREST = 1 << 16  # links of a task that are joined at a time
BLOCK_BYTES = 1 << 20

_STEP, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _draw(elements: np.ndarray, k: int) -> np.ndarray:
    """The k-th random number of each element."""
    return _mixed(elements + np.uint64(int(_STEP) * k % (1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The output step of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words
    than `width` are one shingle; a text without words has none.
    """
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    codes = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    coded = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        mixed = (mixed ^ coded[i : i + n]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mixed(mixed))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS values (rank in the highest byte, number in the others) per set; all ones for an empty set."""
    out = np.full((len(sets), SLOTS), np.uint64(0xFFFFFFFFFFFFFFFF))
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for a in range(0, len(elements), AT_ONCE):
        some, owner = elements[a : a + AT_ONCE], owners[a : a + AT_ONCE]
        low, high = owner[0], owner[-1] + 1
        order = chosen = None  # each element's dealing order is only kept where a second round comes
        for rank in range(SLOTS):
            if rank:
                open_ = (out[low:high].max(1) >> np.uint64(56)) >= rank
                going = open_[owner - low]
                if not going.any():
                    break
                if order is None:
                    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(some), 1))
                    order[:, 0] = chosen
                    order[np.arange(len(some)), chosen] = 0
                some, owner, order = some[going], owner[going], order[going]
            draw = _draw(some, 2 * rank + 1)
            chosen = rank + ((draw >> np.uint64(32)) * np.uint64(SLOTS - rank) >> np.uint64(32)).astype(np.int64)
            slot = chosen
            if order is not None:  # Fisher-Yates: the next place of the order gets one of the slots not dealt yet
                each = np.arange(len(some))
                slot = order[each, chosen].astype(np.int64)
                order[each, chosen] = order[:, rank]
                order[:, rank] = slot
            value = np.uint64(rank << 56) | _draw(some, 2 * rank + 2) >> np.uint64(8)
            np.minimum.at(out.reshape(-1), owner * SLOTS + slot, value)
    return out


def similarity_of(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per signature and band."""
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(ROWS):
        keys = _mixed((keys ^ rows.reshape(-1, BANDS, ROWS)[:, :, k]) * _STEP + _B)
    return keys


def sketched(docs: DataFrame, width: int, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns, `n_shingles`, `fp` (64 bits of the shingle set's md5), `sig` (one byte per slot) and `bands`, null for a text without words."""
    keep = list(keep)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "").cast(pa.binary())
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                sets = [shingle_set(t, width) for t in texts.slice(a, b - a).to_pylist()]
                rows, sizes = signatures(sets), np.array([len(s) for s in sets], np.int64)
                fps = [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in sets]
                none = sizes == 0
                sig = pa.array([None if x else r.tobytes() for x, r in zip(none.tolist(), rows.astype(np.uint8), strict=True)], pa.binary())
                flat = pa.array(band_keys(rows)[~none].reshape(-1).view(np.int64))
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~none)]) * BANDS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(sizes), pa.array(fps, pa.int64()), sig, bands], [*keep, "n_shingles", "fp", "sig", "bands"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, text).mapInArrow(run, f"{head}, n_shingles long, fp long, sig binary, bands array<long>")


def _sets_of(ids: DataFrame, rows: DataFrame, keyed: DataFrame, width: int) -> DataFrame:
    """(fp, s): the shingle sets of these `fp`, stored; each is worked out from one of the texts that have it."""
    wanted = rows.join(ids, "fp").groupBy("fp").agg(F.min(F.struct("doc_id", "_key")).alias("k")).select("fp", "k.doc_id", "k._key")
    texts = keyed.join(wanted, same(keyed, wanted, ["doc_id", "_key"])).select("fp", "text")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in texts_of(batch.column(1))], pa.binary())], ["fp", "s"])

    return stage(texts.mapInArrow(sets, "fp long, s binary").dropDuplicates(["fp"]), "sets")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection is this share of the union, or more."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both, union = similarity_of(a, b)
    return 100 * both >= percent * union


def _verified(pairs: DataFrame, rows: DataFrame, keyed: DataFrame, width: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose texts have this similarity."""
    pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    found = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), rows, keyed, width)

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(x, y, strict=True)], pa.bool_())

    # the smaller end can be one text's for many pairs: it is joined first, while rows are narrow
    both = pairs.join(found.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b").join(found.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a")
    return both.filter(near("x", "y")).select("a", "b")


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: union-find over up to FOREST links of a task at a time leaves one link per node."""

    def run(batches):
        for batch in batches:
            pairs = np.stack([c.to_numpy() for c in batch.columns], 1)
            for k in range(0, len(pairs), FOREST):
                names, code = np.unique(pairs[k : k + FOREST], return_inverse=True)
                root = list(range(len(names)))

                def find(x):
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for x, y in code.reshape(-1, 2).tolist():
                    x, y = find(x), find(y)
                    root[max(x, y)] = min(x, y)
                top = np.array([find(x) for x in range(len(names))], np.int64)
                lower = top < np.arange(len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names[lower]), pa.array(names[top[lower]])], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _near_pairs(t: int, label: np.ndarray, sig: np.ndarray, bands: np.ndarray, least: float):
    """(x, y, equal slots) of the members of a group of band t that have different labels and whose signatures do not rule them out.

    Two that have an earlier band in common, too, meet there.
    """
    bits, keys = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, SLOTS), np.stack(bands)[:, :t]
    _, code, count = np.unique(label, return_inverse=True, return_counts=True)
    others = np.flatnonzero(code != count.argmax())  # the largest label is not compared with itself
    step = max(1, PAIRS // len(label))
    for i in range(0, len(others), step):
        some = others[i : i + step]
        equal = (bits[some][:, None] == bits[None, :]).sum(2)
        x, y = np.nonzero((code[some][:, None] != code[None, :]) & (equal >= least))
        n, x = equal[x, y], some[x]
        here = ~(keys[x] == keys[y]).any(1)
        yield x[here].astype(np.int32), y[here].astype(np.int32), n[here].astype(np.int16)


def _links_in_blocks(keyed: DataFrame, rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between all members of different labels that share a meeting; pairs never leave the task that finds them.

    First each block of a meeting names the members that its signatures do
    not rule out; only their sets then go to the block. There the most alike
    pairs are verified first, and a union-find of the block's labels skips
    pairs that are connected already. So rows grow with the members.
    """
    least = SLOTS * percent / 100 - FLOOR * (SLOTS * percent / 100 * (1 - percent / 100)) ** 0.5
    cols = ["t", "key", "i", "j"]

    def name(batches):
        for columns in sorted_groups(batches, 4):
            t, (label, sig, bands) = int(columns[0][0]), columns[5:8]
            wanted = np.zeros(len(label), bool)
            for x, y, _ in _near_pairs(t, label, sig, bands, least):
                wanted[x] = wanted[y] = True
            if wanted.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(c[wanted]) for c in columns[:7]), pa.array(bands[wanted].tolist(), pa.list_(pa.int64()))], [*cols, "fp", "label", "sig", "bands"])

    def link(batches):
        for columns in sorted_groups(batches, 4):
            t, (fp, label, sig, bands, sets) = int(columns[0][0]), columns[4:]
            sets = [np.frombuffer(s, np.uint64) for s in sets]
            x, y, n = (np.concatenate(p) for p in zip(*_near_pairs(t, label, sig, bands, least), strict=True))
            root = np.unique(label, return_inverse=True)[1].tolist()
            top = list(range(max(root) + 1))

            def find(k):
                while top[k] != k:
                    top[k] = k = top[top[k]]
                return k

            links = []
            best = np.argsort(-n, kind="stable")
            for x, y in zip(x[best].tolist(), y[best].tolist(), strict=True):
                a, b = find(root[x]), find(root[y])
                if a != b and alike(sets[x], sets[y], percent):
                    top[max(a, b)] = min(a, b)
                    links.append((x, y))
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(fp[at[:, 0]]), pa.array(fp[at[:, 1]])], ["a", "b"])

    dealt = simhash.dealt(keyed, BLOCK).join(rows.select("fp", "sig", "bands").dropDuplicates(["fp"]), "fp").select(*cols, "fp", "label", "sig", "bands")
    named = dealt.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(name, "t int, key long, i int, j int, fp long, label long, sig binary, bands array<long>")
    named = stage(named, "near")
    found = _sets_of(named.select("fp").distinct(), rows, texts, width)
    full = named.join(found, "fp").select(*cols, "fp", "label", "sig", "bands", "s")
    return full.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, _key (content key), n_shingles and root of every row; rows of one root are linked by pairs of texts whose intersection is this share of the union, or more.

    Texts of one shingle set have one root. Null, empty and wordless texts
    are linked with nothing: their root is null. Repeated rows stay.

    In the first rounds each meeting's members are compared with one of them,
    another in each round. Then all that meet and still have different labels
    are compared block by block, so the links complete the graph.
    """
    keyed = docs.select("doc_id", "text", content_key(F.col("text")).alias("_key"))
    rows = stage(sketched(keyed, width, ["doc_id", "_key"]), "sketches")
    nodes = rows.filter("n_shingles > 0").dropDuplicates(["fp"])
    met = nodes.select(F.posexplode("bands").alias("t", "key"), "fp")
    several = met.groupBy("t", "key").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1")).filter("f0 < f1").select("t", "key")
    meetings = stage(met.join(several, ["t", "key"]), "meetings")
    links = roots = None

    def labelled():
        if roots is None:
            return meetings.withColumn("label", F.col("fp"))
        return meetings.join(roots, meetings["fp"] == roots["node"], "left").select("t", "key", "fp", F.coalesce("root", "fp").alias("label"))

    for k in range(STARS + 1):
        now = labelled()
        if k < STARS:
            hub = now.groupBy("t", "key").agg(F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("h"), "fp", "label")).alias("m"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1")
            pairs = now.join(hub.select("t", "key", F.col("m.fp").alias("b"), F.col("m.label").alias("lb")), ["t", "key"]).filter("label != lb").select(F.col("fp").alias("a"), "b")
            more = forest(_verified(pairs, rows, keyed, width, percent))
        else:
            more = forest(_links_in_blocks(now, rows, keyed, width, percent))
        more = stage(more, "similar")
        links = more if links is None else links.unionByName(more)
        roots = stage(connected(links), "roots")
    # texts of one set may be a third of all rows: they are counted first, and their root comes by a join that splits them
    counts = rows.filter("n_shingles > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_low"))
    named = counts.join(roots, counts["fp"] == roots["node"], "left").select("fp", "_n", "_low", F.coalesce("root", "fp").alias("root"))
    sets = stage(named, "sets-named")
    lowest = sets.groupBy("root").agg(F.min("_low").alias("component_id"), F.count(F.lit(1)).alias("_m"))
    sets = stage(join_groups(sets, lowest, "root", "_m").select("fp", "_n", "root", "component_id"), "components")
    wordless = rows.filter("n_shingles = 0").select("doc_id", "_key", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return join_groups(rows.filter("n_shingles > 0").select("doc_id", "_key", "n_shingles", "fp"), sets, "fp", "_n").select("doc_id", "_key", "n_shingles", "root", "component_id").unionByName(wordless)
