"""Near-duplicate lines across documents by a segment-partition edit join. DataFrame functions only.

A line of n characters is split into tau + 1 segments. If two lines are within
tau edits, one segment of the shorter (or equally long) line occurs unchanged
in the longer one, and by the bounds of Li et al. (2011) only near its own
place: so each line offers its segments and probes few substrings of itself,
per length difference. What meets is verified by a bit-parallel edit distance
that keeps only the band of 2 tau + 1 diagonals (Hyyrö 2003), after two tests
that no pair within tau edits can fail: an edit changes the counts of two
characters by one at most, and touches one piece of a line at most. Up to MEMBERS lines
that meet are taken as pairs, more in blocks.
"""

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import content_key, free_name, stage

EDITS = 2
SHORTEST = 24  # characters; shorter lines are matched exactly only
MEMBERS = 16  # lines that may meet at one substring pair by pair; more meet in blocks
BLOCK = 64  # lines of a block
LINKS = 4  # links that a line gives at once per pair of blocks
COUNTED = "etaoinshrdlcumgbоаеитالأ的の一"  # characters that are counted; lines without any are told apart by their pieces only
PIECES = 8  # pieces of a line that are looked for in the other one
HALVINGS = 10  # steps of the search for the common beginning and end of two lines
LOOKED_UP = 500_000  # keys of 8 bytes that may be broadcast; more are joined by a shuffle


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, doc (content key), pos, line of every line; null texts are one empty line."""
    rows = docs.select("doc_id", content_key(F.col("text")).alias("doc"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.select("doc_id", "doc", F.posexplode(F.split("_t", "\n")).alias("pos", "line"))


def _probes(edits: int) -> Column:
    """(shorter, segment, shift) of the substrings to probe for lines that are shorter by so many characters."""
    parts, each = edits + 1, []
    for shorter in range(edits + 1):
        for i in range(parts):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                each.append(F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("segment"), F.lit(shift).alias("shift")))
    return F.array(*each)


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """(key, id, offered): every substring under which a line may meet another; offered ones are its own segments.

    The probes are rows, so that one short expression cuts them all: one expression per probe makes a method that the JVM does not compile.
    """
    parts = edits + 1
    probed = lines.select("id", "line", F.length("line").alias("n"), F.explode(_probes(edits)).alias("p")).select("id", "line", "n", "p.*")
    size, longer = F.floor((F.col("n") - F.col("shorter")) / parts).cast("int"), (F.col("n") - F.col("shorter")) % parts
    late = F.greatest(F.lit(0), F.col("segment") - parts + longer)  # the last segments are longer by one
    placed = probed.select("id", "line", "n", "shorter", "segment", "shift", (F.col("segment") * size + late + F.col("shift")).alias("at"), (size + F.when(F.col("segment") >= parts - longer, 1).otherwise(0)).alias("size"))
    inside = placed.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    key = F.xxhash64((F.col("n") - F.col("shorter")).cast("long"), "segment", F.substring("line", F.col("at") + 1, F.col("size")))
    return inside.select(key.alias("key"), "id", F.when((F.col("shorter") == 0) & (F.col("shift") == 0), 1).otherwise(0).alias("offered"))


def marks(line: Column) -> Column:
    """How often a line has each counted character."""
    return F.struct(*((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(f"c{r}") for r, c in enumerate(COUNTED)))


def alike(x: Column, y: Column, edits: int) -> Column:
    """False only if the marks of two lines show more than `edits` edits, each of which changes two counts by one at most."""
    differ = [F.abs(x[f"c{r}"] - y[f"c{r}"]) for r in range(len(COUNTED))]
    return reduce(and_, (d <= edits for d in differ)) & (reduce(add, differ) <= 2 * edits)


def _same_pieces(left: Column, right: Column, edits: int) -> Column:
    """False only if more than `edits` pieces of the left line are not near their place in the right one."""
    def missing(size: Column) -> Column:
        out = F.lit(0)
        for k in range(PIECES):
            piece = F.substring(left, size * k + 1, size)
            out = out + F.when(F.substring(right, F.greatest(F.lit(1), size * k + 1 - edits), size + 2 * edits).contains(piece), 0).otherwise(1)
        return out

    return F.element_at(F.transform(F.array(F.floor(F.length(left) / PIECES).cast("int")), missing), 1) <= edits


def _differing(left: Column, right: Column, edits: int) -> Column:
    """x, y: the two lines without what they have in common at both ends, but for `edits` characters, so that their edit distance stays."""
    least = F.least(F.length(left), F.length(right))
    size = lambda k: F.ceil(least / F.call_function("shiftleft", F.lit(1), k)).cast("int")

    def common(most: Column, same) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.lit(0), lambda n, k: n + F.when((n + size(k) <= most) & same(n, size(k)), size(k)).otherwise(0))

    ahead = common(least, lambda n, s: F.substring(left, n + 1, s) == F.substring(right, n + 1, s))
    ahead = F.greatest(F.lit(0), ahead - edits)
    end = lambda line, n, s: F.substring(line, F.length(line) - n - s + 1, s)
    let = lambda x, then: F.element_at(F.transform(F.array(x), then), 1)
    cut = let(ahead, lambda a: F.struct(a.alias("a"), F.greatest(F.lit(0), common(least - a, lambda n, s: end(left, n, s) == end(right, n, s)) - edits).alias("z")))
    part = lambda line, c: F.substring(line, c["a"] + 1, F.length(line) - c["a"] - c["z"])
    return let(cut, lambda c: F.struct(part(left, c).alias("x"), part(right, c).alias("y")))


def within(left: Column, right: Column, edits: int) -> Column:
    """True if the edit distance of two lines is at most `edits`: bit vectors over a band around the diagonal.

    Bit k of a vector stands for row j - edits + k of column j of the distance
    table; differences between neighbours are kept, one bit each for +1 and -1,
    and the distance is followed along the lowest diagonal, then along the last
    row. The characters are named once, so that no optimizer rule repeats the split at each step.
    Lines of which more than `edits` pieces differ are passed over, and of the
    others only what lies between their common ends is looked at.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(full))
    let = lambda x, then: F.element_at(F.transform(F.array(x), then), 1)  # noqa: E731  names a value that is used several times

    def step(chars: Column, state: Column, j: Column) -> Column:
        match = F.lit(0)
        for k in range(width):
            row = j - edits + k
            match = match.bitwiseOR(F.when((row >= 0) & (F.get(chars["p"], row) == F.get(chars["t"], j)), F.lit(1 << k)).otherwise(F.lit(0)))
        vp, vn = state["vp"], state["vn"]
        crossed = lambda x: (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return let(match, lambda x: let(crossed(x), lambda diagonal: after(chars, state, j, diagonal)))

    def after(chars: Column, state: Column, j: Column, diagonal: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        plus, minus = vn.bitwiseOR(inverse(diagonal.bitwiseOR(vp))), diagonal.bitwiseAND(vp)
        below = j + edits - (F.size(chars["p"]) - 1)  # how far the lowest diagonal is below the last row
        last = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.lit(width - 1) - below))
        along = F.when(plus.bitwiseAND(last) != 0, 1).when(minus.bitwiseAND(last) != 0, -1).otherwise(0)
        more = F.when(below <= 0, F.when(diagonal.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(along)
        down = F.shiftright(diagonal, 1)
        return F.struct(minus.bitwiseOR(inverse(down.bitwiseOR(plus))).alias("vp"), down.bitwiseAND(plus).alias("vn"), (state["d"] + more).alias("d"))

    first = F.struct(F.lit(full ^ ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
    characters = lambda line: F.filter(F.split(line, ""), lambda c: c != "")
    both = let(_differing(left, right, edits), lambda d: F.struct(characters(d["x"]).alias("p"), characters(d["y"]).alias("t")))
    distance = let(both, lambda chars: F.aggregate(F.sequence(F.lit(0), F.size(chars["t"]) - 1), first, lambda state, j: step(chars, state, j), lambda s: s["d"]))
    far = (F.abs(F.length(left) - F.length(right)) > edits) | ~_same_pieces(left, right, edits)
    return F.when(far, False).otherwise(distance <= edits)


def _looked_up(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Rows of `big` with a partner in `small`: broadcast if that has at most LOOKED_UP rows, else by a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= LOOKED_UP else small, on)


def _verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of line ids that are within the edits, as content keys."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = stage(_looked_up(lines, ids, "id").distinct().select("id", "line", marks(F.col("line")).alias("marks")), "texts")
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("marks").alias("m"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("marks").alias("o"))
    both = pairs.join(left, "a").join(right, "b").filter(F.when(alike(F.col("m"), F.col("o"), edits), within(F.col("x"), F.col("y"), edits)).otherwise(False))
    return both.select(content_key(F.col("x")).alias("a"), content_key(F.col("y")).alias("b"))


def _block_links(members: DataFrame, roots: DataFrame, edits: int, linked: DataFrame | None = None) -> DataFrame:
    """(key, i, j, a, b, more): for each line of a large meeting its first LINKS partners of other classes, per pair of blocks; `more` if there may be others.

    Classes only grow, so a line that gave fewer links than LINKS to a block has no other there in any later round: `linked` are the last round's links of those that may have.
    """
    now = members.join(roots, members["line_id"] == roots["node"], "left").withColumn("label", F.coalesce("root", "line_id"))
    mixed = now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("key")
    blocks = now.join(mixed, "key").groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("line_id", "label", "offered", "marks", "line")).alias("m"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be merged into one task
    left = blocks.select("key", F.col("block").alias("i"), F.col("m").alias("x")).repartition(tasks, "key", "i")
    if linked is None:
        right = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("m").alias("y"))
    else:
        asked = linked.groupBy("key", "i", "j").agg(F.collect_set("a").alias("asked"))  # lines of one block
        right = asked.join(blocks.select("key", F.col("block").alias("j"), F.col("m").alias("y")), ["key", "j"]).select("key", "i", "j", "y", "asked")
    right = right.repartition(tasks, "key", "i")
    near = lambda x: F.filter("y", lambda y: (x["label"] != y["label"]) & (x["offered"] + y["offered"] > 0) & F.when(alike(x["marks"], y["marks"], edits), within(x["line"], y["line"], edits)).otherwise(False))
    x = F.col("x") if linked is None else F.filter("x", lambda x: F.array_contains("asked", x["line_id"]))
    some = F.transform(x, lambda x: F.struct(x["line_id"].alias("a"), F.slice(F.transform(near(x), lambda y: y["line_id"]), 1, LINKS).alias("b")))
    return left.join(right, ["key", "i"]).select("key", "i", "j", F.explode(some).alias("l")).select("key", "i", "j", "l.a", F.explode("l.b").alias("b"), (F.size("l.b") == LINKS).alias("more"))


def similar_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(node, root): content keys of lines of at least SHORTEST characters that are within `edits` of another, and their class.

    A class holds all lines that are linked, directly or through others. Where
    up to MEMBERS lines meet, their pairs are verified. Larger meetings are
    split into blocks: in each round every line gives up to LINKS links to other
    classes per pair of blocks, and lines that gave so many are asked again
    once the classes are joined, until there are none. So no link between classes is lost, and no meeting is
    written out as pairs.
    """
    lines = lines_of(docs).filter(F.length("line") >= SHORTEST).select(F.xxhash64("line").alias("id"), "line")
    # a key where different lines meet: found by two map-side combined extremes, however often a line is repeated
    keys = stage(_keys(lines, edits), "keys")  # read twice; cutting the substrings costs more than storing their keys
    met = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("offered").alias("offered"))
    met = stage(met.filter((F.col("a") != F.col("b")) & (F.col("offered") == 1)).select("key"), "meetings")
    found = stage(_looked_up(keys, met, "key").groupBy("key", "id").agg(F.max("offered").alias("offered")), "found")
    rows = found.join(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    few = rows.filter(F.col("n") <= MEMBERS)
    other = few.select("key", F.col("id").alias("b"), F.col("offered").alias("o"))
    few = few.join(other, "key").filter((F.col("id") < F.col("b")) & (F.col("offered") + F.col("o") > 0)).select(F.col("id").alias("a"), "b")
    pairs = stage(few.distinct(), "pairs")
    links = stage(_verified(pairs, lines, edits), "similar")
    roots = connected(links)
    large = stage(rows.filter(F.col("n") > MEMBERS), "large")
    if large.isEmpty():
        return roots
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    named = _looked_up(lines, stage(large.select("id").distinct(), "ids"), "id").distinct().withColumn("marks", marks(F.col("line")))
    members = stage(large.join(named, "id").select("key", "offered", "line", "marks", content_key(F.col("line")).alias("line_id"), count.alias("blocks"), F.pmod(F.xxhash64("id"), count).cast("int").alias("block")), "members")
    more = None
    while True:
        given = stage(_block_links(members, roots, edits, more), "similar")
        if given.isEmpty():
            return roots
        links = links.union(given.select("a", "b"))
        roots = connected(links)
        more = given.filter("more")
        if more.isEmpty():
            return roots


def marked_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, doc, pos, line_id, line_class and kept of every line.

    Of each class of equal or similar lines the first one is kept: the one of
    the smallest doc_id (null last), then content key, then position. Lines of
    white space alone have no class and are kept. Rows equal in id and text
    are treated alike.
    """
    blank = F.length(F.btrim("line", F.lit(" \t\r\x0b\x0c"))) == 0
    lines = stage(lines_of(docs).select("doc_id", "doc", "pos", F.when(~blank, content_key(F.col("line"))).alias("line_id")), "lines")
    roots = similar_lines(docs, edits)
    named = lines.join(roots, lines["line_id"] == roots["node"], "left").select("doc_id", "doc", "pos", "line_id", F.coalesce("root", "line_id").alias("line_class"))
    named = stage(named, "classes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "pos")
    first = named.filter("line_class IS NOT NULL").groupBy("line_class").agg(F.min(place).alias("first")).withColumnRenamed("line_class", "_class")
    both = named.join(first, named["line_class"] == first["_class"], "left")
    return both.select("doc_id", "doc", "pos", "line_id", "line_class", F.coalesce(F.col("first").eqNullSafe(place) , F.lit(True)).alias("_k"), F.col("line_class").isNull().alias("_b")).select("doc_id", "doc", "pos", "line_id", "line_class", (F.col("_k") | F.col("_b")).alias("kept"))


def removed_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, doc, n_lines and removed (ascending positions) of every distinct (id, text)."""
    return marked_lines(docs, edits).groupBy("doc_id", "doc").agg(F.countDistinct("pos").alias("n_lines"), F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("pos")))).alias("removed"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """All rows and columns; texts without the removed lines, n_chars (if there) counted anew. A text can become empty, a null text stays null."""
    i, d, k, r = (free_name(n, docs.columns) for n in ("_id", "_doc", "_key", "_removed"))
    removed = stage(removed_lines(docs, edits).filter(F.size("removed") > 0).select(F.col("doc_id").alias(i), F.col("doc").alias(d), F.col("removed").alias(r)), "removed")
    keyed = docs.withColumn(k, content_key(F.col("text")))
    both = keyed.join(removed, keyed["doc_id"].eqNullSafe(removed[i]) & (keyed[k] == removed[d]), "left")
    left = F.filter(F.split("text", "\n"), lambda _, at: ~F.array_contains(r, at))
    text = F.when(F.col(r).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return both.select(*(x.alias(c) for c, x in out.items()))
