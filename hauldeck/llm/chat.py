"""Chat formatting with perspective rotation. DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask marks what the assistant
says and its end mark, which are to be trained on.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = 64  # turn numbers of one part of a long dialogue
MOST = 256  # messages of a piece, about; parts of more than twice as many are split
PART = ["conv", "conv_id", "part"]


def messages(conversations: DataFrame, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """conv, part, sub, conv_id, turn, role, text, tie: distinct messages, dealt into parts of a bounded size.

    A part is a range of turn numbers, further split by hash where a range has
    many messages for one conversation; sub numbers its pieces and is null for
    a part in one piece. Repeated messages count once. A null role is
    'unknown', a null text empty; messages without a turn come last, in a part
    of their own; a message without a conversation is one of its own.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    tie = F.md5(F.concat_ws(":", "role", "text").cast("binary"))
    own = F.when(F.col("conv_id").isNull(), F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), tie)).otherwise("")
    keyed = rows.select(own.alias("conv"), F.floor(F.col("turn") / turns).alias("part"), "conv_id", "turn", "role", "text", tie.alias("tie"))
    # crowded parts: a turn's messages follow those of the turns before it, ties by their hash, and every `most` of them end a piece
    per_turn = keyed.groupBy(*PART, "turn").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*PART).orderBy("turn")
    per_turn = per_turn.withColumn("all", F.sum("n").over(Window.partitionBy(*PART))).filter(F.col("all") > 2 * most).withColumn("b", F.sum("n").over(before) - F.col("n"))
    per_turn = per_turn.select(*(F.col(c).alias(f"_{c}") for c in [*PART, "turn"]), "n", "b")
    share = F.conv(F.substring("tie", 1, 8), 16, 10).cast("double") / 4294967296
    split = keyed.join(per_turn, _same([*PART, "turn"]), "left")
    return split.withColumn("sub", F.floor((F.col("b") + share * F.col("n")) / most).cast("long")).select("conv", "part", "sub", "conv_id", "turn", "role", "text", "tie")


def _same(columns: list[str]) -> Column:
    """Equality of the columns with those of an underscored name where nulls are equal, too."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _pieces(dealt: DataFrame) -> DataFrame:
    """conv, conv_id, part, sub and the piece's messages in order."""
    return dealt.groupBy(*PART, "sub").agg(F.array_sort(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("m"))


def _shown_uncut(dealt: DataFrame) -> DataFrame:
    """Rows of the parts in one piece, by their speakers."""
    speakers = F.array_distinct(F.filter(F.transform("m", lambda x: x["role"]), lambda r: r != "system"))
    return _shown(_pieces(dealt.filter("sub is null")).select(*PART, "sub", "m", F.explode(speakers).alias("speaker")))


def _shown_pieces(dealt: DataFrame) -> DataFrame:
    """Rows of the split parts' pieces, each by all speakers of its part, whether they speak in the piece or not."""
    split = dealt.filter("sub is not null")
    speakers = split.filter("role <> 'system'").select(*(F.col(c).alias(f"_{c}") for c in PART), F.col("role").alias("speaker")).distinct()
    return _shown(_pieces(split).join(speakers, _same(PART)).select(*PART, "sub", "m", "speaker"))


def rendered(conversations: DataFrame, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """conv_id, speaker, part, sub, text, spans (start, end in characters of text, end excluded), n_turns, n_trained.

    One row per speaker and piece of a part in which the speaker says something
    (a part without has nothing to train on). Messages are ordered by turn, then by the
    md5 of role and text. 'system' messages stay system messages and have no perspective.
    """
    dealt = messages(conversations, turns, most)
    both = _shown_uncut(dealt).unionByName(_shown_pieces(dealt))
    return both.select("conv_id", "speaker", "part", F.coalesce("sub", F.lit(0)).cast("long").alias("sub"), "text", "spans", "n_turns", "n_trained")


def whole_parts(conversations: DataFrame, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """The same with one row per speaker and part: the pieces of a split part follow each other in one text.

    The pieces are rendered apart and moved once more, by part and speaker; parts in one piece stay where they are.
    """
    dealt = messages(conversations, turns, most)
    key = [*PART, "speaker"]
    length = F.length("text").cast("long")
    before = F.sum(length).over(Window.partitionBy(*key).orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)) - length
    placed = _shown_pieces(dealt).withColumn("at", before.cast("int"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    joined = placed.withColumn("spans", moved).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("sub", "text", "spans"))).alias("x"), F.sum("n_turns").cast("int").alias("n_turns"), F.sum("n_trained").cast("int").alias("n_trained"))
    out = ["conv_id", "speaker", "part", "text", "spans", "n_turns", "n_trained"]
    split = joined.withColumns({"text": F.array_join(F.transform("x", lambda p: p["text"]), ""), "spans": F.flatten(F.transform("x", lambda p: p["spans"]))})
    return _shown_uncut(dealt).select(*out).unionByName(split.select(*out))


def _shown(each: DataFrame) -> DataFrame:
    """The messages `m` as the speaker is to learn them."""

    def name(role: Column) -> Column:
        return F.when(role == F.col("speaker"), "assistant").when(role == "system", "system").otherwise(F.concat(F.lit("user name="), role))

    head = lambda x: F.concat(F.lit(OPEN), name(x["role"]), F.lit("\n"))
    shown = each.withColumn("p", F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(CLOSE)).alias("body"), (x["role"] == F.col("speaker")).alias("own"))))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans")), add, lambda s: s["spans"])
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"])), "")
    out = shown.select(*PART, "speaker", "sub", text.alias("text"), spans.alias("spans"), F.size("p").alias("n_turns"))
    return out.withColumn("n_trained", F.size("spans"))
