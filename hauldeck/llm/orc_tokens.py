"""Token ids in ORC files: ascending document order, integer run-length encoding, row indexes, Bloom filters on ids.

Files are ranges of documents, each sorted, so stripes are read in parallel
and their statistics and Bloom filters skip what a lookup does not need.
"""

import json
import zlib
from array import array
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memory, blocks, held, id_lists

STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000
BLOCK_BYTES, REMEMBERED = 6 << 20, 300_000
#: The characters that stand for bytes in a byte-level model, as a table for str.translate.
SHOWN = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)], range(256, 512), strict=False))


def _finder(definition: str):
    """Finds a text's matches, if the definition says that the text is composed, its white space made spaces, lower-cased, and each match of its pattern goes to the model, bytes as characters. Else None."""
    d = json.loads(definition)
    steps, cuts = (d["normalizer"] or {}).get("normalizers"), (d["pre_tokenizer"] or {}).get("pretokenizers")
    composed = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    matched = [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    special = all(t["content"].startswith("<") for t in d["added_tokens"])
    return regex.compile(pattern).findall if steps == composed and cuts == matched and special and d["post_processor"] is None else None


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never joins across a space: each word is given to the library once.

    Of a word of plain form the matches of the tokenizer's pattern go to the library's model, each once; most of the whole call's time is spent before the model.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(definition), Memory(REMEMBERED)
        self.model, self.matches = self.tokenizer.model, _finder(definition)

    def _parts(self, word: str) -> tuple[str, ...] | list[str]:
        """Pieces with the same ids as the word: the matches of printable ASCII words; of others ASCII punctuation at the end stands alone. Case is no matter outside special tokens.

        The library composes characters before it lower-cases them, and some have a composed form in lower case only. So words that are not composed, before or after, keep their case.
        """
        if self.matches and word.isascii():
            if word.isalpha():
                return (word.lower(),)
            if "<" not in word and word.isprintable():
                return self.matches(word.lower())
        core = word.rstrip(punctuation if self.matches else ".,!?")
        lower = core.lower()
        if not core or not lower[-1].isalnum() or "<" in word:  # İ becomes i and a mark, which the library joins with a stop
            return (word,)
        tail = word[len(core) :]
        if core.isascii() or ("Σ" not in core and is_normalized("NFC", core) and is_normalized("NFC", lower)):  # a final sigma has a form of its own in Python
            core = lower
        return (core, tail) if tail else (core,)

    def _ids(self, piece: str) -> bytes:
        """The piece's ids, from the model alone if the library changes nothing in it and it is one match: of printable ASCII pieces that holds by _parts."""
        shown = None
        if self.matches:
            if piece.isascii():
                shown = piece if piece.isalpha() or "<" not in piece and piece.isprintable() else None
            elif piece.isalpha() and piece == piece.lower() and is_normalized("NFC", piece):
                shown = piece.encode().decode("latin-1").translate(SHOWN)
        if shown is None:
            return array("i", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def block(self, texts: pa.StringArray, end: int) -> pa.ListArray:
        if self.matches:  # all white space becomes a space
            texts = pc.replace_substring(texts, "\n", " ")
        parts = pc.split_pattern(texts, " ")
        coded = parts.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        cut = []
        for w in self.known.missing(words):
            pieces = self._parts(w)
            if len(pieces) == 1 and pieces[0] == w:
                self.known.new[w] = self._ids(w)
            else:
                cut.append((w, pieces))
        known, old = self.known.new, self.known.old
        for w, pieces in cut:
            for p in pieces:  # a piece is a word of its own, so both are remembered together
                if p not in known:
                    known[p] = old[p] if p in old else self._ids(p)
            known[w] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
        values = [known[w] for w in words] + [np.int32(end).tobytes()]
        # the end id is one more word of each text
        ends = parts.offsets.to_numpy()[1:]
        codes = np.insert(coded.indices.to_numpy(), ends, len(words))
        size = np.array([len(v) // 4 for v in values], np.int64)
        flat, sizes = np.frombuffer(b"".join(values), np.int32), size[codes]
        upto = np.cumsum(sizes)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - (upto - sizes), sizes) + np.arange(upto[-1])]
        return id_lists(np.concatenate([[0], upto])[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])], ids)


def write(docs: DataFrame, path: str, definition: str, end: int) -> None:
    """Encodes every whole text and writes doc_id, part, seq, n_tokens and ids as ORC.

    Null texts are empty, so their document is the end id alone. Rows are in
    ascending doc_id order (null first), equal ids in order of their text's
    hash; part numbers the files in this order and seq the rows of a part.
    Texts are dealt into ranges before they are encoded, so each is encoded
    once, and rows of one id can lie in several parts.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(definition), ("words", zlib.crc32(definition.encode()))
    order = [F.asc_nulls_first("doc_id"), F.asc("_tie")]
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        encoder, row = held(key, lambda: WordEncoder(shared.value)), 0
        for batch in batches:
            texts = batch.column(1)
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                ids = encoder.block(texts.slice(a, b - a), end)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.arange(row, row + b - a)), pc.list_value_length(ids), ids], ["doc_id", "part", "seq", "n_tokens", "ids"])
                row += b - a

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    numbered = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    encoded = numbered.mapInArrow(run, f"doc_id {kind}, part int, seq long, n_tokens int, ids array<int>")
    options = {"orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS, "orc.stripe.size": STRIPE_BYTES, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}
    encoded.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, n_tokens, ids."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of these ids; the filter reaches the files' statistics and Bloom filters."""
    return read(spark, path).filter(F.col("doc_id").isin(doc_ids))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the crc32 of its ids as little-endian unsigned 32-bit integers.

    Sums per part give each part's offset, so no task orders more than one file's rows.
    """
    rows = read(spark, path)
    per_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        ends = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())

    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    narrow = rows.select("doc_id", "part", "seq", F.col("n_tokens").cast("long").alias("n_tokens"), crc("ids").alias("ids_crc32"))
    run = narrow.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return run.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")
