"""From raw documents to token ids: toxicity, line dedup, near-duplicates, benchmark items, byte-level BPE.

Each stage works on all rows that the stage before it kept; stages before the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hauldeck.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from hauldeck.llm.queries import vocabulary_path, word_pattern
from hauldeck.llm.shared import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, width=4, radius=4)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text again."""
    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, word_pattern(), keep=["doc_id", "text"], back=True)
    return ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_items),
    ("byte BPE", encode),
]

#: None: edit distances, fingerprints and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of what the stages keep of documents.

    Null texts are empty throughout: they are not toxic, have no line to lose,
    and are one near-duplicate group with empty and wordless texts, of which
    one row stays. Rows equal in id and text are one group, so one stays. Long
    texts are worked on whole; other columns, whatever their names, pass through
    up to the last stage. Empty tables give empty results.
    """
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
