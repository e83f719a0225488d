"""The registered queries of this folder and their checking SQL."""

import os
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, chat, decontaminate, hard_negatives, line_dedup, masked_lm, minhash_dedup, orc_tokens, periodic_runs, simhash, toxicity, url_filter
from .shared import new_path, table

ENTRIES: dict = {}


def registered(sql: str | None = None):
    def add(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return add


@cache
def vocabulary_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


CHAT = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT *, md5(role || ':' || text) AS tie, CASE WHEN conv_id IS NULL THEN coalesce(turn::VARCHAR, '') || ':' || md5(role || ':' || text) ELSE '' END AS conv, CAST(floor(turn / 64) AS BIGINT) AS part FROM m),
s AS (SELECT DISTINCT conv, conv_id, part, role AS speaker FROM k WHERE role <> 'system'),
p AS (
  SELECT s.conv, s.conv_id, s.part, s.speaker, k.turn, k.tie, k.role = s.speaker AS own,
    '<|im_start|>' || CASE WHEN k.role = s.speaker THEN 'assistant' WHEN k.role = 'system' THEN 'system' ELSE 'user name=' || k.role END || chr(10) AS head,
    k.text || '<|im_end|>' || chr(10) AS body
  FROM s JOIN k ON k.conv = s.conv AND k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.part IS NOT DISTINCT FROM s.part),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv, conv_id, part, speaker ORDER BY turn, tie ROWS UNBOUNDED PRECEDING) AS stop FROM p)
SELECT conv_id, speaker, part, md5(string_agg(head || body, '' ORDER BY turn, tie)) AS text_md5,
  coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY turn, tie), '') AS spans,
  count(*)::INT AS n_turns, count(*) FILTER (own)::INT AS n_trained
FROM o GROUP BY conv, conv_id, part, speaker
"""


@registered(CHAT)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.whole_parts(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return shown.select("conv_id", "speaker", "part", F.md5(F.col("text").cast("binary")).alias("text_md5"), spans.alias("spans"), "n_turns", "n_trained")


@registered()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_component_ids(simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@registered()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, word_pattern(), back=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


CONTAINED = r"""
WITH words AS (SELECT item_id, string_split_regex(regexp_replace(lower(coalesce(text, '')), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
dwords AS (SELECT rowid AS r, doc_id, string_split_regex(regexp_replace(lower(coalesce(text, '')), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS w FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
shingles AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dwords)),
hits AS (SELECT r, doc_id, item_id, count(*) AS c FROM shingles JOIN items USING (s) GROUP BY r, doc_id, item_id)
SELECT doc_id, item_id, c::INT AS n_shared, n::INT AS n_shingles FROM hits JOIN sizes USING (item_id) WHERE c >= greatest(1, ceil(0.8 * n - 1e-9))
"""


@registered(CONTAINED)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered()
def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    path = new_path(spark, "tokens")
    orc_tokens.write(table(spark, sf_dir, "documents"), path, definition, end=2)
    return orc_tokens.positions(spark, path)


@registered()
def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.train_and_score(table(spark, sf_dir, "documents"))


@registered()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@registered()
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


@registered()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("doc")).alias("text_md5"), "n_lines", F.size("removed").alias("n_removed"), "removed")


SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM d),
tf AS (SELECT r, doc_id, t, count(*) AS c FROM w GROUP BY ALL),
len AS (SELECT r, sum(c) AS l FROM tf GROUP BY r),
g AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT sum(l) FROM len) / (SELECT count(*) FROM d) AS a),
df AS (SELECT t, ln(1 + ((SELECT n FROM g) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY t),
q AS (SELECT DISTINCT doc_id AS query_id, md5(text) AS query_key, r FROM d WHERE doc_id % 20 = 0),
s AS (
  SELECT q.query_id, q.query_key, x.r, x.doc_id, round(sum(df.idf * x.c * 2.2 / (x.c + 1.2 * (0.25 + 0.75 * len.l / (SELECT a FROM g)))), 6) AS score
  FROM q JOIN tf AS y ON y.r = q.r JOIN tf AS x ON x.t = y.t JOIN df ON df.t = x.t JOIN len ON len.r = x.r GROUP BY ALL)
SELECT query_id, rank, doc_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_key ORDER BY score DESC, s.doc_id NULLS LAST)::INT AS rank FROM s) WHERE rank <= 10
"""


@registered(SEARCH)
def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter("doc_id % 20 = 0")).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth text by crc32(doc_id) the words from some place on repeat with a period."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    named = docs.select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"))
    words = named.select("*", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("w"))
    n = F.size("w")
    placed = words.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", index(i))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@registered()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), listed.alias("listed"), "collapsed")
    return best.select(
        "doc_id", "n_runs", (-F.col("b.s")).alias("start"), "b.length", (-F.col("b.p")).alias("period"), F.floor(1000 * F.col("b.length") / -F.col("b.p")).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


NEAR = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s AS x JOIN s AS y USING (s) WHERE x.r < y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(a, b) AS (SELECT r, r FROM w UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
c AS (SELECT t.a, min(o.doc_id) AS component_id FROM t JOIN w AS o ON o.r = t.b GROUP BY t.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM w JOIN c ON c.a = w.r LEFT JOIN n USING (r)
"""


@registered(NEAR)
def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


HARD = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS k FROM p WHERE same) WHERE k <= 5),
n AS (
  SELECT g.anchor_id, g.id AS positive_id, p.id AS negative_id, g.s AS positive_score, p.s AS negative_score, row_number() OVER (PARTITION BY g.anchor_id, g.id ORDER BY p.s DESC, p.id) AS rank
  FROM g JOIN p ON p.anchor_id = g.anchor_id AND NOT p.same AND 80 * g.s <= 100 * p.s AND p.s <= g.s)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@registered(HARD)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.when(finite, whole).alias("vector"))
    return hard_negatives.hard_negatives(rows, "id % 100 = 0", positives=5, negatives=5, percent=80, id="vec_id")


@registered()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
