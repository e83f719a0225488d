"""The pipeline's rows against its stages' own rules, in plain Python."""

import corpus_pipeline
import tiktoken
from hauldeck.llm import bpe, queries, toxicity
from test_decontaminate import grams

SF = "/root/testdata/sf0.001"


def test_rows(spark):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    library = tiktoken.Encoding("own", pat_str=queries.word_pattern(), mergeable_ranks=bpe.read_ranks(queries.vocabulary_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert 0.5 * len(docs) < len(rows) < len(docs) and all(r.exact and r.n_tokens == len(r.ids) for r in rows.values())
    texts = {i: library.decode(r.ids) for i, r in rows.items()}
    for i, text in texts.items():
        assert scores[i] < 0.7
        lines = iter(docs[i].text.split("\n"))  # the kept lines, in order
        assert text == "" or all(line in lines for line in text.split("\n"))
        assert not any(s and len(s & grams(text)) >= 0.8 * len(s) for s in items)
    whole = [line for t in texts.values() for line in t.split("\n") if line.strip()]
    assert len(whole) == len(set(whole))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns
        assert step(spark, docs.limit(0), SF).count() == 0


def test_planted_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, copies, near copies, a benchmark passage, a toxic text, columns with clashing names."""
    words = lambda name, n: " ".join(f"{name}{i * 7 % n}" for i in range(n))
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    insult = max((r for r in docs.collect() if r.doc_id in toxic and not r.doc_id % 3 == 0), key=lambda r: len(r.text or "")).text
    planted = [(90_001, None), (90_002, ""), (90_003, " \t "), (90_010, words("a", 200)), (90_011, words("a", 200) + " and more"), (90_020, words("b", 90)), (90_020, words("b", 90)), (90_021, words("b", 90)),
               (90_030, words("c", 40) + " " + item + " " + words("d", 40)), (90_040, insult.replace("\n", " ") + " " + insult.replace("\n", "  ")), (90_050, words("e", 60_000)), (90_060, words("f", 150)), (None, words("g", 120))]
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", 1, [1]) for i, t in planted]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, root int, removed array<int>")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [r.doc_id for r in out if r.doc_id is None or r.doc_id > 90_000]
    # of texts without words one row stays in all, that of the smallest id
    assert sorted((x for x in got if x is not None)) == [90_010, 90_020, 90_050, 90_060] and got.count(None) == 1
    assert sum(r.n_tokens == 0 for r in out) == 1 and all(r.exact for r in out)
    library = tiktoken.Encoding("own", pat_str=queries.word_pattern(), mergeable_ranks=bpe.read_ranks(queries.vocabulary_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id: library.decode(r.ids) for r in out}[90_050] == words("e", 60_000)
