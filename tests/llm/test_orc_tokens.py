import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus_cases import LONG, made  # noqa: F401
from hauldeck.llm import orc_tokens, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from tokenizers import Tokenizer

with open(queries.vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()
LIBRARY, ENCODER = Tokenizer.from_str(DEFINITION), orc_tokens.WordEncoder(DEFINITION)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB \n\t'sΣİ.,é̀1٣ |<>"), st.characters(codec="utf-8"))).map(lambda t: t.replace("|<", "<|endoftext|>")), min_size=1, max_size=4))
def test_words_equal_whole_texts(texts):
    whole = [[*e.ids, 2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert ENCODER.block(pa.array(texts, pa.string()), 2).to_pylist() == whole


@pytest.mark.parametrize("count", [0, 300])
def test_files_and_positions(spark, made, tmp_path, count):  # noqa: F811
    rows = [(i * 7 % 300, f"Text number {i} " * (i % 9)) for i in range(count)]
    rows += [(5, "again"), (5, "again"), (None, "no id"), (1000, None), (1001, ""), (1002, LONG)] if count else []
    path = str(tmp_path / "t")
    orc_tokens.write(made(rows), path, DEFINITION, 2)
    got = orc_tokens.positions(spark, path).orderBy("start").collect()
    ids = {r: [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in set(rows)}
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids[r]), zlib.crc32(np.array(ids[r], "<u4").tobytes())) for r in rows)
    if count:
        assert sorted(r.ids for r in orc_tokens.lookup(spark, path, [14, 1002]).collect()) == sorted(ids[r] for r in rows if r[0] in (14, 1002))
        assert "PushedFilters: [In(doc_id" in orc_tokens.lookup(spark, path, [14, 1002])._jdf.queryExecution().executedPlan().toString()
        assert sum(orc.ORCFile(p).nrows for p in tmp_path.glob("t/*.orc")) == len(rows)


def test_plain_words_need_the_model_only():
    """Of words of plain form, whatever their script, only matches go to the model; the ids are those of whole texts."""
    texts = ["Plain words, it's 12 of them: a-b $$$ 'VEry' end.", "größer ÄHNLICH слово كلمة 单词", "", "a"]
    encoder = orc_tokens.WordEncoder(DEFINITION)
    encoder.tokenizer = None  # the whole call is not needed
    assert encoder.block(pa.array(texts), 2).to_pylist() == [[*e.ids, 2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_every_character_inside_a_word():
    texts = [f"a{chr(c)}B" for c in range(32, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or chr(c).isalpha() or c % 97 == 0)]
    assert ENCODER.block(pa.array(texts), 2).to_pylist() == [[*e.ids, 2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("changed", [lambda d: d["normalizer"]["normalizers"].pop(), lambda d: d["pre_tokenizer"]["pretokenizers"].reverse(), lambda d: d.update(normalizer=None)])
def test_other_definitions_go_through_the_library(changed):
    definition = json.loads(DEFINITION)
    changed(definition)
    assert orc_tokens._finder(DEFINITION) and orc_tokens._finder(json.dumps(definition)) is None
