import duckdb
import pytest
from hauldeck.llm import chat, queries

ROWS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello\nthere"), (1, 2, "ann", "ties"), (1, 2, "ann", "ties"), (1, 3, None, "who?"), (1, None, "bob", "late"), (1, 70, "ann", None),
        (None, 1, "ann", "alone"), (None, 1, "bob", "also alone"), (2, 0, "system", "nobody speaks"), (3, 5, "é", "ü😀")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, speaker string").repartition(3)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    path = "/root/testdata/sf0.001/conversations.parquet"
    for source, sql in ((table(spark, ROWS), queries.CHAT), (spark.read.parquet(path), queries.CHAT.replace("FROM conversations", f"FROM '{path}'"))):
        shown = chat.rendered(source).selectExpr("conv_id", "speaker", "part", "md5(cast(text as binary)) m", "array_join(transform(spans, s -> concat_ws('-', s.start, s.end)), ',') s", "n_turns", "n_trained")
        assert sorted(map(str, map(tuple, shown.collect()))) == sorted(map(str, con.execute(sql).fetchall()))


def test_masks_cover_what_the_speaker_says(spark):
    rows = {(r.conv_id, r.speaker, r.part): r for r in chat.rendered(table(spark, ROWS)).collect()}
    bob = rows[1, "bob", 0]
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["Hello\nthere<|im_end|>\n"]
    assert "user name=ann\nHi" in bob.text and "<|im_start|>system\nBe kind." in bob.text and bob.text.count("ties") == 1
    assert {k[1] for k in rows if k[0] == 1 and k[2] == 0} == {"ann", "bob", "unknown"} and not [k for k in rows if k[0] == 2]
    assert chat.rendered(table(spark, [])).count() == 0


@pytest.mark.parametrize("turns", [1, 50])
def test_crowded_parts_are_split_in_order(spark, turns):
    rows = [(9, i % turns, "ab"[i % 2], f"message {i}") for i in range(400)]
    out = chat.rendered(table(spark, rows), turns=64, most=40).filter("speaker = 'a'").orderBy("part", "sub").collect()
    assert len(out) > 4 and max(r.n_turns for r in out) < 120 and sum(r.n_turns for r in out) == 400
    seen = [int(x.split("<")[0].split()[-1]) % turns for r in out for x in r.text.split("\n") if x.startswith("message")]
    assert seen == sorted(seen)


def test_crowded_parts_are_whole(spark, tmp_path):
    """A part of 700 messages, of one turn or many, with speakers who are silent in most of its pieces: one row each, as the SQL has it."""
    rows = [(c, i % turns, "system" if i == 3 else "zoe" if i == 5 else "abc"[i % 3], f"message {i}" * (i % 4)) for c, turns in ((1, 1), (2, 60), (None, 2)) for i in range(700)]
    rows += [(1, None, "ann" if i % 50 else "rare", f"late {i}") for i in range(600)] + [(4, 1, "ann", "short")]
    source = table(spark, rows)
    source.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    want = con.execute(queries.CHAT.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, queries.op1_chat_format(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
    zoe = chat.rendered(source).filter("speaker = 'zoe' and conv_id = 2").collect()
    assert len(zoe) > 1 and sum(r.n_turns for r in zoe) == chat.whole_parts(source).filter("speaker = 'zoe' and conv_id = 2").first().n_turns


def test_no_python_in_the_plan(spark):
    assert "Python" not in chat.rendered(table(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
