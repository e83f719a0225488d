import pytest
from hauldeck.llm import url_filter as u


def given(spark):
    """Two hosts with unwanted pages only, one with seven in ten, and others with none; eight tokens a host."""
    pages, labels = [], []
    for k, (bad, n) in enumerate([(10, 20), (10, 20), (7, 20), (0, 40), (0, 40)]):
        for i in range(n):
            doc = 1000 * k + i
            pages.append((f"https://a{k}.b{k}.c{k}.d{k}/en/{doc}",))
            labels.append((doc, 1, int(i % 10 < bad)))
    return spark.createDataFrame(pages, "url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equivalent_rules_do_not_crowd_out_others(spark):
    rules = dict(u.mine(*given(spark), most=100))
    assert rules["host:d2",] == pytest.approx(0.7) and rules["host:d0",] == rules["word:a1",] == 1
    assert len(rules) == 24 and all(len(t) == 1 for t in rules)


def test_too_many_rules_fail(spark):
    with pytest.raises(ValueError, match="more than 20 rules"):
        u.mine(*given(spark), most=20)
