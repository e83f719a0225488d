from hauldeck.llm import url_filter as u
from hauldeck.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/1", "https://www.example.com/en/2?x=/fr/", "http://example.com/en", "http://sub.example.com/en/3#y", "ftp://x.net/es/4", "x://y.net/fr/5", "http://y.net?/fr/", "http://notexample.com/en/6",
        "http://com/z", "a://b://c/d", "http://xcom/en/", "http://Ünet/es/", "http://p.org:80/a/b?k=1&l=2", "http://y.net/fr/\n/z", "//x.com/a"]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    tail = rest[n:]
    return host, tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def test_hosts_paths_and_stated_rules(spark):
    pages = spark.createDataFrame([(i, x, "h", "clash") for i, x in enumerate(URLS)] + [(4, URLS[4], "h", "clash")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = u.judged(pages, labels, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain(URLS[r.page_id])
        fit = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), URLS[r.page_id]


def test_mined_rules(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}{'-pills' if i % 4 == 0 else ''}.org/{'en' if i % 2 else 'de'}/{i}") for i in range(200)]
    pages = spark.createDataFrame([*rows, (999, "http://m.bad-pills.org/xx/7777"), (998, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    rules = u.mine(pages, labels)
    assert rules and all(c == 1.0 and len(t) == 1 for t, c in rules)  # longer rules with the same confidence are pruned
    got = {r.page_id: (r.verdict, r.confidence) for r in u.judged(pages, labels, []).collect()}
    assert all(got[i] == (("block", 1.0) if i % 4 == 0 else ("allow", None)) for i, _ in rows)
    assert got[999] == ("block", 1.0) and got[998] == ("allow", None)
    assert u.judged(pages.limit(0), labels, URL_RULES).count() == 0


def test_rules_match_like_sets(spark):
    rules = [(("a", "b"), 0.9), (("c",), 0.7), (("a", "c", "d"), 0.95)]
    items = [["a"], ["b", "a"], ["c", "a"], ["d", "c", "a", "x"], [], None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in items], "items array<string>").coalesce(1).select(u.matched(rules)("items")).collect()]
    assert got == [max((c for t, c in rules if set(t) <= set(i or ())), default=None) for i in items]
