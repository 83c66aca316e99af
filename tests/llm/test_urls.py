import re

import pytest

from gneiss.llm.q_urls import RULES
from gneiss.llm.urls import SEVERAL, SOFT, STRICT, judged


def plainly(url, rules=RULES, strict=STRICT, soft=SOFT):
    """The same verdict by splitting and by a regular expression a term."""
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = "".join(c.lower() if c.isascii() else c for c in url)
    border = r"[a-z0-9\u0080-\U0010ffff]"
    found = {t: len(re.findall(rf"(?<!{border})(?={re.escape(t).replace(chr(92) + ' ', '[^a-z0-9' + chr(92) + 'u0080-' + chr(92) + 'U0010ffff]+')}(?!{border}))", low)) for t in strict + soft}
    s, w = sum(found[t] for t in strict), sum(found[t] for t in soft)
    d = sum(found[t] > 0 for t in soft)
    rule = max(fits)[2:] if fits else (None, "block" if s or d >= SEVERAL else "allow")
    return (host, path, *rule, s, w, d)


ODD = [
    None, "", "no scheme/casino", "://", "http://", "HTTP://WWW.Example.ORG/en/1?x", "http://example.org/en/2", "http://notexample.org/es/", "http://example.org/es", "http://Example.org:80/es/",
    "http://org/", "http://org", "http://a.org#/x", "http://x.com/de/casino", "http://x.com/fr/casino", "http://x.com/en/casino", "http://casinos.com/en", "http://x.net/ünpornü", "http://x.net/porn", "http://x.net/a?q=free&r=free",
    "http://x.net/free_bets", "http://x.net/win%20free", "http://x.net/win/win/adult", "ftp://a://b.org/c", "http://x.net/line\nbreak?porn\n", "http://ÄB.org/x", "http://x.net/" + "a/" * 200_000 + "casino", "casino", "http://x.net/free-free-bets-free",
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "h", 7) for i, u in enumerate(ODD + ODD)], "page_id long, url string, host string, `verdict` int")
    got = {r.page_id: tuple(r)[2:] for r in judged(df, RULES).collect()}
    assert len(got) == 2 * len(ODD)
    for i, u in enumerate(ODD + ODD):
        assert got[i] == plainly(u), u
    assert judged(df.where("false"), RULES).count() == 0
    assert {r.verdict for r in judged(df, [], [], []).collect()} == {"allow"}
    kept = judged(df.withColumn("a.b", df.page_id), RULES)
    assert kept.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms"] and kept.count() == 2 * len(ODD)


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.strict_hits, r.soft_hits, r.soft_terms) for r in judged(pages, RULES).collect()}
    assert got == {r.page_id: plainly(r.url) for r in pages.collect()}
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_rules_and_bounds(spark):
    df = spark.createDataFrame([("http://a.b.org/xy/z",)], "url string")
    same = judged(df, [("block", "org", "/x"), ("allow", "b.org", ""), ("block", "b.org", "")]).first()
    assert (same.rule, same.verdict) == ("b.org", "allow")
    tie = judged(df, [("block", "org", "/x"), ("allow", "b.org", ""), ("block", "a.b.org", "/xy/z"), ("allow", "a.b.org", "/xy/z")]).first()
    assert (tie.rule, tie.verdict) == ("a.b.org/xy/z", "block")
    with pytest.raises(ValueError):
        judged(df, [("maybe", "org", "/")])
    with pytest.raises(ValueError):
        judged(df, [], ["x" * 300])


def test_matches_sql(spark, sf):
    from gneiss.llm import q_urls
    from test_queries import same

    same(spark, sf, "op12_url_filters", q_urls.QUERIES["op12_url_filters"], q_urls.ORACLES["op12_url_filters"])
