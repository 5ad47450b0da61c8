from rasterloom.llm import urls

URLS = [
    None, "", "no scheme/en/", "http://net", "http://net/", "HTTP://A.Example.NET/en/x", "https://example.net/EN/", "x://y://example.net/en/", "http://notexample.com/de/", "http://m.example.com/de/1?q#f", "http://example.com?/de/",
    "http://ex.org/fr/", "http://org/fr", "http://.net/x", "http://a.net.?x", "ftp://user@b.net:80/x", "http://b.net/" + "a/" * 5000, "http://" + "l." * 5000 + "net/en/", "http://example.net/en/?", "http://\nx.net/a\nb", "http://ÄB.net/", "http://org/fr/a", "http://org/fr/a",
]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def check(spark, rules):
    rows = [(i if i else None, u, "h", "v") for i, u in enumerate(URLS)]
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.rules_frame(spark, rules)).collect())))
    assert got == sorted(repr((r[0], *brute(r[1], rules))) for r in rows)


def test_production_rules(spark):
    check(spark, urls.RULES)


def test_many_rules_and_none(spark):
    check(spark, [("block" if i % 2 else "allow", f"h{i}.net", f"/p{i}") for i in range(300)] + [("block", "b.net", "/a/a/a"), ("allow", "b.net:80", "/"), ("block", "x.net", "/a\nb"), ("allow", "net", "")])
    check(spark, [])


def test_filter_has_no_false_negatives(spark):
    rules = urls.rules_frame(spark, [("block", f"h{i}.org", "/") for i in range(500)])
    blocks = 64
    words = urls.bloom_filter(rules, blocks).collect()[0].words
    assert len(words) == blocks
    from pyspark.sql import functions as F

    h = F.xxhash64("rule_host", "rule_path")
    for r in rules.select(urls._block(h, blocks).alias("b"), urls._mask(h).alias("m")).collect():
        assert words[r.b] & r.m == r.m


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.rules_frame(spark)).count() == 0
