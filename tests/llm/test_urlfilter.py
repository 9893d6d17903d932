"""URL filters against brute force over all rules."""

from hirelake.llm import urlfilter as U

URLS = ["http://a.net/x", "HTTPS://A.NET/", "http://net", "http://net/", "http://xnet/", "a.example.net/en/", "x://EXAMPLE.net/en/q?y#z",
        "http://example.net/en", "http://a.example.com/de/1", "http://example.com/DE/", "https://b.org/fr/#x", "https://b.org?fr/", None, "", "://",
        "http://user@h.net:80/", "http://u://net/", "http://.net/", "http://a..net/" + "p/" * 3000, "http://" + "a." * 2000 + "net/", "http://é.Net/ü",
        "http://b.org/fr/"]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[:min(ends)] if ends else rest
        path = rest[len(host):]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    won = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, won[3], won[4]


def check(spark, rules):
    df = spark.createDataFrame([(i, u, "w") for i, u in enumerate(URLS)], "page_id bigint, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, U.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_contract_rules(spark):
    check(spark, U.RULES)


def test_other_rules_ties_and_prefixes(spark):
    check(spark, [("allow", "a.net", "/x"), ("block", "a.net", "/x"), ("block", "example.net", "/e"), ("allow", "net", "/x"), ("block", "org", ""),
                  ("block", "org", "")])


def test_no_rules_null_rules_and_empty_pages(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id bigint, url string")
    none = spark.createDataFrame([("block", None, "/")], "verdict string, host string, path string")
    assert [(r.rule, r.verdict) for r in U.judge(df, none).collect()] == [(None, "allow")] * 2
    assert [r.rule for r in U.judge(df, U.rule_table(spark)).collect()] == ["net/"] * 2
    assert U.judge(df.limit(0), U.rule_table(spark)).count() == 0


def test_plan_is_native(spark):
    df = U.query(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
