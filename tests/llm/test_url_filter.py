from pyspark.sql import functions as F
from helpers import spark_rows, sql_rows

from pipecheck.llm import url_filter

URLS = [
    "http://Www.Example.ORG/es/x", "https://example.org/en/17?q=/es/", "https://a.b.example.org/en/2#f", "http://example.com/fr/a", "x://com/de/",
    "http://notcom/de/1", "ftp://m.site.com/de", "http://m.site.com/de/9", "no scheme/com/de/", None, "", "http://", "http://?x", "a://b://c/d",
    "http://line\nbreak.net/p\nq?r", "http://h.net",
]


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_parts_and_rules(spark):
    df = pages(spark, URLS).withColumn("host", url_filter.url_host(F.col("url"))).withColumn("path", url_filter.url_path(F.col("url")))
    rule = url_filter.longest_rule(F.col("host"), F.col("path"), url_filter.RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in df.select("page_id", "host", "path", rule["rule"].alias("rule")).collect()}
    assert got[0] == ("www.example.org", "/es/x", "example.org/es/")
    assert got[1] == ("example.org", "/en/17", "example.org/en/1")
    assert got[2] == ("a.b.example.org", "/en/2", "org/")
    assert got[3] == ("example.com", "/fr/a", "com/fr/")
    assert got[4] == ("com", "/de/", "com/de/")
    assert got[5] == ("notcom", "/de/1", None)
    assert got[6] == ("m.site.com", "/de", None)
    assert got[7] == ("m.site.com", "/de/9", "com/de/")
    assert got[8] == got[9] == got[10] == ("", "", None)
    assert got[11] == got[12] == ("", "", None)
    assert got[13] == ("b:", "//c/d", None)
    assert got[14] == ("line\nbreak.net", "/p\nq", None)
    assert got[15] == ("h.net", "", None)


def brute(pages_, bad):
    """The same shrinkage in plain Python."""
    hosts = {}
    for page, host in pages_:
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + 1, b + bad[page]) if page in bad else (n, b)

    def level(groups, parents):
        over = sum(n * (b / n - parents[g]) ** 2 - parents[g] * (1 - parents[g]) for g, (n, b) in groups.items() if n)
        room = sum(parents[g] * (1 - parents[g]) * (n - 1) for g, (n, b) in groups.items() if n)
        rho = min(max(over / room if room else 0, url_filter.RHO[0]), url_filter.RHO[1])
        w = 1 / rho - 1
        return w, {g: (w * parents[g] + b) / (w + n) for g, (n, b) in groups.items()}

    def rolled(key):
        out = {}
        for h, (n, b) in hosts.items():
            m, c = out.get(key(h), (0, 0))
            out[key(h)] = (m + n, c + b)
        return out

    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    total_n, total_b = (sum(x[k] for x in hosts.values()) for k in (0, 1))
    _, s = level(rolled(suffix), dict.fromkeys(rolled(suffix), (total_b + 0.5) / (total_n + 1)))
    _, d = level(rolled(domain), {g: s[suffix(g)] for g in rolled(domain)})
    w, h = level(hosts, {g: d[domain(g)] for g in hosts})
    return {g: m - url_filter.Z * (m * (1 - m) / (w + hosts[g][0] + 1)) ** 0.5 for g, m in h.items()}


def test_reputation(spark):
    hosts = ["good.a.com", "bad.a.com", "x.b.com", "y.b.com", "spam.c.net", "one", ""]
    listed = [(n, hosts[n % 7] if n % 2 else "good.a.com") for n in range(400)]
    bad = {n: int(h.startswith(("bad", "spam")) and n % 5 > 0 or n % 41 == 0) for n, h in listed if n % 3}
    df = spark.createDataFrame(listed, "page_id long, host string")
    outcomes = spark.createDataFrame([*bad.items(), (7777, 1), (3, None)], "page_id long, bad int")
    got = {r["host"]: r["bound"] for r in url_filter.host_reputation(df, outcomes).collect()}
    want = brute(listed, bad)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want)
    assert got["bad.a.com"] > url_filter.MOST_BAD > got["good.a.com"] and got["spam.c.net"] > url_filter.MOST_BAD


def test_against_sql(spark):
    urls = [*URLS, *(f"http://{'spam' if n % 4 == 0 else 'h%d' % (n % 9)}.site{n % 3}.net/p{n}" for n in range(300))]
    df = pages(spark, urls)
    labels = spark.createDataFrame(
        [(n, int("spam" not in (urls[n] or "")), 0) for n in range(0, 316, 2)] + [(1, None, 1), (3, None, None), (5, None, 0)], "doc_id long, quality int, toxic int"
    )
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    got = url_filter.filter_urls(df, outcomes, url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")
    sql = url_filter.SQL
    assert spark_rows(got) == sql_rows(sql, {"pages": df, "labels": labels})
    assert {r["verdict"] for r in got.filter("host like 'spam%'").collect()} == {"block"}


def test_no_outcomes_extra_columns_no_rows(spark):
    df = pages(spark, URLS).withColumn("HOST", F.lit(1)).withColumn("other", F.lit(2))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.filter_urls(df, none, ())
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    assert {r["verdict"] for r in got.collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), none, url_filter.RULES).count() == 0
    twice = url_filter.filter_urls(df.union(df), none, ())
    assert twice.count() == 2 * len(URLS)
