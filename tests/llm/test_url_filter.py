from pyspark.sql import functions as F

from dijkstone.llm.queries import RULES
from dijkstone.llm.url_filter import judge


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme/x", "", "", None), ("http://WWW.Example.COM/en/1?x=/", "www.example.com", "/en/1", ("www.example.com/en/", "allow")),
        ("http://a.example.com/en/", "a.example.com", "/en/", ("example.com/en/", "block")), ("http://example.com/EN/", "example.com", "/EN/", ("com/", "allow")),
        ("https://b.net/es/x#y", "b.net", "/es/x", ("net/es/", "block")), ("https://b.net?q=1/es/", "b.net", "", None), ("x://c.com", "c.com", "", None),
        ("x://notexample.com/en/", "notexample.com", "/en/", ("com/", "allow")), ("x://net/fr/", "net", "/fr/", ("net/fr/", "block")), ("x://É.com/", "É.com", "/", ("com/", "allow")),
        ("x:///p", "", "/p", None), ("", "", "", None),
    ]
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(cases)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(0, 0), (None, 1), (5, None)], "page_id long, bad int")
    got = {x.page_id: x for x in judge(df, labels, RULES).collect()}
    assert len(got) == len(cases)
    for i, (_, host, path, rule) in enumerate(cases):
        x = got[i]
        assert (x.host, x.path) == (host, path)
        assert (x.rule, x.verdict) == (rule or (None, "allow"))
    assert judge(df.limit(0), labels, RULES).collect() == []


def test_bad_templates_are_blocked(spark):
    urls = [(i, f"http://h.org/{'spam' if i % 4 == 0 else 'shop' if i % 4 == 1 else 'news'}/item{i}") for i in range(2000)]
    urls += [(5000 + i, f"http://other.org/a/{i}") for i in range(100)]
    labels = [(i, int(i % 4 == 0 and i % 40 != 0)) for i, _ in urls[:2000] if i % 3]
    out = judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [])
    got = {(x.template, x.verdict) for x in out.where("host = 'h.org'").select("template", "verdict").distinct().collect()}
    assert ("/spam/*", "block") in got and all(v == "allow" for t, v in got if t != "/spam/*")
    assert out.where("host = 'other.org' and verdict = 'block'").count() == 0


def test_a_bad_branch_of_a_large_host_is_blocked(spark):
    """200 branches of 50 urls each: every branch has less than a hundredth of the host's urls."""
    names = [a + b for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    urls = [(50 * k + j, f"http://h.org/{name}/item{j}") for k, name in enumerate(names) for j in range(50)]
    labels = [(i, int(u.startswith("http://h.org/gd/"))) for i, u in urls]
    out = judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [])
    got = {(x.template, x.verdict): x.n for x in out.groupBy("template", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {("/gd/*", "block"): 50, ("/*/*", "allow"): 9950}


def test_deep_paths_long_urls_and_repeated_pages(spark):
    """Twelve levels down a branch is still told apart; a path of thousands of segments takes no rounds of its own."""
    deep = "/".join("abcdefghijkl")
    urls = [(i, f"http://h.org/{deep}/{'spam' if i % 2 else 'shop'}/x") for i in range(400)]
    urls += [(1000, "http://h.org/" + "/".join(["z"] * 5000)), (1000, "http://h.org/" + "/".join(["z"] * 5000)), (1, urls[1][1])]
    labels = [(i, i % 2) for i in range(400)]
    out = judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), [])
    got = {x.page_id: x for x in out.collect()}
    assert out.count() == len(urls)
    assert got[1].verdict == "block" and got[2].verdict == "allow"
    assert got[1].template == "/*" * 12 + "/spam/*" and got[2].template == "/*" * 12 + "/shop/*"
    assert got[1000].template == "/*" * 5000  # judged by its host, half of which is bad
