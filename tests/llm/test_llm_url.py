from chunkmill.llm import url_filter as U


def test_boundaries_and_distinct_terms():
    assert U.count_terms("http://casino.example/") == (1, 0) and U.count_terms("http://casinos.example/") == (0, 0)
    assert U.count_terms("http://x/cheap-pills/cheap") == (0, 2) and U.count_terms("http://x/cheap/cheap") == (0, 1)
    assert U.count_terms("http://x/adult-x") == (1, 1) and U.count_terms("http://x/adult-xy") == (0, 1)


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, c int")
    return [(r.host, r.path, r.rule, r.verdict) for r in U.judge(df).orderBy("page_id").collect()]


def test_rules_and_edges(spark):
    assert judged(spark, ["HTTPS://WWW.Example.COM/en/1?q", "http://m.example.com/en/", "http://a.com/casino", "http://acom/x", None, "no scheme casino",
                          "http://b.net/fr/x#y", "http://b.net/FR/x", "http://c.org?x=/free-bets", "http://d.com", "x://y://z/a"]) == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("m.example.com", "/en/", "example.com/en/", "block"),
        ("a.com", "/casino", "com/", "allow"), ("acom", "/x", None, "allow"), ("", "", None, "allow"), ("", "", None, "block"),
        ("b.net", "/fr/x", "net/fr/", "block"), ("b.net", "/FR/x", None, "allow"), ("c.org", "", None, "block"), ("d.com", "", None, "allow"),
        ("y:", "//z/a", None, "allow")]
    assert judged(spark, ["http://x/" + "a" * 1_000_000 + "/porn"])[0][3] == "block"
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
