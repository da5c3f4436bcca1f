import random

from planloom.llm import url_filter
from planloom.llm.queries import RULES


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if ("." + host).endswith("." + h) and path.startswith("/" + p):
            fits.append((-len(rule), verdict != "block", rule, verdict))
    return (host, path, *((min(fits)[2], min(fits)[3]) if fits else (None, default)))


URLS = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/en/", "https://example.com/en/x?y#z", "https://xexample.com/en/1", "http://a.net/es/1",
        "http://net/fr/", "http://net/fr", "http://a.b.net/fr/?q", "http://com", "http://com/", "x://u:p@h.com:80/en/", "http://é.com/en/ß", "http://a.net.com.org/com/",
        "http://example.com?x=://www.example.com/en/", "http://ÀB.NET/es/\nx", "http://www.example.com/en/" + "a/" * 50_000, "http://" + "www." * 20_000 + "net/es/"]


def test_judge_equals_plain_version(spark):
    random.seed(3)
    urls = URLS + [f"http{'s' * random.randint(0, 1)}://" + ".".join(random.choices(["www", "example", "com", "net", "x", "EXAMPLE"], k=random.randint(1, 4)))
                   + random.choice(["", "/", "?", "#"]) + "/".join(random.choices(["en", "es", "fr", "e", ""], k=random.randint(0, 4))) for _ in range(3000)]
    rows = [(k, u, "old", 1) for k, u in enumerate(urls)] + [(0, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string, extra int")
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, RULES), r.url
    assert "extra" in got[0].asDict()


def test_many_rules_over_several_words_and_wildcards(spark):
    random.seed(4)
    rules = [(random.choice(["allow", "block"]), f"h{k}.com/{'p' * (k % 5)}") for k in range(80)] + [("block", "com/"), ("allow", "com/")]
    rows = [(k, f"http://a.h{random.randint(0, 90)}.com/{'p' * random.randint(0, 6)}") for k in range(500)]
    for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect():
        assert (r.rule, r.verdict) == plain(r.url, rules)[2:]
    fits = url_filter.Automaton(["a*c", "a?c", "*x*y*", "~/z"]).run(["abc", "ac", "axbyc", "h/z", "a/b/z", ""])
    assert fits.tolist() == [[True, True, False, False], [True, False, False, False], [True, False, True, False], [False, False, False, True], [False] * 4, [False] * 4]


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(df, [], default="block").first().verdict == "block"
    assert url_filter.judge(df.limit(0), RULES).count() == 0
