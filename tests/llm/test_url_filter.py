import random
import re

from colsight.llm.catalog import GLOB_RULES, HOST_RULES
from colsight.llm.url_filter import ALLOW, BLOCK, GlobRule, HostRule, filter_urls
from tests.llm.conftest import rows_of


def brute(url, hosts, globs, default=ALLOW):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    for g in globs:
        parts = re.split(r"(\*\*|\*|\?)", g.glob)
        pattern = "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
        if re.fullmatch(pattern.encode(), (host + path).encode()):
            return host, path, None, g.verdict
    return host, path, None, default


URLS = [
    None, "", "no scheme", "http://", "://", "https://EXAMPLE.org", "https://example.org/", "https://a.b.example.org/es/1",
    "https://example.org/en/1", "https://example.org/en/12", "https://example.org/en/2", "https://notexample.com/fr/",
    "https://com/fr/x", "https://x.com/de/?q=/fr/", "https://x.net/x.org/", "https://.org/", "https://org/", "http://a://b/c",
    "https://blog.casino-win.example.net/en", "https://free-bets.example.net", "https://ÄÖ.org/ß", "https://h?x/y", "https://h#/y",
    "https://spam-farm.example.net" + "/a" * 3000, "https://x.net/spam-/" ,
]


def test_urls_as_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").repartition(3)
    want = sorted(((k, *brute(u, HOST_RULES, GLOB_RULES)) for k, u in enumerate(URLS)), key=repr)
    assert rows_of(filter_urls(pages, HOST_RULES, GLOB_RULES)) == want


def test_random_globs_over_many_words(spark):
    rnd = random.Random(3)
    hosts = [HostRule(rnd.choice((ALLOW, BLOCK)), h, p) for h in ("a", "b.a", "c") for p in ("/", "/a", "/ab/")]
    hosts = [r for k, r in enumerate(hosts) if k % 2 or r.path == "/"]
    letters = ["a", "b", "/", "*", "**", "?", "."]
    globs = [GlobRule(rnd.choice((ALLOW, BLOCK)), "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))) for _ in range(40)]
    urls = ["x://" + "".join(rnd.choice("ab/.c") for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(((k, *brute(u, hosts, globs, BLOCK)) for k, u in enumerate(urls)), key=repr)
    assert rows_of(filter_urls(pages, hosts, globs, BLOCK)) == want


def test_no_rules_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "x://h/p", "z", "z"), (1, "x://h/p", "z", "z"), (None, None, "z", "z")],
                                  "page_id int, url string, host string, rule string")
    assert rows_of(filter_urls(pages, ())) == [
        (1, "h", "/p", None, ALLOW), (1, "h", "/p", None, ALLOW), (None, "", "", None, ALLOW)
    ]
    assert filter_urls(pages.limit(0), HOST_RULES).count() == 0
