"""URL filters against plain parsing, counting and matching."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridcast.llm import url_filter
from gridcast.llm.queries import PAGE_RULES
from gridcast.llm.url_filter import Rule

URLS = [
    None, "", "no scheme/a/b", "http://", "https://a.org", "https://a.org/", "HTTPS://Sub.Example.ORG/es/x?y=1", "https://example.org/en/1",
    "https://example.org/en/2", "https://myexample.org/es/", "ftp://x.com/de/a.html", "ftp://x.com/fr/?q#f", "ftp://x.com/frz/", "http://org/x",
    "http://É.com/de/É", "http://a.net/b://c/d", "http://a.net?x/y", "http://a.net#/de/", "http://" + "a." * 3000 + "com/de/", "://h.com/de/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def by_list(host, path, rules=PAGE_RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def tokens(url):
    host, path = parts(url)
    label, dots = path.split("/"), host.split(".")
    end = label[-1].rsplit(".", 1)
    out = {"tld=" + dots[-1], "site=" + ".".join(dots[-2:]), "host=" + host, f"depth={len(label) - 1}", "ending=" + (end[1] if len(end) > 1 else ""), f"query={'?' in (url or '')}".lower()}
    out.add("scheme=" + (url.split("://", 1)[0] if url and "://" in url else ""))
    return out | {f"path{i}={x}" for i, x in enumerate(label) if i}


def subsets(t):
    t = sorted(t)
    return (c for n in range(1, len(t) + 1) for c in combinations(t, n))


def plain(urls, rules=PAGE_RULES, support=0.01, confidence=0.8):
    """All combinations of any size; those of equal pages are counted once and weighted."""
    known = Counter((frozenset(tokens(u)), by_list(*parts(u), rules).verdict) for u in urls if by_list(*parts(u), rules))
    size, every, by_verdict = sum(known.values()), Counter(), Counter()
    for (t, v), n in known.items():
        for a in subsets(t):
            every[a] += n
            by_verdict[a, v] += n
    found = {k: (n / every[k[0]], n / size) for k, n in by_verdict.items() if n >= support * size and n / every[k[0]] >= confidence}
    kept = {(a, v): s for (a, v), s in found.items() if not any(found.get((x, v), (0, 0))[0] >= s[0] for x in subsets(a) if len(x) < len(a))}
    out = []
    for u in urls:
        host, path = parts(u)
        rule = by_list(host, path, rules)
        best = None if rule else max(((*s, v == "block", " ".join(a), v) for (a, v), s in kept.items() if set(a) <= tokens(u)), default=None)
        out.append((host, path, rule and rule.text, rule.verdict if rule else best[-1] if best else "allow"))
    return sorted(out, key=str)


def judged(spark, urls, rules=PAGE_RULES):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, tokens int")
    return sorted((tuple(r)[1:] for r in url_filter.judged(df, rules).collect()), key=str)


def test_hosts_paths_and_list(spark):
    got = judged(spark, URLS)
    assert [g[:3] for g in got] == [p[:3] for p in plain(URLS)]


@pytest.mark.parametrize("hot", [0, 300])
def test_mined_rules(spark, hot):
    hosts = ["a.com", "b.com", "c.org", "example.org", "d.net", "e.net", "news.d.net"]
    paths = ["/de/x/1.html", "/fr/y", "/es/z?q", "/en/1", "/en/2.php", "/de/q.pdf", "/", "/es/1.html"]
    urls = [f"http{'s' * (i % 2)}://{hosts[i % 7]}{paths[i * 5 % 8]}" for i in range(250)] + URLS + ["http://hot.net/de/x/1.html"] * hot
    got = judged(spark, urls)
    assert got == plain(urls)
    assert {g[3] for g in got if g[2] is None} == {"allow", "block"}


def test_a_rule_of_three_tokens_in_the_third_segment(spark):
    """Only the end, the scheme and the third segment together tell a blocked page; each one and two of them are of both kinds."""
    rules = [Rule("block", "bad.com", "/"), Rule("allow", "good.com", "/")]
    urls = []
    for i in range(8):
        scheme, third, end = ("http", "https")[i & 1], ("x", "y")[i >> 1 & 1], ("php", "html")[i >> 2]
        host = "bad.com" if i == 0 else "good.com"
        urls += [f"{scheme}://{host}/a/b/{third}/{n}{i}.{end}" for n in range(20)]
    asked = [f"{s}://new.net/a/b/{t}/q.{e}" for s in ("http", "https") for t in ("x", "y") for e in ("php", "html")]
    got = judged(spark, urls + asked, rules)
    assert got == plain(urls + asked, rules)
    assert [g[1] for g in got if g[0] == "new.net" and g[3] == "block"] == ["/a/b/x/q.php"]


def test_deep_paths(spark):
    """Forty segments that always come together are mined as one token."""
    rules = [Rule("block", "bad.com", "/"), Rule("allow", "good.com", "/")]
    deep = "/".join(f"s{i}" for i in range(40))
    urls = [f"http://bad.com/{deep}/{i}" for i in range(30)] + [f"http://good.com/t/{i}" for i in range(30)]
    asked = ["http://c.net/s0/s1", "http://c.net/u/s1/v", "http://c.net/t/0", f"http://c.net/{deep}"]
    made = {g[1]: g[3] for g in judged(spark, urls + asked, rules) if g[0] == "c.net"}
    assert made == {"/s0/s1": "block", "/u/s1/v": "block", "/t/0": "allow", f"/{deep}": "block"}


def test_tokens_of_the_same_pages_share_a_name(spark):
    rows = [(0, ["a", "b", "c"]), (1, ["a", "b", "d"]), (2, ["c", "e"]), (3, ["a", "b", "c", "f"])]
    df = spark.createDataFrame(rows, "page long, tokens array<string>")
    names = {r.token: r["name"] for r in url_filter.together(df, 2).collect()}
    assert names == {"a": "a", "b": "a", "c": "c"}
    assert {r["name"] for r in url_filter.together(df, 1).where("token IN ('d', 'e', 'f')").collect()} == {"d", "e", "f"}


def test_without_rules_or_rows(spark):
    assert {g[2:] for g in judged(spark, URLS, [])} == {(None, "allow")}
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(empty, PAGE_RULES).count() == 0
    assert url_filter.mined(empty.select(F.array("url").alias("tokens"), F.lit("allow").alias("verdict"))).count() == 0


def test_longest_rule_wins(spark):
    rules = [Rule("block", "com", "/"), Rule("allow", "a.com", "/"), Rule("block", "a.com", "/x")]
    assert {g[2] for g in judged(spark, ["http://w.a.com/x1", "http://a.com/y", "http://ba.com/x"], rules)} == {"a.com/x", "a.com/", "com/"}
