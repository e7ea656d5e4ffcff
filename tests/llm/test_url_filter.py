"""URL rules: globs against regular expressions, many rules, very long URLs, tables of rules, awkward rows."""

import random
import re
import time

import pytest

from foliospark.llm import queries, url_filter
from foliospark.llm.url_filter import Automaton, Rule


def as_pattern(glob):
    parts = re.split(r"(\*\*|\*)", re.sub(r"\*{3,}", "**", glob))
    return re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts), re.S)


@pytest.mark.parametrize(("most", "few"), [(1 << 18, 8), (64, 0), (40, 3), (1 << 18, 1_000)])
def test_globs_against_regular_expressions(monkeypatch, most, few):
    monkeypatch.setattr(url_filter, "MOST_WORDS", most)
    monkeypatch.setattr(url_filter, "FEW", few)
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "."]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.") for _ in range(rng.choice([0, 1, 5, 12, 16, 17, 40]))) for _ in range(200)]
    for rules in ([g] for g in globs):
        fits = Automaton([Rule(g, "block") for g in rules]).match([u.encode() for u in urls])
        assert [i == 0 for i in fits] == [bool(as_pattern(rules[0]).fullmatch(u)) for u in urls], rules
    first = [next((i for i, g in enumerate(globs) if as_pattern(g).fullmatch(u)), -1) for u in urls]
    assert Automaton([Rule(g, "block") for g in globs]).match([u.encode() for u in urls]).tolist() == first


def test_ten_thousand_rules(spark):
    rng = random.Random(5)
    names = sorted({f"host{rng.randrange(10**6)}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['', 'en/', 'de/x'])}" for _ in range(10_000)})
    rules = [Rule.domain("block", n) for n in names]
    urls = []
    for n in rng.sample(names, 150):
        host, _, path = n.partition("/")
        urls += [f"https://{host}/{path}", f"http://a.b.{host}/{path}more", f"http://x{host}/{path}", f"http://{host}"]
    got = url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), "url", rules).collect()
    by_host = {}
    for n in names:
        by_host.setdefault(n.partition("/")[0], []).append(n.partition("/")[2])

    def plain(host, path):
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            domain = ".".join(labels[i:])
            fits += [f"{domain}/{p}" for p in by_host.get(domain, []) if path.startswith("/" + p)]
        return max(fits, key=len, default=None)

    assert all(r["rule"] == plain(r["host"], r["path"]) for r in got) and sum(r["rule"] is not None for r in got) > 250


def test_a_url_of_a_million_bytes(spark):
    machine = Automaton(list(queries.URL_RULES))
    began = time.perf_counter()
    long = b"." + b"a.example.com/" + b"x/" * 500_000
    names = [queries.URL_RULES[i].pattern if i >= 0 else None for i in machine.match([long + b"/wp-login.php", long, long + b".js", b".a.net/" + b"y" * 1_000_000, b".b.com"] * 3)]
    assert names == ["**/wp-login.php**", None, "**/**.js", "*.net/**", None] * 3 and time.perf_counter() - began < 60
    got = url_filter.judge(spark.createDataFrame([("https://h.org/fr/" + "z" * 1_000_000,)], "url string"), "url", queries.URL_RULES).first()
    assert got["rule"] == "org/fr/" and len(got["path"]) == 1_000_004


def test_default_rules():
    rules = list(url_filter.DEFAULT_RULES)
    blocked = [".my-casino.com", ".casino.com/x", ".a.casino-b.org", ".a.doubleclick.net/x", ".h.com/a/wp-login.php?", ".h.com/b.zip", ".h.com/.git/config"]
    allowed = [".antispam.org", ".history-of-torrents.net/a", ".example.zip", ".h.com/spam", ".h.com/casino/poker", ".doubleclick", ".h.com/doubleclick.net", ".h.com/b.zip/x", ".h.com/js", "."]
    found = Automaton(rules).match([u.encode() for u in blocked + allowed]) >= 0
    assert found.tolist() == [True] * len(blocked) + [False] * len(allowed)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("domain", "net/", "block"), ("domain", "net/", "block"), ("glob", "**/x**", "block"), (None, "a", "block"), ("domain", "a.net/", "allow")], "kind string, pattern string, verdict string")
    rules = url_filter.rules_of(table)
    assert [r.name for r in rules] == ["a.net/", "net/", None]
    with pytest.raises(ValueError, match="more than 2"):
        url_filter.rules_of(table, most=2)
    with pytest.raises(ValueError, match="no rule"):
        url_filter.rules_of(table.selectExpr("'x' AS kind", "pattern", "verdict"))


def test_awkward_rows(spark):
    urls = [(1, None, "h", 5), (1, None, "h", 5), (2, "", None, None), (3, "://", "", 0), (None, "a://B.NET/É?q#f", "x", 1), (5, "x://a://b.net/", "", 1)]
    frame = spark.createDataFrame(urls, "page_id long, url string, host string, rule int")
    got = url_filter.judge(frame, "url", queries.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.count() == 6
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert found == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), None: ("b.net", "/É", "net/", "block"), 5: ("a:", "//b.net/", None, "allow")}
    assert url_filter.judge(frame.limit(0), "url", queries.URL_RULES).count() == 0
    tied = url_filter.judge(frame.filter("page_id IS NULL"), "url", [Rule("**", "allow", "one"), Rule("**", "block", "two")]).first()
    assert tied["rule"] == "one" and url_filter.judge(frame, "url", []).filter("verdict = 'block'").isEmpty()


def test_canonical_urls(spark):
    same = [("h.com", "/a.exe"), ("h.com", "/A.EXE"), ("h.com", "/a%2Eexe"), ("h.com:80", "/%61.ex%65"), ("u:p@h.com:443", "/x/../a.exe"), ("h.com.", "/./a.exe"), ("h.com:", "/b/./../a.exe"), ("h.com", "/../../a.exe")]
    assert {url_filter.canonical(h, p) for h, p in same} == {".h.com/a.exe"}
    other = [("h.com:8080", "/a", ".h.com:8080/a"), ("h.com", "/%2F%20%25", ".h.com/%2f%20%25"), ("h.com", "/%2541", ".h.com/%2541"), ("h.com", "/a/..", ".h.com/"), ("h.com", "/a/b/.", ".h.com/a/b/"), ("", "", "."), ("h.com", "", ".h.com"), ("h.com", "/a//b", ".h.com/a//b"), ("h.com", "/.git/x", ".h.com/.git/x"), ("h.com", "/...", ".h.com/...")]
    assert [url_filter.canonical(h, p) for h, p, _ in other] == [w for _, _, w in other]
    urls = ["/a.exe", "/A.EXE", "/a%2Eexe", "/x/../a.exe", "/WP-ADMIN/", "/wp%2Dadmin/", "/wp-admin"]
    got = url_filter.judge(spark.createDataFrame([(f"https://h.com{u}",) for u in urls], "url string"), "url", queries.URL_RULES).collect()
    assert [r["verdict"] for r in got] == ["block"] * 6 + ["allow"] and [r["path"] for r in got] == urls
    ranked = [Rule("**", "allow", "last", -1), Rule("**/x", "block", "glob", 5), Rule.domain("allow", "h.com/")]
    found = url_filter.judge(spark.createDataFrame([("a://h.com/x",), ("a://b.com/X",), ("a://b.com/y",)], "url string"), "url", ranked).collect()
    assert [r["rule"] for r in found] == ["h.com/", "glob", "last"]
