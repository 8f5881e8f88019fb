import random

from trussline.llm import url_filter as U


def plain(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_equals_plain_rules(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "WWW.Example.COM", "a.b.example.net", "example.net", "notexample.com", "org", "x.org", "É.com", "", "example.com:80", "." * 3000 + "com"]
    paths = ["", "/", "/en/", "/en/7", "/en/71/x", "/de/8", "/de/9", "/es/", "/EN/", "/en", "/de/" + "p" * 5000]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/7", "#f", "?u=http://example.com/en/7")] + [None, "", "no scheme/en/", "://com/en/", "a\n://com/en/\nx"]
    pages = spark.createDataFrame([(i % 300, u, "html", "h", "block") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.filter_urls(pages, U.rule_rows(spark)).collect())
    want = sorted((i % 300, *((h, p, r or "", v))) for i, u in enumerate(urls) for h, p, r, v in [plain(u, U.RULES)])
    assert got == want


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_FILTER_BYTES", 32)  # one block: nearly every candidate passes the filter
    rules = [(f"h{i}.com", f"/{'p' * (i % 5)}", "block") for i in range(300)]
    urls = [f"http://s.h{i}.com/ppp/{i}" for i in range(0, 900, 2)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.filter_urls(pages, U.rule_rows(spark, rules)).collect()}
    assert got == {i: plain(u, rules)[3] for i, u in enumerate(urls)} and "allow" in got.values() and "block" in got.values()


def test_empty_list_and_table(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(pages, U.rule_rows(spark, [(None, "/", "block")])).collect()] == ["allow"]
    assert U.filter_urls(pages.limit(0), U.rule_rows(spark)).count() == 0
