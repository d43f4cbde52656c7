import re

from calibra.llm import urlfilter

URLS = [None, "", "no scheme/x", "http://Example.ORG/es/1?x=1", "http://a.example.org/en/12", "http://example.org/en/2#x",
        "https://notexample.org/es/", "ftp://x.com/fr/", "http://com/de/x", "http://B.com/de", "http://B.com/de/?q#", "http://org",
        "http://org?/", "http://spam-farm.example.net/a", "http://www.Spam-Farm.example.com/x/abuse-report", "x://spam-farm.org/q",
        "http://xspam-farm.net/", "http://a.net/x?jsessionid=ab12", "http://a.net/f.zip?x", "http://a.net/wp-login.php",
        "http://casino-x.net://b.org/", "http://É.net/VIAGRA", "http://a.net/payday-loans", "http://a.net/payday-loan-x", "http:///p"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    best = None
    for action, text in urlfilter.PATH_RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (action, text)
    low = (url or "").translate({i: i + 32 for i in range(65, 91)})
    hits = {a for a, p, _ in urlfilter.PATTERN_RULES if url is not None and re.search(p, low)}
    method = "allow" if "allow" in hits or not hits else "block"
    return host, path, best and best[1], best[0] if best else method


def test_every_rule_by_brute_force(spark):
    rows = [(i, u, "h", "clash") for i, u in enumerate(URLS + URLS[:5])]
    d = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in d.collect()}
    assert [got[i] for i, _, _, _ in rows] == [plain(u) for _, u, _, _ in rows]
    assert d.columns.count("verdict") == 1 and "html" in d.columns


def test_tokens_stand_in_every_match():
    """A rule's literal tokens must be whole url tokens of whatever its pattern matches."""
    for _, pattern, tokens in urlfilter.PATTERN_RULES:
        for u in URLS:
            low = (u or "").lower()
            if u and re.search(pattern, low):
                assert set(tokens) <= set(re.findall("[a-z0-9]+", low)), (pattern, u)


def test_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_rule_is_fetched_where_the_match_goes_on_in_its_last_token(spark):
    urls = ["http://a.net/wp-login.php5"] + [f"http://b.net/wp/login/{i}" for i in range(9)] + ["http://a.net/x.php"]
    d = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert {r.page_id: r.verdict for r in d.collect()} == {i: plain(u)[3] for i, u in enumerate(urls)}
    assert plain(urls[0])[3] == "block"
