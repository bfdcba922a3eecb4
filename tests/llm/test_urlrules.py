from logquarry.llm import urlrules
from logquarry.llm.urlrules import RULES, Index, Rule, judged, path_rule

URLS = [None, "", "no scheme", "https://Example.COM/en/70?x", "http://a.b.example.com/en/8", "ftp://com/en/", "http://xcom/en/", "https://x.net/de/1#a", "https://example.net/de/8", "https://example.net/de/88?q=://", "http://q.org/es/1", "http://q.org/ES/1", "http://org", "a://b://c", "http://example.com", "https://example.com/en/7", "https://example.com/en/7"]


def plain(url):
    """The contract, rule by rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for action, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", 7) for i, u in enumerate(URLS)], "page_id long, url string, rule string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}
    joined = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, task_rules=0).collect()}
    assert joined == got
    assert judged(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    rows = spark.createDataFrame([("example.com/en/7",), ("other.com/en/",), ("other.com/de/",)], "_subject string")
    assert urlrules.rarest_tokens(rows, [path_rule("block", "example.com", "/en/")]) == ["example"]
    assert urlrules.rarest_tokens(rows, RULES)[:2] == ["en", "example"]


def test_only_fetched_rules_run():
    rules = [Rule("block", "casino", r"casino", ("casino",)), Rule("block", "any", r"^$", ())]
    index = Index(rules, ["casino", None])
    assert index.judge("casino.com/") == ("casino", "block")
    assert index.judge("mycasinos.com/") == (None, None)  # the token is not among the url's
    assert index.judge("") == ("any", "block")
