import random

import pytest

from millrace.llm import url_filter
from millrace.llm.url_filter import DOMAIN_RULES, PATTERN_RULES, DomainRule, PatternRule, check_rules, judge_urls, literal_tokens

COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def brute(url, domains, patterns):
    """Every rule tried on every URL."""
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in domains if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = min(fits, key=lambda r: (-len(r.host + r.path), r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    return host, path, None, next((r.verdict for r in patterns if re.search(r.pattern, lowered)), "allow")


def urls(n):
    rng = random.Random(5)
    parts = ["casino-win", "free-bets", "free-bet", "cheap-pills", "xxx-hot-video", "adult-videos", "wp-login.php", "de", "fr", "es", "en", "1", "video", "xxx", "a", "Ω", "CASINO-WIN"]
    hosts = ["example.org", "www.example.org", "A.example.ORG", "b.com", "com", "x.net", "notexample.org", "xxx-videos.net"]
    ends = ["", "/", "?utm_source=spam", "?a&replytocom=3", "#x", "?utm_source=spammer", ".html"]
    return [rng.choice(["http://", "https://", "://", ""]) + rng.choice(hosts) + "".join("/" + rng.choice(parts) for _ in range(rng.randrange(4))) + rng.choice(ends) for _ in range(n)]


def test_index_and_plain_rules_agree_on_generated_urls(spark, monkeypatch):
    own = urls(3000) + [None, "", "://", "http://", "no scheme", "http://example.org/es/" + "x" * 200_000]
    rows = [(i, u, "h", "p", "b", 7) for i, u in enumerate(own)] + [(None, own[0], "h", "p", "b", 7), (0, own[0], "h", "p", "b", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, base string, id int").repartition(5)
    want = sorted([(-1 if r[0] is None else r[0], *brute(r[1], DOMAIN_RULES, PATTERN_RULES)) for r in rows], key=str)
    for limit in (100_000, 2):  # in one pass, and in passes of two rules
        monkeypatch.setattr(url_filter, "RULES_A_PASS", limit)
        out = judge_urls(df)
        assert out.columns == COLUMNS
        assert sorted([(-1 if r.page_id is None else r.page_id, *r[1:]) for r in out.collect()], key=str) == want
    assert judge_urls(df.limit(0)).count() == 0


def test_many_rules_and_ties(spark):
    domains = tuple(DomainRule("block" if i % 2 else "allow", f"h{i}.org", "/") for i in range(12_000)) + (DomainRule("block", "a.b", "/x/"), DomainRule("allow", "b", "/x/yz"))
    patterns = tuple(PatternRule("block", f"/k{i}/", (f"k{i}",)) for i in range(12_000))
    own = [f"http://www.h{i}.org/" for i in range(0, 12_000, 500)] + [f"http://z.z/k{i}/" for i in range(0, 12_000, 500)] + ["http://a.b/x/yz"]
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(spark.createDataFrame(list(enumerate(own)), "page_id long, url string"), domains, patterns).collect()}
    assert [got[i] for i in range(len(own))] == [brute(u, domains, patterns) for u in own]
    none = judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), (), ()).collect()
    assert [tuple(r) for r in none] == [(1, "a.b", "/", None, "allow")]


def test_tokens_come_from_the_parsed_pattern():
    assert literal_tokens(r"[/.]free-bets?[./]") == ({"free"}, [])
    assert literal_tokens(r"[/.](?:xxx|adult)-[a-z0-9-]*videos?[./]") == (set(), [{"xxx", "adult"}])
    assert literal_tokens(r"/wp-login\.php(?:[?#]|$)") == ({"wp", "login", "php"}, [])
    assert literal_tokens(r"spam") == (set(), []) and literal_tokens(r"^spam/(?:a|b[c-d])x/") == ({"spam"}, [])
    check_rules(PATTERN_RULES)
    for bad in (PatternRule("block", r"/videos?/", ("videos",)), PatternRule("block", r"/(?:a|b)/", either=("a",)), PatternRule("block", "/x/")):
        with pytest.raises(ValueError, match="bound to occur"):
            check_rules((bad,))
