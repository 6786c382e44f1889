from millrace.llm.url_filter import judge_urls
import re

import duckdb

from millrace.llm.queries_op7 import SQL, op7_url_filter
from millrace.llm.url_filter import PATTERN_RULES

#: URLs that the pattern rules match, by the number of the rule; no domain rule fits them.
PLANTED = {
    0: ["http://a.net/casino-win/", "http://casino.casino-win.net/x"],
    1: ["http://a.net/free-bet/", "http://a.net/free-bets.html"],
    2: ["http://a.net/cheap-pill/", "http://a.net/Cheap-Pills.html"],
    3: ["http://a.net/adult-video/", "http://a.net/xxx-hot-video.", "http://a.net/xxx-hotvideos/", "http://xxx-videos.net/", "http://a.net/ADULT-a-b9video/", "http://a.net/xxx-adult-videos/adult/"],
    4: ["http://a.net/?utm_source=spam", "http://a.net/?a=b&utm_source=spam#x"],
    5: ["http://a.net/wp-login.php", "http://a.net/b/wp-login.php?x"],
    6: ["http://a.net/?replytocom=1", "http://a.net/?a&replytocom=77"],
}
CLEAN = ["http://a.net/adult/video/", "http://a.net/notxxx-video/", "http://a.net/videos/", "http://a.net/adultvideo/", "http://a.net/free-better/", "xxx-video", "", None]


def test_every_rule_is_fetched_for_its_urls(spark, tmp_path):
    assert sorted(PLANTED) == list(range(len(PATTERN_RULES)))
    urls = [u for own in PLANTED.values() for u in own] + CLEAN
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in op7_url_filter(spark, str(tmp_path)).collect()}
    every = [next((r.verdict for r in PATTERN_RULES if re.search(r.pattern, (u or "").lower())), "allow") for u in urls]
    assert all(re.search(PATTERN_RULES[k].pattern, u.lower()) for k, own in PLANTED.items() for u in own)
    assert [got[i] for i in range(len(urls))] == every
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    at = db.execute(SQL["op7_url_filter"])
    columns = [d[0] for d in at.description]
    told = {row[columns.index("page_id")]: row[columns.index("verdict")] for row in at.fetchall()}
    assert {i: told[i] for i, u in enumerate(urls) if u is not None} == {i: got[i] for i, u in enumerate(urls) if u is not None}


def test_tokens_are_required():
    for k, own in PLANTED.items():
        for url in own:
            tokens = set(re.findall("[a-z0-9]+", url.lower()))
            assert set(PATTERN_RULES[k].tokens) <= tokens and (not PATTERN_RULES[k].either or tokens & set(PATTERN_RULES[k].either))


def test_the_end_of_a_url_is_its_end(spark):
    urls = ["http://a.net/wp-login.php", "http://a.net/wp-login.php\n", "http://a.net/wp-login.php?x", "http://a.net/?utm_source=spam\n", "http://a.net/?utm_source=spam"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(df).collect()} == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "block"}
