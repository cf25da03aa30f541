import pytest

from quarryline.llm import url_filter
from quarryline.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        rest = rest[:end]
        cut = rest.find("/")
        host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "http://COM/x", "https://WWW.Example.com/en/a?b#c", "https://example.com/en", "https://example.com/en/", "https://a.example.com/en/x#y",
    "http://notexample.com/en/1", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/", "ftp://x.org/fr/", "http://user@h.com:80/p", "http://a.com?u=http://b.net/es/", "http://a.com#/en/", "http://É.com/É", "http://a..com/", "http://.com/", "http://com./", "x://y://z.net/es/",
]


def test_the_querys_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(0, None, "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}
    assert url_filter.judge_urls(pages, URL_RULES).count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_unfinished_segments_and_precedence():
    rules = [("block", "a.com", "/p"), ("allow", "a.com", "/pre"), ("block", "a.com", "/pre/x"), ("allow", "b.a.com", ""), ("block", "c.com", "/"), ("allow", "c.com", "/")]
    judge = url_filter.Trie(rules).judge
    for host in ("a.com", "b.a.com", "x.b.a.com", "c.com", "com"):
        for path in ("", "/", "/p", "/pr", "/pre", "/present", "/pre/", "/pre/xyz", "/pre/x/y", "/q"):
            want = brute(f"http://{host}{path}", rules)
            assert (judge(host, path) or (None, "allow")) == want[2:], (host, path)


def test_default_and_bad_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages, [], default="block").first().verdict == "block"
    with pytest.raises(ValueError, match="verdict"):
        url_filter.Trie([("maybe", "a", "/")])


def test_many_rules_on_one_node_and_very_long_urls():
    import time

    rules = [("block" if i % 2 else "allow", "a.com", f"/p{i}") for i in range(100_000)]
    judge = url_filter.Trie(rules).judge
    began = time.process_time()
    for i in range(0, 20_000, 7):
        assert judge("x.a.com", f"/p{i}/y") == (f"a.com/p{i}", "block" if i % 2 else "allow")
    assert judge("a.com", "/q") is None and judge("a.com", "/p99999999")[0] == "a.com/p99999"
    assert judge("a.com", "/p1" + "x/" * 500_000) == ("a.com/p1", "block")
    assert time.process_time() - began < 2


def test_one_trie_for_each_worker():
    class Shared:
        value = (("block", "a.com", "/"),)

    assert url_filter._trie("k", Shared) is url_filter._trie("k", Shared)
    assert url_filter._trie("other", Shared) is not url_filter._trie("k", Shared)


@pytest.mark.parametrize("seed", range(5))
def test_random_rules_against_brute_force(seed):
    import random

    draw = random.Random(seed)
    host = lambda: ".".join(draw.choice(["a", "b", "c", ""]) for _ in range(draw.randint(1, 3)))
    path = lambda: "".join(draw.choice(["/", "/", "p", "q"]) for _ in range(draw.randint(0, 6)))
    rules = [(draw.choice(["allow", "block"]), host(), path()) for _ in range(60)]
    judge = url_filter.Trie(rules).judge
    for _ in range(400):
        h, p = host(), path()
        p = p if not p or p.startswith("/") else "/" + p
        assert (judge(h, p) or (None, "allow")) == brute(f"http://{h}{p}", rules)[2:], (h, p)
