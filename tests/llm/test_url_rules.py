"""URL rules against every rule tried on every url."""

import random

import pytest

from cueflow.llm import url_rules as U


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute(url, rules, default="allow"):
    host, path = parse(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (host or path)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def random_case(seed):
    rng = random.Random(seed)
    labels, parts = ["a", "b", "ab", "com", "org", "x-y"], ["", "/", "/a", "/a/", "/ab", "/b/c", "/é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    rules = list({(host(3), rng.choice(parts)): None for _ in range(25)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{host(5)}{rng.choice(parts)}{rng.choice(['', 'q', '?u=/a', '#a', '/z'])}"
            for _ in range(300)]
    return urls + [None, "", "nothing", "x://", "HTTP://A.COM/a", "http://com", "://org?x"], rules


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 5), (3, 40)])
def test_against_all_rules(spark, seed, ranges):
    urls, rules = random_case(seed)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    parsed = U.with_host_and_path(pages)
    got = {(r.host, r.path): (r.rule, r.verdict)
           for r in U.match_rules(parsed, table, ranges).collect()}
    for row in parsed.collect():
        host, path, rule, verdict = brute(row.url, rules, None)
        assert (row.host, row.path) == (host, path)
        assert got.get((host, path), (None, None)) == (rule, verdict)


def test_judged_rows(spark):
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("bad.org", "/", "block"), ("bad.org", "/", "allow"),
         (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(
        [(1, "http://x.bad.org/q", "k"), (1, "http://x.bad.org/q", "k"), (None, None, "k"),
         (3, "http://org", "k"), (4, "http://A.org/?", "k")],
        "page_id long, url string, verdict string")
    rows = U.judge_urls(pages, rules, default="block").collect()
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in rows)
    assert got == [(0, "", "", None, "block"), (1, "x.bad.org", "/q", "bad.org/", "block"),
                   (1, "x.bad.org", "/q", "bad.org/", "block"), (3, "org", "", None, "block"),
                   (4, "a.org", "/", "org/", "allow")]
    assert U.judge_urls(pages.limit(0), rules).count() == 0
    assert U.judge_urls(pages, rules.limit(0)).count() == 5
