"""URL filter against a plain loop over the rules."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from provider_analytics.llm import url_filter
from provider_analytics.llm.queries import URL_RULES


def plain(url, rules, otherwise="allow"):
    if url is None or "://" not in url:
        return "", "", None, otherwise
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    for c in "?#":
        path = path.split(c)[0]
    fits = []
    for rule, verdict in rules:
        rule_host, slash, tail = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + tail):
            fits.append((len(rule), len(rule_host), rule, verdict))
    _, _, rule, verdict = max(fits, default=(0, 0, None, otherwise))
    return host, path, rule, verdict


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule int")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}


URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x", "https://www.example.com/en/x?y#z", "https://a.www.example.com/en/",
        "https://example.com", "https://example.com?/en/", "https://x.net/es/1", "https://net/fr/", "https://notexample.com/en/",
        "a://b://c.com/", "https://é.com/ÉÀ#", "https://x.net:80/es/", "https://" + "a." * 3000 + "com/" + "p" * 5000, "https://.com/", "https://com/"]


@pytest.mark.parametrize("rules", [URL_RULES, (), (("example.com", "block"), ("com/en/x", "allow")), (("com/", "block"), ("com/", "allow"))])
def test_edges(spark, rules):
    found = judged(spark, URLS, rules)
    first = dict(reversed(rules))
    assert found == {i: plain(u, [(r, v) for r, v in first.items()]) for i, u in enumerate(URLS)}


def test_random_with_colliding_digests(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    hosts = [".".join(rnd.choices("abc", k=rnd.randint(1, 3))) for _ in range(30)]
    paths = ["/" + "/".join(rnd.choices("xy", k=rnd.randint(0, 3))) for _ in range(30)]
    rules = list({rnd.choice(hosts) + rnd.choice(paths): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [(rnd.choice(hosts), rnd.choice(paths)) for _ in range(300)]
    wanted = [plain(f"s://{h}{p}", rules) for h, p in urls]
    for digest in (xxhash.xxh64_intdigest, lambda b: len(b) % 3):
        monkeypatch.setattr(xxhash, "xxh64_intdigest", digest)
        path = str(tmp_path / f"rules{id(digest)}")
        url_filter.write_digest_file(rules, path)
        found = url_filter.DigestArray(path).judge([h.encode() for h, _ in urls], [p.encode() for _, p in urls])
        assert [(None, "allow") if x is None else (x[0].decode(), "block" if x[1] else "allow") for x in found] == [w[2:] for w in wanted]


def test_empty_table_and_bad_verdict(spark, tmp_path):
    assert judged(spark, [], URL_RULES) == {}
    with pytest.raises(ValueError):
        url_filter.write_digest_file([("com/", "maybe")], str(tmp_path / "x"))


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "https://net/es/")] * 3, "page_id bigint, url string")
    assert url_filter.judge_urls(df, URL_RULES).filter(F.col("verdict") == "block").count() == 3
