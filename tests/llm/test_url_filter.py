"""URL rules against a loop over all rules; cascades against sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from codequarry.llm import url_filter as U
from codequarry.llm.queries import URL_RULES

PAGES = "page_id long, url string, host int, keys string, verdict string"


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, 1, "k", "v") for i, u in enumerate(urls)], PAGES)
    return {r.id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, rules).collect()}


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "x://example.com/en/a?b",
        "x://www.Example.com/en/", "x://example.com/en", "x://b.net/es/", "x://b.net/es", "x://net/fr/?q", "x://net?/fr/",
        "x://notexample.com/en/", "x://É.com/en/", "a://b://c.com/", "x://www.example.com#/en/", "x://h\n.com/",
        "x://" + "a." * 3000 + "com/", "x://u@example.com:80/en/", "x://example.com/en/" + "p" * 100_000, "x://net/es/"]


def test_given_rules(spark):
    assert run(spark, URLS, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


def test_random_rules(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "aa"]
    host = lambda: ".".join(rng.choices(names, k=rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choices(["x/", "y/", "x"], k=rng.randrange(0, 3)))
    rules = list({r.key: r for r in (U.Rule(host(), path(), rng.choice(["allow", "block"])) for _ in range(40))}.values())
    urls = [f"http://{host()}{path()}" for _ in range(400)]
    got, want = run(spark, urls, rules), {i: brute(u, rules) for i, u in enumerate(urls)}
    assert {k: (v[0], v[1], v[2] and len(v[2])) for k, v in got.items()} == \
        {k: (v[0], v[1], v[2] and len(v[2])) for k, v in want.items()}


def test_no_rules_and_no_pages(spark):
    assert run(spark, ["x://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
    assert run(spark, [], URL_RULES) == {}


def test_cascade_is_exact(spark):
    keys = spark.range(30_000).select(F.xxhash64("id").alias("h"), "id")
    levels = U.cascade(keys.where("id % 100 = 0"), keys)
    h = np.array([r.h for r in keys.orderBy("id").collect()]).view(np.uint64)
    assert (U.member(levels, h) == (np.arange(30_000) % 100 == 0)).all()
    assert sum(len(x.bits) for x in levels) < 400  # in proportion to the list
