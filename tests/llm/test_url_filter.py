import random

import pytest

from tracekit.llm import url_filter as U


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        path = path[:min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h.count("."), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


ODD = [None, "", "x", "://", "http://", "http://NET", "http://net/", "http://a.Net/x?y#z", "http://.net/", "http://net./", "http://xnet/",
       "http://example.net/en", "https://m.example.net/en/1", "http://a?b://c", "http://example.com/de/", "http://a.b.c.org/fr/\u00e9\uffff",
       "ftp://org/fr/#", "http://org?/fr/", "http://a.example.com:80/de/", "http://" + "a." * 3000 + "net/" + "p" * 50_000, "http://net\U0010ffff/"]


@pytest.mark.parametrize("rules", [U.RULES, [], [("a.b", "", "block"), ("b", "/x", "allow"), ("b", "/xy", "block"), ("b", "", "allow"), ("a.b", "/xyz", "allow"),
                                                 ("b", "/xy", "allow"), ("c.a.b", "/\u00e9", "block")]])
def test_equals_brute_force(lspark, rules):
    rng = random.Random(7)
    urls = ODD + ["http://" + ".".join(rng.choices(["a", "b", "c", "net", "org"], k=rng.randint(1, 4))) + "/" + "".join(rng.choices("xyz\u00e9/", k=rng.randint(0, 5)))
                  for _ in range(300)]
    rows = [(i if i % 9 else None, u, "clash") for i, u in enumerate(urls)] + [(1, urls[10], "clash")] * 40
    pages = lspark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, U.judge_urls(pages, U.rule_table(lspark, rules)).collect()), key=repr)
    # two rules of one host and path: the larger action counts
    assert got == sorted(((i, *plain(u, rules)) for i, u, _ in rows), key=repr)


def test_empty_table(lspark):
    pages = lspark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(pages, U.rule_table(lspark, U.RULES)).collect() == []


def test_main_path_has_no_python(lspark):
    plan = U.op5_url_filter(lspark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
