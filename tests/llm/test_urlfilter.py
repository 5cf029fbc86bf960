import random

import pytest

from lightbox.llm import urlfilter


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def listed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def brute(url, keys):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max((h + p for h, p, _ in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=len, default=None)
    verdict = dict((h + p, v) for h, p, v in urlfilter.RULES).get(best)
    if verdict is None:
        bare = host.split("@")[-1].rstrip("0123456789") if ":" in host else host.split("@")[-1]
        bare = bare.rstrip(":").removesuffix(".")
        labels = bare.split(".")
        clean = path.strip("/").removesuffix(".html")
        probes = {f"{bare}/{clean}"} | {".".join(labels[i:]) + "/" for i in range(len(labels))} if host else set()
        verdict = "block" if probes & set(keys) else "allow"
    return host, path, best, verdict


def test_judgements(spark):
    keys = ["bad.example.org/", "shop.example.org/one/two", "lonely/"]
    urls = [
        None, "", "no scheme", "http://", "https://A.Bad.example.org/x", "https://bad.example.org", "https://notbad.example.org/", "http://shop.example.org/one/two/?q=1#f", "http://shop.example.org/one/two/three",
        "http://x.net", "http://x.net/", "http://x.net?y", "https://www.example.net/en/a", "https://www.example.net/en", "https://example.com/de/", "https://example.com/deutsch", "http://a.org/fr/1", "http://org/fr/",
        "http://u:p@bad.example.org:8080/", "http://bad.example.org./", "ftp://lonely/a.html", "x://y://z/w", "http://É.example.org/ü?#", "http://shop.example.org/one/two.html",
    ]
    urls += urls[4:6]
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages(spark, urls), listed(spark, keys)).orderBy("page_id").collect()]
    assert got == [brute(u, keys) for u in urls]


def test_large_lists_have_no_false_positives(spark):
    r = random.Random(5)
    keys = [f"h{k}.example.org/" for k in range(3000)]
    urls = [f"http://www.h{r.randrange(6000)}.example.org/{k}" for k in range(2000)]
    got = {(r["page_id"], r["verdict"]) for r in urlfilter.judge(pages(spark, urls), listed(spark, keys)).collect()}
    assert got == {(i, brute(u, keys)[3]) for i, u in enumerate(urls)}


def test_the_filter_passes_all_listed_and_few_others(spark):
    keys = listed(spark, [f"k{i}/" for i in range(4000)])
    blocks, n = urlfilter.build_filter(keys, 4000)
    assert n & (n - 1) == 0

    def passing(df):
        probes = df.withColumn("block", urlfilter._block(df["key"], n)).join(blocks, "block")
        for k, m in enumerate(urlfilter._bits(probes["key"])):
            probes = probes.where(probes[f"w{k}"].bitwiseAND(m) != 0)
        return probes.count()

    assert passing(keys) == 4000 and passing(listed(spark, [f"other{i}/" for i in range(4000)])) < 100


@pytest.mark.parametrize("limit", [0, 1 << 18])
def test_wide_filters_are_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", limit)
    rows = urlfilter.judge(pages(spark, ["http://a.spam-farm.example.org/x", "http://b.example.org/"]), listed(spark, urlfilter.listed_urls())).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block", "allow"]


def test_empty(spark):
    assert urlfilter.judge(pages(spark, []), listed(spark, ["a/"])).count() == 0
    assert [r["verdict"] for r in urlfilter.judge(pages(spark, ["http://a.b/"]), listed(spark, [])).collect()] == ["allow"]
