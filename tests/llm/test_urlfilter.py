import random

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import urlfilter

URLS = [None, "", "no scheme", "http://", "://x.net/", "HTTP://A.Example.NET/en/1", "https://example.net/en", "https://example.net/en/", "http://badexample.net/en/", "https://x.example.com/de/?q", "https://example.com?x=/de/", "http://a.org/fr/#t", "http://org/fr/", "http://net", "http://net/",
        "http://ads.example.org/x", "http://xads.example.org/x", "http://m.ads.example.org/", "http://ads.example.org", "http://Ä.NET/ä?", "ftp://u:p@h.net:80/a://b", "http://x.net/" + "long/" * 5000, "http://a.org/fr/1", "http://a.org/fr/1"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = 0
        while k < len(rest) and rest[k] not in "/?#":
            k += 1
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        while k < len(rest) and rest[k] not in "?#":
            path += rest[k]
            k += 1
    fits = lambda e: (host == e.split("/", 1)[0] or host.endswith("." + e.split("/", 1)[0])) and path.startswith("/" + e.split("/", 1)[1])
    rules = [(r, v) for r, v in urlfilter.BASE_RULES if fits(r)]
    if rules:
        return host, path, *max(rules, key=lambda r: len(r[0]))
    return host, path, None, "block" if any(map(fits, urlfilter.default_blocklist())) else "allow"


def test_verdicts(spark):
    rows = [(k if k % 5 else None, u) for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(map(tuple, urlfilter.filter_urls(pages).collect()), key=repr)
    assert got == sorted(((k, *plain(u)) for k, u in rows), key=repr)


def test_strings_of_one_digest_are_told_apart(tmp_path):
    digest = lambda b: len(b) % 3
    entries = [f"h{k}.net/{'x' * (k % 4)}" for k in range(40)]
    (tmp_path / "a").write_bytes(urlfilter.DigestArray.dump(entries, digest))
    array = urlfilter.DigestArray(str(tmp_path / "a"))
    rng = random.Random(0)
    asked = [rng.choice(entries + [f"h{k}.net/y" for k in range(50)]) for _ in range(300)]
    assert array.contains([a.encode() for a in asked], digest).tolist() == [a in entries for a in asked]
    assert (np.diff(array.keys.astype(np.int64)) >= 0).all()


def test_no_entries_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert urlfilter.filter_urls(pages, rules=[], blocklist=[]).first().verdict == "allow"
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


def test_entries_that_are_hosts_and_lists_of_many_paths(spark):
    """A list of a host without path and of 5,000 entries of 300 path lengths against a plain scan."""
    rng = random.Random(2)
    blocklist = ["bare.example", *(f"h{k}.test/{'p' * (k % 300)}" for k in range(5000))]
    urls = ["http://bare.example", "http://x.bare.example/any", "http://bare.example.org/", "http://notbare.example/", *(f"http://{rng.choice(['', 'm.'])}h{rng.randrange(6000)}.test/{'p' * rng.randrange(400)}" for _ in range(300))]
    entries = set(blocklist)
    want = []
    for u in urls:
        host, _, rest = u.split("://")[1].partition("/")
        path = "/" + rest if "/" in u.split("://")[1] else ""
        names = [host[k:] for k in range(len(host)) if k == 0 or host[k - 1] == "."]
        want.append("block" if any(n in entries or any(n + path[:j] in entries for j in range(1, len(path) + 1)) for n in names) else "allow")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, rules=[], blocklist=blocklist).collect()}
    assert [got[k] for k in range(len(urls))] == want and {"block", "allow"} == set(want)
