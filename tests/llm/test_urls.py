from ensemble.llm import urls
from ensemble.llm.queries import URL_RULES, URL_SQL
from conftest import SF_SMALL
from oracle_compare import compare, duck

ROWS = [(1, "https://WWW.Example.com/en/1"), (2, "http://a.example.com/en/?q"), (3, "http://b.net/es/x#f"), (4, "http://net/es/"),
        (5, "http://b.net"), (6, "http://b.net?/es/"), (7, None), (8, "no scheme/en/"), (9, "http://xcom/"), (10, "http://com/"),
        (11, "x://a.com://b/c"), (12, ""), (None, "http://a.com/" + "p" * 20000), (3, "http://b.net/es/x#f"), (13, "http://é.com/\n?x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, u, "h", "r", "v") for i, u in rows], "page_id long, url string, html string, rule string, verdict string")


def plain(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in rules:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(r)
    rule = max(fits, key=lambda r: (len(r), len(r.partition("/")[0])), default=None)
    return host, path, rule, rules[rule] if rule else otherwise


def test_rules_equal_brute_force(spark, monkeypatch):
    rules = URL_RULES | {f"h{i}.org/p{i}/": "block" for i in range(50)}
    rows = ROWS + [(20 + i, f"http://a.h{i}.org/p{i}/z") for i in range(0, 50, 7)]
    want = sorted((str(i), str(u), *map(str, plain(u, rules))) for i, u in rows)
    for shard in (32 << 20, 200):
        monkeypatch.setattr(urls, "SHARD_BYTES", shard)
        got = urls.filter_urls(frame(spark, rows), rules)
        assert sorted(tuple(map(str, r)) for r in got.collect()) == want


def test_listed_urls_default_and_empty(spark):
    listed = spark.createDataFrame([("http://b.net", 1), ("http://com/", 2), ("http://b.net", 3), (None, 4), ("http://b.net/es/x", 5)], "url string, page_id long")
    got = {r.page_id: r.verdict for r in urls.filter_urls(frame(spark), {"com/": "allow"}, listed, "allow").collect()}
    assert got[5] == "block" and got[10] == "allow" and got[6] == "allow" and got[3] == "allow" and got[7] == "allow"
    assert {r.verdict for r in urls.filter_urls(frame(spark), {}, listed.filter("false")).collect()} == {"allow"}
    assert urls.filter_urls(frame(spark, []), URL_RULES).collect() == []
    assert {r.verdict for r in urls.filter_urls(frame(spark), {}, otherwise="block").collect()} == {"block"}


def test_lists_in_shards_equal_sets(spark, monkeypatch):
    rows = ROWS + [(100 + i, f"http://x.org/{i % 300}") for i in range(900)] + [(i, "http://hot.org/") for i in range(2000, 2600)]
    listed = [(f"http://x.org/{i}",) for i in range(0, 600, 3)] + [("http://hot.org/",), ("",), (None,)]
    want = sorted((str(i), str(u), "block" if (u,) in listed and u is not None else "allow") for i, u in rows)
    for shard in (32 << 20, 500):  # the small bound also joins the found URLs by a shuffle
        monkeypatch.setattr(urls, "SHARD_BYTES", shard)
        got = urls.filter_urls(frame(spark, rows), {}, spark.createDataFrame(listed, "url string"))
        assert sorted((str(r.page_id), str(r.url), r.verdict) for r in got.collect()) == want


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s))
    a = urls.DigestArray(urls.map_into_memory(urls.DigestArray.pack({b"ab": 1, b"cd": 0, b"ef": 1})))
    assert a.probe([b"cd", b"ef", b"xy", b"abc"]).tolist() == [0, 1, -1, -1]


def test_query_equals_sql(spark):
    from ensemble.llm.queries import op7_url_filter
    ok, msg = compare(op7_url_filter(spark, SF_SMALL), duck(SF_SMALL), URL_SQL)
    assert ok, msg
