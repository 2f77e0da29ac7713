import random

from skylattice.llm import hosts
from tests.compare import SMALL, connect, rows

F = hosts.F


def test_query_equals_sql(spark):
    assert rows(hosts.query(spark, SMALL).toPandas()) == rows(connect().sql(hosts.ORACLE).df())


def parts(url):
    """Host and path, by hand."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[end:]
    cut = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:cut]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in hosts.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


ODD = [
    None, "", "no scheme.com/en/", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "https://a.example.com/EN/", "https://notexample.com/en/",
    "http://x.net/es/1", "http://net/fr/", "http://netx/fr/", "http://a.b.c.net/frx/", "http://com", "http://com/", "http://ÄÖ.com/ü", "http://a.com?x=/en/", "x://y://z/en/", "http://u@h.co.uk:80/p", "http://10.0.0.1/x",
    "http://a.com/line\nbreak?q", "://.net/es/", "http://" + "a." * 500 + "net/es/" + "b" * 5000, "http://www.example.com/en/", "http://q.www.example.com/en/x",
]


def test_odd_urls(spark):
    data = [(i if i % 7 else None, u, "h") for i, u in enumerate(ODD)] * 2
    pages = spark.createDataFrame(data, "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.judged(pages, none).collect()}
    want = {(i, *parts(u), rule(*parts(u))[0], rule(*parts(u))[1] or "allow") for i, u, _ in data}
    assert got == want
    assert hosts.judged(pages, none).count() == len(data)
    kept = hosts.kept(pages, none)
    assert kept.columns == pages.columns and kept.count() == 2 * sum((rule(*parts(u))[1] or "allow") == "allow" for u in ODD)


def test_domains(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "com": ("com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "y.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "10.0.0.1": ("10.0.0.1", "")}
    d = spark.createDataFrame([(h,) for h in cases], "h string").select("h", hosts.domain(F.col("h")), hosts.suffix(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in d} == cases


def planted(n_hosts=60):
    """Hosts of good and bad domains; a third of all pages on one host."""
    r = random.Random(4)
    pages, bad = [], []
    for i in range(6000):
        k = 0 if i % 3 == 0 else r.randrange(n_hosts)
        name = f"h{k}.{'spam' if k % 4 == 1 else 'fine'}{k % 8}.org"
        share = 0.9 if k % 4 == 1 else 0.05
        pages.append((i, f"http://{name}/{i}"))
        if i % 2:
            bad.append((i, int(r.random() < share)))
    pages += [(9000, "http://new.spam1.org/"), (9001, "http://new.fine0.org/"), (9002, "http://other.example/")]
    return pages, bad


def test_shrinks_and_blocks(spark):
    pages, bad = planted()
    p = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in hosts.judged(p, spark.createDataFrame(bad, "page_id long, bad int"), rules=()).collect()}
    for i, url in pages[:6000]:
        assert got[i]["verdict"] == ("block" if ".spam" in url else "allow"), url
    # a new host goes by its domain, and is less sure than a host that is known
    assert got[9000]["verdict"] == "block" and got[9001]["verdict"] == "allow" and got[9002]["verdict"] == "allow"
    known = max(r["bound"] for r in got.values() if "spam1.org" in r["host"] and r["host"] != "new.spam1.org")
    assert got[9000]["bound"] < known


def plain(hosts_, limit=0.5):
    """Bounds by the stated formulas: hosts_: host -> (domain, suffix, n, k)."""

    def level(groups, means):
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for (n, k), m in zip(groups, means, strict=True))
        room = sum(n * (n - 1) * m * (1 - m) for (n, _), m in zip(groups, means, strict=True))
        s = 10.0 if not room else (1000.0 if over <= 0 else min(1000.0, max(1.0, room / over - 1)))
        return [((k + s * m), (n - k + s * (1 - m))) for (n, k), m in zip(groups, means, strict=True)]

    def summed(i):
        out = {}
        for v in hosts_.values():
            n, k = out.get(v[i], (0, 0))
            out[v[i]] = n + v[2], k + v[3]
        return out

    n, k = sum(v[2] for v in hosts_.values()), sum(v[3] for v in hosts_.values())
    suf, dom = summed(1), summed(0)
    mean = lambda ab: ab[0] / (ab[0] + ab[1])
    top = dict(zip(suf, map(mean, level(list(suf.values()), [(k + 0.5) / (n + 1)] * len(suf))), strict=True))
    of = {v[0]: v[1] for v in hosts_.values()}
    mid = dict(zip(dom, map(mean, level(list(dom.values()), [top[of[d]] for d in dom])), strict=True))
    ab = level([v[2:] for v in hosts_.values()], [mid[v[0]] for v in hosts_.values()])
    return {h: a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 for h, (a, b) in zip(hosts_, ab, strict=True)}


def test_bounds_equal_plain_ones(spark):
    pages, bad = planted()
    known = dict(bad)
    by = {}
    for i, url in pages:
        h = parts(url)[0]
        n, k = by.get(h, (0, 0))
        by[h] = n + (i in known), k + known.get(i, 0)
    want = plain({h: (".".join(h.split(".")[-2:]), h.split(".")[-1], n, k) for h, (n, k) in by.items()})
    got = hosts.reputation(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad + bad, "page_id long, bad int")).collect()
    assert len(got) == len(want) and all(abs(r["bound"] - want[r["host"]]) < 1e-6 for r in got)


def test_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert [r["bad"] for r in hosts.labelled(labels).collect()] == [0, 1, 1, 0, 1]
    none = spark.createDataFrame([], "page_id long, url string, bound double")
    assert hosts.judged(none, hosts.labelled(labels)).count() == 0 and hosts.kept(none, hosts.labelled(labels)).count() == 0
