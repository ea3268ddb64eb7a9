import duckdb

from bytequarry.llm.reputation import OP6_SQL, RULES, host_reputation, judge_urls


def pages():
    out = [(i, f"http://{h}.example.{s}/{p}/{i}") for i, (h, s, p) in enumerate((h, s, p) for h in ("a", "b", "WWW", "c.d") for s in ("org", "net", "com", "co.uk") for p in ("en", "es", "x") for _ in range(4))]
    odd = [None, "", "no scheme", "://", "http://", "http://com", "http://com/", "https://Example.COM/en/1?x=://y", "http://example.com:80/en/", "http://xexample.com/en/", "ftp://www.example.com/en/#f", "http://net/es/", "http://é.NET/fr/x", "a://b/c/d?e#f/g", "http://h#/en/", "http://1.2.3.4/en/", "http://9.9.3.4:81/x", "http://[::1]:8/x", "http://1.2.3/y"]
    return out + [(500 + i, u) for i, u in enumerate(odd)] + [(None, "http://a.example.org/1"), (3, "http://a.example.org/en/3")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [h + p for _, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_sql(spark):
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(0, 180, 2)] + [(4, 1, 1), (6, None, None), (8, None, 0), (None, 0, 1)]
    p = spark.createDataFrame([(i, u, "x") for i, u in pages()], "page_id long, url string, host string")
    got = judge_urls(p, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.page_id or -1, r.host, r.path, r.rule or "") for r in got) == sorted((i or -1, *(x or "" for x in brute(u))) for i, u in pages())
    verdicts = {h + q: v for v, h, q in RULES}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule) and {r.verdict for r in got if not r.rule} <= {"allow", "block"}
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar, html varchar); create table labels(doc_id bigint, quality int, toxic int)")
    db.executemany("insert into pages values (?, ?, '')", pages())
    db.executemany("insert into labels values (?, ?, ?)", labels)
    want = db.sql(OP6_SQL).fetchall()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), labels).collect() == []
    assert [tuple(r) for r in judge_urls(spark.createDataFrame([(1, None)], "page_id long, url string"), labels).collect()] == [(1, "", "", None, "allow")]


def test_addresses_and_suffixes_are_their_own(spark):
    hosts = [("a.b.co.uk", 1), ("1.2.3.4:80", 0), ("9.9.3.4", 1), ("[::1]:8", 1), ("x.y.zz", 0)]
    df = spark.createDataFrame(hosts, "host string, bad int")
    of = lambda rows: {r.host: (r.domain, r.suffix) for r in rows.collect()}
    got = of(host_reputation(df))
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4"), "9.9.3.4": ("9.9.3.4", "9.9.3.4"), "[::1]:8": ("[::1]", "[::1]"), "x.y.zz": ("y.zz", "zz")}
    assert of(host_reputation(df, ["y.zz"]))["x.y.zz"] == ("x.y.zz", "y.zz")


def test_posterior_by_hand(spark):
    """Shares shrink from suffix to domain to host; computed once more in plain Python."""
    counts = {"a.x.org": (20, 9), "b.x.org": (4, 0), "c.y.org": (10, 1), "d.z.net": (30, 25), "e.z.net": (6, 1)}
    rows = [(h, int(i < k)) for h, (n, k) in counts.items() for i in range(n)]

    def strength(level):
        extra = sum((k - n * m) ** 2 / (m * (1 - m)) for n, k, m in level) - sum(n for n, _, _ in level)
        rho = extra / sum(n * (n - 1) for n, _, _ in level)
        return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0

    def added(keys):
        out = {}
        for h, (n, k) in counts.items():
            a, b = out.get(keys(h), (0, 0))
            out[keys(h)] = a + n, b + k
        return out

    mean = {"": (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 5)}
    for keys, up in ((lambda h: h.rsplit(".", 1)[1], lambda x: ""), (lambda h: h.split(".", 1)[1], lambda x: x.rsplit(".", 1)[1]), (lambda h: h, lambda x: x.split(".", 1)[1])):
        level = added(keys)
        s = strength([(n, k, mean[up(x)]) for x, (n, k) in level.items()])
        mean |= {x: (k + s * mean[up(x)]) / (n + s) for x, (n, k) in level.items()}
    for r in host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect():
        m, size = mean[r.host], counts[r.host][0] + s
        assert abs(r["mean"] - m) < 1e-9 and abs(r.bound - (m - 1.645 * (m * (1 - m) / (size + 1)) ** 0.5)) < 1e-9
