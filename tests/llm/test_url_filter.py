from collections import defaultdict

import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import url_filter as uf


def plain_place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)]
    host, path = rest[: ends[0]], rest[ends[0] :]
    ends = [i for i, c in enumerate(path) if c in "?#"] or [len(path)]
    return "".join(c.lower() if c < "\x80" else c for c in host), path[: ends[0]]


def plain_rule(host, path, rules=uf.RULES):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_mass(edges, seeds, rounds=200):
    total = sum(seeds.values())
    if not total:
        return {}
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    start = {h: m / total for h, m in seeds.items()}
    now = dict(start)
    for _ in range(rounds):
        new = defaultdict(float, {h: 0.15 * m for h, m in start.items()})
        lost = sum(m for h, m in now.items() if h not in out)
        for h, m in start.items():
            new[h] += 0.85 * lost * m
        for (a, b), w in edges.items():
            new[b] += 0.85 * now.get(a, 0) * w / out[a]
        now = dict(new)
    return now


def test_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/En/x?y#z", "x://h", "x://h?q/p", "x://h#f", "x://É.org/fr/", "a://b://c/d", "://", "x://\nh/p\nq?"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = frame.select("i", uf.host_of(frame.url), uf.path_of(frame.url)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: plain_place(u) for i, u in enumerate(urls)}


def test_whole_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = uf.judge(pages, uf.rules_frame(spark)).collect()
    url = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(url)
    for r in rows:
        assert (r.host, r.path) == plain_place(url[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and (rule is None or r.verdict == verdict)
        assert rule is not None or r.verdict == ("block" if r.distrust > r.trust else "allow")


def test_mass_equals_power_iteration(spark):
    links = {("good.org", "a.com"): 2, ("a.com", "b.com"): 1, ("b.com", "bad.net"): 3, ("bad.net", "c.com"): 1, ("c.com", "a.com"): 1, ("d.com", "bad.net"): 1, ("sub.d.com", "d.com"): 1, ("d.com", "sub.d.com"): 1}
    html = defaultdict(str)
    for (a, b), n in links.items():
        if "sub.d.com" not in (a, b):
            html[a] += f"<A HREF='//{b.upper()}/x'>" * n
    pages = [(i, f"http://{h}/{'fr/' if h == 'good.org' else ''}p", html[h]) for i, h in enumerate({h for e in links for h in e})]
    frame = spark.createDataFrame([*pages, (90, None, None), (91, "zzz", "<a href=http://a.com>"), (92, "http://lone.com", None)], "page_id long, url string, html string")
    rows = {r.host: r for r in uf.judge(frame, uf.rules_frame(spark)).collect()}
    trust = plain_mass(links, {"good.org": 1})
    distrust = plain_mass({(b, a): w for (a, b), w in links.items()}, {"bad.net": 1})
    for h, r in rows.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=1e-4) and r.distrust == pytest.approx(distrust.get(h, 0), abs=1e-4)
    assert rows["d.com"].verdict == rows["sub.d.com"].verdict == "block" and rows["a.com"].verdict == "allow"
    assert rows[""].verdict == rows["lone.com"].verdict == "allow"


def test_odd_tables(spark):
    frame = spark.createDataFrame([(1, "http://x.net/", "<a href='//y.com'>", "r")] * 3, "page_id long, url string, html string, rule string")
    assert [r.verdict for r in uf.judge(frame, uf.rules_frame(spark)).collect()] == ["block"] * 3
    assert uf.judge(frame.where("false"), uf.rules_frame(spark)).count() == 0


def test_long_chains_and_cycles_settle(spark):
    """A cycle of two hosts that feeds a chain of 90, followed to its last host."""
    names = [f"h{i}.com" for i in range(90)]
    links = {("good.org", "a.com"): 1, ("a.com", "b.com"): 1, ("b.com", "a.com"): 2, ("b.com", names[0]): 1, **{e: 1 for e in zip(names, names[1:])}}
    back = {("bad.net", "x.com"): 1, ("x.com", "y.com"): 1, ("y.com", "x.com"): 1, ("y.com", "z.com"): 3}
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in links.items()] + [(b, a, float(w)) for (a, b), w in back.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("good.org", "trust", 1.0), ("bad.net", "distrust", 1.0)], "host string, kind string, mass double")
    got = {(r.host, r.kind): r.mass for r in uf.propagate(edges, seeds).collect()}
    for kind, graph, seed in (("trust", links, "good.org"), ("distrust", back, "bad.net")):
        want = plain_mass(graph, {seed: 1}, rounds=1000)
        assert {h for h, k in got if k == kind} == set(want)
        for h, m in want.items():
            assert got[h, kind] == pytest.approx(m, abs=1e-4)
    assert got[names[-1], "trust"] > 0


def plain_graph(hosts):
    """Edges between each host and the domains above it, by splitting names."""
    edges = {}
    for host in hosts:
        labels = host.split(".")
        for i in range(len(labels) - 2):
            a, b = ".".join(labels[i:]), ".".join(labels[i + 1 :])
            edges[a, b] = edges[b, a] = 1
    return edges


def test_whole_table_by_power_iteration(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = uf.judge(pages, uf.rules_frame(spark)).collect()
    edges = plain_graph({r.host for r in rows if r.host})
    assert len(edges) > 100
    for kind, verdict, graph in (("trust", "allow", edges), ("distrust", "block", {(b, a): w for (a, b), w in edges.items()})):
        seeds = defaultdict(float)
        for r in rows:
            if r.rule and r.verdict == verdict and r.host:
                seeds[r.host] += 1
        mass = plain_mass(graph, seeds, 400)
        assert all(r[kind] == pytest.approx(mass.get(r.host, 0), abs=1e-4) for r in rows)


def test_siblings_and_bases_reach_hosts_without_a_seed(spark):
    pages = [(1, "http://a.good.org/fr/x", None), (2, "http://b.good.org/x", None), (3, "http://bad.net/", None), (4, "http://c.com/", "<base href='//bad.net/d/'><a href='x'><img src=/y>"), (5, "http://1.2.3.4/", "<a href='/x'>"), (6, "http://d.com/", "<a href='HTTP://C.com:80x'><a href=mailto:z>")]
    rows = {r.page_id: r for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), uf.rules_frame(spark)).collect()}
    assert (rows[2].verdict, rows[2].found_by) == ("allow", "links") and rows[2].trust > 0
    assert (rows[4].verdict, rows[4].found_by) == ("block", "links")
    assert (rows[5].verdict, rows[5].found_by) == ("allow", "none") and rows[1].found_by == "rule"


def test_very_long_html(spark):
    html = "<p>" * 700_000 + "<a href='//bad.net/'>"
    rows = uf.judge(spark.createDataFrame([(1, "http://x.com/", html), (2, "http://bad.net/", "")], "page_id long, url string, html string"), uf.rules_frame(spark)).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "block"}
