import numpy as np
import pytest

pytest.importorskip("tagveil.llm")
from tagveil.llm import quality


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    found = model.evidence([r.text.encode() for r in rows]) + model.base
    for i, t in enumerate(quality.TARGETS):
        y = np.array([r[t] for r in rows])
        assert np.mean((found[:, i] > 0) == y) > 0.97
        assert np.mean((found[:, i] > 0)[y == (t == "quality")] == (t == "quality")) > 0.85


def test_rates_shrink_towards_the_level_above(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 40}", "p", [float(rng.normal(4 if i % 40 < 20 else -4))] * 2) for i in range(4000)] + [("new", "p", [4.0, 4.0])]
    judged = spark.createDataFrame(rows, "site string, path string, _evidence array<double>")
    model = quality.Classifier([], np.zeros(9), np.ones(9), np.zeros((2, 10)), np.zeros(2))
    from pyspark.sql import functions as F

    got = {r._site: r for r in quality.group_rates(judged, model, F.col("site"), F.col("path")).collect()}
    p = 1 / (1 + np.exp(-np.array([r[2][0] for r in rows])))
    assert got["s0"].site_quality > 0.85 and got["s30"].site_quality < 0.15
    # one document of a new site moves it from the global rate by no more than its share
    assert abs(got["new"].site_quality - p.mean()) < (p[-1] - p.mean()) / (1 + quality.LEAST_WEIGHT) + 1e-6


def test_odd_rows(spark):
    good = [(i, f"word{i} and more of this calm text number {i % 7}", "s", "en", 1) for i in range(60)]
    bad = [(100 + i, "!!! $$$ BUY NOW %%% " * (i % 5 + 1), "s", None, 2) for i in range(60)]
    odd = [(None, "fine words here", None, None, 3), (7, None, "t", "en", 4), (8, "", None, "x", 5), (9, "x" * 400_000, "t", "en", 6), (9, "x" * 400_000, "t", "en", 6)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, source string, lang string, n int").withColumnRenamed("n", "keep")
    labels = spark.createDataFrame([(i, int(i < 100), 0, 1) for i in [*range(60), *range(100, 160)]] + [(1, None, 0, 1)], "doc_id long, quality int, toxic int, text int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 125 and all(0 < r.p_quality < 1 for r in rows)
    assert sum(r.keep for r in rows if r.doc_id is not None and 10 <= r.doc_id < 60) == 50
    assert not any(r.keep for r in rows if r.doc_id and r.doc_id >= 100)
    assert quality.kept(docs, labels).columns == docs.columns
    assert quality.judge(docs.where("false"), labels).count() == 0
    assert quality.judge(docs, labels.where("false")).count() == 125


def test_posteriors_by_brute_force(spark):
    """Moments, shrinkage and posteriors of every document by plain loops over the others."""
    rng = np.random.default_rng(4)
    sites = [(f"s{i % 7}" if i % 11 else None, f"p{i % 3}" if i % 5 else None) for i in range(400)] + [("lone", "p")]
    evidence = [[float(rng.normal(2 if a in ("s1", "s2") else -1, 2)), float(rng.normal(-2, 1.5))] for a, _ in sites]
    model = quality.Classifier([], np.zeros(9), np.ones(9), np.zeros((2, 10)), np.array([0.3, -1.0]))
    judged = spark.createDataFrame([(i, a, b, e) for i, ((a, b), e) in enumerate(zip(sites, evidence, strict=True))], "i int, site string, path string, _evidence array<double>")
    from pyspark.sql import functions as F

    site, path = F.col("site"), F.col("path")
    got = {r.i: r for r in quality.with_posteriors(judged, quality.group_rates(judged, model, site, path), model, site, path).collect()}
    for t, name in enumerate(quality.TARGETS):
        p = [1 / (1 + np.exp(-(e[t] + model.base[t]))) for e in evidence]
        rate = (sum(p) + 0.5) / (len(p) + 1)

        def moments(groups, above):
            n = {g: len(v) for g, v in groups.items()}
            mean = {g: sum(v) / len(v) for g, v in groups.items()}
            between = (sum(n[g] * (mean[g] - above[g]) ** 2 for g in groups) - sum(above[g] * (1 - above[g]) for g in groups)) / sum(n.values())
            inside = sum(n[g] * above[g] * (1 - above[g]) for g in groups) / sum(n.values())
            return quality.MOST_WEIGHT if between <= 0 else min(quality.MOST_WEIGHT, max(quality.LEAST_WEIGHT, inside / between))

        of_site, of_path = {}, {}
        for (a, b), x in zip(sites, p, strict=True):
            of_site.setdefault(a, []).append(x)
            of_path.setdefault((a, b), []).append(x)
        k_site = moments(of_site, dict.fromkeys(of_site, rate))
        site_rate = {a: (sum(v) + k_site * rate) / (len(v) + k_site) for a, v in of_site.items()}
        k_path = moments(of_path, {g: site_rate[g[0]] for g in of_path})
        for i, (a, b) in enumerate(sites):
            rest = [x for j, x in enumerate(p) if j != i]
            near = [x for j, x in enumerate(p) if j != i and sites[j][0] == a]
            same = [x for j, x in enumerate(p) if j != i and sites[j] == (a, b)]
            above = (sum(near) + k_site * (sum(rest) + 0.5) / (len(rest) + 1)) / (len(near) + k_site)
            prior = (sum(same) + k_path * above) / (len(same) + k_path)
            want = 1 / (1 + np.exp(-(evidence[i][t] + np.log(prior / (1 - prior)))))
            assert got[i][f"_p_{name}"] == pytest.approx(want, rel=1e-9)
            assert got[i][f"_site_{name}"] == pytest.approx(site_rate[a])
    assert all(r._keep == (r._p_quality >= 0.5 and r._p_toxic < 0.5) for r in got.values())


def test_whole_query_by_brute_force(spark):
    """The query's own evidence, its rates summed by hand over the whole table."""
    sf = "/root/testdata/sf0.001"
    from tagveil.llm import registry

    rows = {r.doc_id: r for r in registry.QUERIES["op10_empirical_bayes_quality"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    table = docs.collect()
    assert set(rows) == {r.doc_id for r in table}
    found = model.evidence([(r.text or "").encode() for r in table])
    for t, name in enumerate(quality.TARGETS):
        p = 1 / (1 + np.exp(-(found[:, t] + model.base[t])))
        rate = (p.sum() + 0.5) / (len(p) + 1)
        for r in table[:50]:
            near = np.array([x.source == r.source for x in table])
            got, mean = rows[r.doc_id][f"site_{name}"], p[near].mean()
            assert min(mean, rate) - 1e-9 <= got <= max(mean, rate) + 1e-9


def test_hosts_and_folders_of_urls(spark):
    docs = spark.createDataFrame([(1, "a", "http://A.x.org/en/p", "s"), (2, "b", None, "s")], "doc_id long, text string, url string, source string")
    site, path = quality.places(docs)
    assert [tuple(r) for r in docs.select(site, path).collect()] == [("a.x.org", "en"), ("", "")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 2 and quality.kept(docs, labels).columns == docs.columns


def test_repeated_labels_in_any_order(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(r.doc_id, 1 - r.quality, r.toxic) for r in rows[:9]] + [tuple(r) for r in rows[9:20]]
    one = spark.createDataFrame([tuple(r) for r in rows] + odd, "doc_id long, quality int, toxic int")
    two = spark.createDataFrame((odd + [tuple(r) for r in rows])[::-1], "doc_id long, quality int, toxic int")
    without = spark.createDataFrame([tuple(r) for r in rows[9:]], "doc_id long, quality int, toxic int")
    first, *others = (sorted(map(tuple, quality.judge(docs, labels).collect())) for labels in (one.coalesce(1), two.coalesce(1), without))
    for other in others:
        assert [r[0] for r in first] == [r[0] for r in other]
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for a, b in zip(first, other, strict=True) for x, y in zip(a, b, strict=True))
