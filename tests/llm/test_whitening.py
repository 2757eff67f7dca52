from decimal import Decimal

import numpy as np
import pytest

from tagveil.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, _x string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, None) for k, v in vectors], SCHEMA)


def test_whole_table_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = rows.collect()
    x = np.array([[int(np.floor(64.0 * float(c))) + 1_000_000 for c in r.embedding] for r in table], object)
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(v) for v in row] for row in n * fit - sums]) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {}
    for r in W.whiten(rows).collect():
        got[r.vec_id, r.component] = r
    assert len(got) == 16 * len(table) and {r.n for r in got.values()} == {n}
    assert max(r.identity_error for r in got.values()) < 1e-9
    own = np.array([[float(v) for v in row] for row in n * x - sums]) / n
    for c in range(1, 17):
        ours = np.array([got[r.vec_id, c].whitened for r in table])
        theirs = own @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-6
        assert got[table[0].vec_id, c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    for r, row in zip(table, x, strict=True):
        assert got[r.vec_id, 1].deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    fine = [(k, [float(v) for v in rng.normal(size=5) * 3]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5), (105, [float("-inf"), 1.0, 1.0, 1.0, 1.0])]
    copies = [(None, fine[0][1])] * 30 + [(7, fine[1][1])] * 3
    short = [(200, [1.0, 2.0]), (201, [1.0, 2.0]), (202, [2.0, 5.0])]
    got = W.whiten(frame(spark, fine + odd + copies + short)).collect()
    assert len(got) == 5 * (40 + 33) + 2 * 3
    long_ = [r for r in got if r.vec_id is None or r.vec_id < 100]
    assert {r.n for r in long_} == {40} and {r.n for r in got if (r.vec_id or 0) >= 200} == {2}
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert {r.component for r in long_} == {1, 2, 3, 4, 5} and all(r.whitened == first[r.component] for r in got if r.vec_id is None)
    # two distinct short vectors lie on a line
    assert {r.component: r.whitened is None for r in got if r.vec_id == 200} == {1: False, 2: True}
    assert sum(r.explained for r in got if r.vec_id == 202) == pytest.approx(1.0)


def test_one_vector_and_none(spark):
    got = W.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in got} == {(1, 0, None, None)}
    assert W.whiten(frame(spark, [])).collect() == [] and W.whiten(frame(spark, [(1, None)])).collect() == []


def test_entries_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in W.whiten(rows).collect()}
    assert got[1, 1].deviation is None and got[1, 1].n == 3 and got[1, 1].whitened == pytest.approx(-got[2, 1].whitened)


def test_merging_is_exact_enough_and_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(999_900, 1_000_100, (1000, 7))
    parts = np.array_split(x, [1, 2, 300, 301, 999])
    own = [W.moments(p.astype(float)) for p in parts]
    for order in (range(len(own)), reversed(range(len(own)))):
        out = None
        for k in order:
            out = own[k] if out is None else W.merged(out, own[k])
        centred = x - x.mean(0)
        assert out[0] == 1000 and np.allclose(out[1], x.mean(0), rtol=0, atol=1e-8) and np.allclose(out[2], centred.T @ centred, rtol=1e-12, atol=1e-5)
    assert W.exact_sums(x) == [int(Decimal(int(v))) for v in x.sum(0)]
    assert W.exact_sums(np.full((5, 1), -(1 << 61))) == [-5 * (1 << 61)]
