"""Whitening against a dense eigensolver and exact integer sums."""
import math

import numpy as np
import pytest

import __spark_entry__ as E
from merchantry.llm import whitening as W


def dense(rows):
    """{(id, component): (n, deviation, whitened, explained)} and the eigenvalues."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dim)]
    z = lambda v: np.array([(n * a - s) / n for a, s in zip(v, sums)])
    centred = np.array([z(v) for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, int((values > 1e-12 * values.sum()).sum()))
    out = {}
    for i, v in x:
        y = z(v) @ vectors[:, :k] / np.sqrt(values[:k])
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for c in range(k):
            out[i, c + 1] = (n, dev, y[c], values[c] / values.sum())
    return out, values


def agree(got, want, values):
    got = {(r.vec_id, r.component): r for r in got}
    assert got.keys() == want.keys()
    for c in {c for _, c in want}:
        ids = [i for i, k in want if k == c]
        ours = np.array([got[i, c].whitened for i in ids])
        theirs = np.array([want[i, c][2] for i in ids])
        sign = 1 if ours @ theirs >= 0 else -1
        gap = min(abs(values[c - 1] - v) for j, v in enumerate(values) if j != c - 1)
        assert np.abs(ours - sign * theirs).max() <= 1e-10 * values[0] / gap + 1e-9
    for key, (n, dev, _, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, dev) and r.identity_error <= 1e-9
        assert math.isclose(r.explained, explained, rel_tol=1e-9)


def test_query_equals_dense_solver(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    agree(E.queries()["op12_chebyshev_whitening"](spark, sf_dir).collect(), *dense(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=20).tolist()) for i in range(90)]
    rows = base + [(100 + i, base[0][1]) for i in range(60)]
    odd = [(200, None), (201, [1.0, None] + [0.0] * 18), (202, [float("nan")] * 20), (203, [float("-inf")] * 20), (204, [])]
    df = spark.createDataFrame([(i, v, "d", 1) for i, v in rows + odd], "vec_id int, embedding array<double>, dim string, x int")
    got = W.whiten(df)
    assert got.schema["vec_id"].dataType.simpleString() == "int"
    agree(got.collect(), *dense(rows))
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.filter("vec_id >= 200")).count() == 0
    assert W.whiten(df.filter("vec_id >= 100")).count() == 0          # one distinct vector


def test_few_vectors_null_ids_and_lengths(spark):
    short = [(None, [0.5, 1.0, 2.0]), (2, [0.25, -1.0, 3.0]), (3, [0.5, 1.0, 2.5]), (3, [0.5, 1.0, 2.5])]
    other = [(7, [1.0, 2.0]), (8, [3.0, 5.0])]
    df = spark.createDataFrame(short + other, "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert sorted(r.component for r in got if r.vec_id == 3) == [1, 1, 2, 2] and sum(r.vec_id is None for r in got) == 2
    assert [(r.component, r.n) for r in got if r.vec_id in (7, 8)] == [(1, 2)] * 2
    assert all(r.identity_error <= 1e-9 for r in got)
    agree([r for r in got if r.vec_id in (7, 8)], *dense(other))


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = W.whiten(df).collect()
    by_id = {r.vec_id: r.deviation for r in rows}
    assert by_id[1] is None and by_id[2] is None and by_id[3] is not None and rows[0].identity_error <= 1e-4


@pytest.mark.parametrize("spectrum", [
    np.full(120, 3.0), 10.0 ** -np.linspace(0, 9, 120), np.r_[1e6, np.linspace(2, 1, 119)],
    np.r_[np.full(17, 5.0), np.full(103, 5.0 - 1e-7)], np.r_[[4.0, 3.0], np.zeros(118)]])
def test_certified_pairs(spectrum):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(120, 120)))[0]
    v = (basis * spectrum) @ basis.T
    values, x = W.principal(lambda q: v @ q, 120, spectrum.sum())
    k = min(16, int((spectrum > 0).sum()))
    assert len(values) == k and np.allclose(values, spectrum[:k], rtol=1e-9)
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12
    assert np.linalg.norm(v @ x - x * values, axis=0).max() <= 2e-12 * spectrum[0]


def test_unwanted_spectrum_is_damped():
    values = np.linspace(10, 1, 60)
    y = W.filtered(lambda q: values[:, None] * q, np.ones((60, 1)) / 8, np.r_[values[:20]], 4, 10)
    assert np.abs(y[20:]).max() < 1e-3 * np.abs(y[:4]).min()
