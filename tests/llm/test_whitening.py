"""Whitening beside plain linear algebra on all rows at once."""

import math

import numpy as np
import pytest
from conftest_llm import table
from pyspark.sql import functions as F

from fleetfault.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=4):
    """(n, {vec_id: (deviation, centred x)}, eigenvalues) by numpy and Python's numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    scores = {i: (np.array(x, float) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order]) for i, x in kept}
    return n, sorted(deviation), values[order] / values.sum(), scores


def check(found, rows):
    n, deviation, explained, scores = plain(rows)
    assert {r.n for r in found} == {n}
    for k in range(1, len(explained) + 1):
        part = [r for r in found if r.component == k]
        assert sorted((r.vec_id, r.deviation) for r in part) == deviation
        assert all(abs(r.explained - explained[k - 1]) < 1e-10 for r in part)
        sign = {round(r.whitened / scores[r.vec_id][k - 1]) for r in part if abs(scores[r.vec_id][k - 1]) > 1e-3}
        assert len(sign) == 1 and sign <= {1, -1}
        assert all(abs(r.whitened - min(sign) * scores[r.vec_id][k - 1]) < 1e-8 for r in part)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_messy_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((60, 8)) * [3, 2, 1.5, 1, 0.5, 0.4, 0.3, 0.2]
    rows = [(k, [float(c) for c in v], 1) for k, v in enumerate(vectors)]
    rows += [(100, rows[3][1], None), (101, rows[3][1], 2), (102, rows[3][1], 2)]  # copies count once
    rows += [(200, None, 1), (201, [1.0, None, *[0.0] * 6], 1), (202, [math.nan, *[0.0] * 7], 1), (203, [math.inf, *[0.0] * 7], 1)]
    found = whitening.whiten(table(spark, rows, SCHEMA)).collect()
    check(found, rows)
    assert len(found) == 4 * 63
    odd = [*rows, (300, [], 1), (301, [1.0, 2.0], 1)]  # other lengths can not be projected
    assert sorted(r.vec_id for r in whitening.whiten(table(spark, odd, SCHEMA)).collect()) == sorted(r.vec_id for r in found)
    nameless = [(None, v, lab) for _, v, lab in rows]
    assert len(whitening.whiten(table(spark, nameless, SCHEMA)).collect()) == len(found)


def test_nothing_to_scale(spark):
    assert whitening.whiten(table(spark, [], SCHEMA)).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 1)], SCHEMA)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).count() == 0
    flat = [(k, [float(k), 1.0, 2.0], 1) for k in range(5)]  # one direction only
    assert {r.component for r in whitening.whiten(table(spark, flat, SCHEMA)).collect()} == {1}


def test_very_large_numbers(spark):
    rows = [(1, [3e7, 1.0], 1), (2, [-3e7, 2.0], 1), (3, [3e10, 2.0], 1), (4, [3e30, 1.0], 1)]
    found = {r.vec_id: r for r in whitening.whiten(table(spark, rows, SCHEMA)).collect() if r.component == 1}
    assert len(found) == 4 and found[4].deviation is None and found[1].n == 4


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_counts_and_spectrum(d):
    m = np.random.default_rng(d).standard_normal((3 * d, d))
    v = m.T @ m / len(m)
    values = np.linalg.eigvalsh(v)[::-1]
    for shift in [*np.random.default_rng(1).uniform(-1, values[0] + 1, 20), 0.0]:
        assert whitening.eigenvalues_above(v, shift) == int((values > shift).sum())
    found = whitening.slice_spectrum(v, 5)
    assert np.allclose(found.values, values[:5], rtol=1e-12)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(found.values)), atol=1e-12)
    assert all(above < k <= below for k, (above, below) in enumerate(found.counts, 1))


def test_equal_eigenvalues():
    for v in (np.eye(5), np.diag([3.0, 3.0, 3.0, 1.0, 0.0]), np.diag([2.0, 2.0 - 1e-15, 2.0 - 1e-9, 1.0])):
        found = whitening.slice_spectrum(v, 4)
        assert np.allclose(v @ found.vectors, found.vectors * found.values, atol=1e-12)
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-12)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", F.lit(0)).collect()
    check(queries.op13_whiten_embeddings(spark, folder).collect(), rows)
