"""Incremental spectra and whitened embeddings against plain linear algebra."""

import math

import numpy as np
import pytest

from driftwatch.llm import whitening
from driftwatch.llm.spectrum import Spectrum, rank_one, secular_roots

SCHEMA = "vec_id long, embedding array<float>, label int, n long, task long, component string"


def brute(rows, components=8):
    """{(vec_id, component): ...} from whole numbers and one eigenvalue problem."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda d: (sizes.count(d), d), default=0)
    good = [(i, v) for i, v in good if len(v) == size]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    if not n:
        return {}, None
    whole = np.array([[n * c - s for c, s in zip(r, sums)] for r in x], object)
    cov = (whole.T @ whole).astype(float) / n ** 3
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values[:components] > 1e-12 * np.trace(cov)).sum())
    centred = whole.astype(float) / n
    out = {}
    for k, (i, _) in enumerate(good):
        for c in range(keep):
            out[i, c + 1] = (n, int((whole[k] ** 2).sum()), centred[k] @ vectors[:, c] / np.sqrt(values[c]), values[c] / np.trace(cov))
    return out, keep


def compare(spark, rows, tolerance=1e-6, **more):
    frame = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], SCHEMA).repartition(3)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(frame, **more).collect()}
    want, keep = brute(rows)
    assert got.keys() == want.keys()
    for c in range(1, (keep or 0) + 1):
        pairs = [(got[k].whitened, want[k][2]) for k in want if k[1] == c]
        sign = 1 if sum(a * b for a, b in pairs) > 0 else -1
        assert max(abs(a - sign * b) for a, b in pairs) < tolerance
    for k, r in got.items():
        assert (r.n, int(r.deviation)) == want[k][:2] and r.explained == pytest.approx(want[k][3], rel=1e-9)
        assert r.identity_error < 1e-9
    return got


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_spectra_equal_the_eigenvalues_of_all_rows(block):
    rng = np.random.default_rng(block)
    rows = np.floor(rng.normal(size=(300, 12)) * np.geomspace(1, 2000, 12))
    rows[100:150], rows[:, 5] = rows[0], 3.0
    parts = [Spectrum.empty(12) for _ in range(3)]
    for part, own in zip(parts, np.array_split(rows, 3)):
        for k in range(0, len(own), block):
            part.add(own[k:k + block])
    whole = Spectrum.from_bytes(parts[0].n, parts[0].to_bytes())
    for part in (*parts[1:], Spectrum.empty(12)):
        whole.merge(part)
    scatter = np.cov(rows.T, bias=True) * len(rows)
    top = np.linalg.eigvalsh(scatter)[-1]
    assert whole.n == 300 and np.allclose(whole.mean, rows.mean(0))
    assert np.abs(np.linalg.eigvalsh(scatter) - whole.values).max() < 1e-11 * top
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(12)).max() < 1e-10
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - scatter).max() < 1e-10 * top


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(3)
    for _ in range(20):
        d = np.sort(rng.normal(size=9)) + np.arange(9) * 1e-3
        z = rng.normal(size=9) * np.geomspace(1e-6, 1, 9)
        pole, tau = secular_roots(d, z, 2.5)
        want = np.linalg.eigvalsh(np.diag(d) + 2.5 * np.outer(z, z))
        assert np.allclose(d[pole] + tau, want, atol=1e-12)


def test_rank_one_deflates_equal_values_and_untouched_directions():
    values = np.array([0.0, 1.0, 1.0, 1.0, 2.0])
    v = np.array([0.0, 1.0, -2.0, 0.5, 0.0])
    got, vectors = rank_one(values, np.eye(5), v, 3.0)
    whole = np.diag(values) + 3 * np.outer(v, v)
    assert np.allclose(got, np.linalg.eigvalsh(whole)) and np.allclose((vectors * got) @ vectors.T, whole)
    assert np.array_equal(rank_one(values, np.eye(5), np.zeros(5), 3.0)[1], np.eye(5))


def test_whitened_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=10) * np.geomspace(1, 0.05, 10)).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    odd = [(900, None), (901, []), (902, [None] * 10), (903, [float("nan")] + [0.1] * 9), (904, [float("inf")] * 10),
           (905, [0.5] * 4)]
    compare(spark, rows + odd)
    compare(spark, rows + odd, block=1)


def test_whitened_small_and_degenerate_tables(spark):
    compare(spark, [(1, [0.5, -0.25]), (2, [0.5, 0.75]), (3, [0.125, 0.75])])
    assert len(compare(spark, [(1, [0.5, 1.0, 2.0]), (2, [1.5, 1.0, 2.0])])) == 2
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert compare(spark, rows) == {}


def test_deviation_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(i % 3) * 1e12, float(i % 5)]) for i in range(40)]
    got = compare(spark, rows, 1e-4)
    assert max(int(r.deviation) for r in got.values()) > 1 << 64
