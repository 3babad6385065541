"""4x4 geometry that SQL cannot say, against plain NumPy, and logs without a marker."""

from __future__ import annotations

import numpy as np
import pytest

from wavequarry import catalog
from wavequarry.sources import files


def of_eigen(m, f):
    v, w = np.linalg.eigh(m)
    return w @ np.diag(f(v)) @ w.T


@pytest.fixture(scope="module")
def epochs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float).reshape(-1, 16, 4)
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]), np.array([np.cov(e.T) + 1e-6 * np.eye(4) for e in x])


def geometric_mean(ms):
    m = ms.mean(0)
    for _ in range(60):
        r, w = of_eigen(m, np.sqrt), of_eigen(m, lambda v: v**-0.5)
        m = r @ of_eigen(np.mean([of_eigen(w @ c @ w, np.log) for c in ms], axis=0), np.exp) @ r
    return m


def test_means_leave_out_what_is_no_covariance(spark, sf_dir, epochs):
    ids, labels, c = epochs
    got = {r.label: r for r in catalog.queries()["guarded_means"](spark, sf_dir).collect()}
    for k in np.unique(labels):
        own = c[(labels == k) & (ids % 7 != 3)]
        assert (k in got) == (len(own) >= 3)
        if k in got:
            assert got[k].n == len(own) and got[k].converged and np.isclose(got[k].logdet, np.mean(np.linalg.slogdet(own)[1]))


def test_faults_by_the_whole_matrix(spark, sf_dir, epochs):
    ids, labels, c = epochs
    got = {r.vec_id: r for r in catalog.queries()["fault_gate4"](spark, sf_dir).collect()}
    for k in np.unique(labels):
        own = labels == k
        m = geometric_mean(c[own])
        d = np.array([np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(m, x)).real) ** 2).sum()) for x in c[own]])  # generalised eigenvalues
        assert np.allclose([got[i].dist for i in ids[own]], d, atol=1e-5)
        assert [got[i].fault for i in ids[own]] == (d > d.mean() + 3 * d.std()).tolist()


def test_log_maps(spark, sf_dir, epochs):
    ids, _, c = epochs
    m = c.mean(0)
    r, w = of_eigen(m, np.sqrt), of_eigen(m, lambda v: v**-0.5)
    got = {x.vec_id: x for x in catalog.queries()["log_maps4"](spark, sf_dir).collect()}
    for i, x in zip(ids, c):
        plain, mapped = of_eigen(x, np.log), r @ of_eigen(w @ x @ w, np.log) @ r
        assert np.allclose(got[i].plain, plain[np.triu_indices(4)]) and np.allclose(got[i].mapped, [mapped[a, b] * (1 if a == b else 2**0.5) for a in range(4) for b in range(a, 4)])


def test_a_log_without_its_marker(spark, tmp_path):
    (tmp_path / "good.log").write_text("head\n== RUN ==\none\ntwo\n== RUN ==\nthree\n")
    (tmp_path / "bad.log").write_text("nothing here\n")
    rows = files.read_log_blocks(spark, str(tmp_path), "== RUN ==").collect()
    assert sorted((r.block, r.line) for r in rows) == [(1, "one"), (1, "two"), (2, "three")]
    with pytest.raises(Exception, match="no marker in .*bad.log"):
        files.read_log_blocks(spark, str(tmp_path), "== RUN ==", required=True).collect()
