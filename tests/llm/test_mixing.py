import numpy as np
import pytest

from scoreloom.llm import mixing as M


def test_totals_reach_the_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = M.document_rates(docs, M.labelled_domains(docs, labels), M.TARGETS).collect()
    n, r = np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    totals = (n * r) @ np.array([x.posterior for x in rows])
    assert (r >= 0).all()
    assert np.abs(totals / totals.sum() - list(M.TARGETS.values())).max() < 0.01


def test_projection_keeps_rates_nonnegative(spark):
    """A target far from the corpus pushes rates to 0; the least squares optimum is checked by its conditions."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400).astype(float)
    targets = np.array([0.9, 0.08, 0.02])
    steps = M.fit_rates(spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens double, posterior array<double>"), targets)
    r = M._rate(p, steps.steps)
    assert (r >= 0).all() and (r == 0).any()
    totals = (n * r) @ p
    assert np.abs(totals - targets * n.sum()).max() < 0.01 * n.sum()
    assert steps.residual == pytest.approx(np.abs(totals - targets * n.sum()).sum() / n.sum(), abs=1e-9)


def nonnegative_least_squares(a, goal):
    """min |a r - goal| over r >= 0 by plain projected gradient, run until it stands still."""
    r, step = np.ones(a.shape[1]), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(200_000):
        new = np.maximum(0, r - step * a.T @ (a @ r - goal))
        if np.abs(new - r).max() < 1e-9:
            break
        r = new
    return np.linalg.norm(a @ r - goal)


def test_no_nonnegative_rates_come_nearer(spark):
    """Targets in the middle and at the edge of what is reachable against an independent least squares solution; others are reported."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.dirichlet([4, 4, 4], 150), [[0.6, 0.3, 0.1]] * 20])
    n = rng.integers(1, 40, len(p)).astype(float)
    table = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens double, posterior array<double>")
    for targets in ([0.4, 0.35, 0.25], [0.6, 0.3, 0.1]):
        fit = M.fit_rates(table, np.array(targets))
        goal, r = np.array(targets) * n.sum(), M._rate(p, fit.steps)
        assert (r >= 0).all() and fit.residual == pytest.approx(np.abs((n * r) @ p - goal).sum() / n.sum(), abs=1e-9)
        assert np.linalg.norm((n * r) @ p - goal) <= nonnegative_least_squares((p * n[:, None]).T, goal) + 0.002 * n.sum()
    with pytest.warns(UserWarning, match="away from its targets"):
        M.fit_rates(table, np.array([0.97, 0.02, 0.01])).checked()


def accelerated(p, n, goal, steps=60_000):
    """min |sum n r p - goal| over r >= 0 by accelerated projected gradient, each gradient scaled by the tokens."""
    r = z = np.ones(len(n))
    step, t = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1], 1.0
    for _ in range(steps):
        new = np.maximum(0, z - step * (p @ ((n * z) @ p - goal)))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, r, t = new + (t - 1) / after * (new - r), new, after
    return np.linalg.norm((n * r) @ p - goal)


def test_rates_are_the_least_squares_ones_of_the_classifiers_own_posteriors(spark, docs, labels):
    rows = M.document_rates(docs, M.labelled_domains(docs, labels), M.TARGETS).collect()
    n, r, p = np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows]), np.array([x.posterior for x in rows])
    goal = np.array(list(M.TARGETS.values())) * n.sum()
    assert (r >= 0).all()
    assert np.linalg.norm((n * r) @ p - goal) <= accelerated(p, n, goal) + 1e-3 * n.sum()


@pytest.mark.parametrize("seed", range(4))
def test_sharp_posteriors_over_eight_domains(spark, seed):
    """Rare domains, domains without a document, and targets at and beyond the edge."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.02] * 8, 250)
    if seed % 2:
        p[:, 7] = 0
        p /= p.sum(1, keepdims=True)
    n = rng.integers(1, 3000, 250).astype(float)
    targets = rng.dirichlet([0.7] * 8)
    fit = M.fit_rates(spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens double, posterior array<double>").repartition(2), targets)
    goal, r = targets * n.sum(), M._rate(p, fit.steps)
    assert np.isfinite(r).all() and (r >= 0).all()
    assert np.linalg.norm((n * r) @ p - goal) <= accelerated(p, n, goal) + 1e-3 * n.sum()


def test_odd_rows(spark, odd, odd_rows, none):
    targets = {"a": 0.5, "b": 0.5}
    labelled = spark.createDataFrame([(1, "a"), (2, "b"), (6, "b"), (None, "a"), (7, "other"), (8, None)], "id long, domain string")
    rows = M.document_rates(odd, labelled, targets)
    assert rows.count() == len(odd_rows)
    assert all(np.isfinite(r.rate) and abs(sum(r.posterior) - 1) < 1e-9 for r in rows.collect())
    out = M.mixed(odd, labelled, targets)
    assert set(out.columns) == set(odd.columns) and dict(out.dtypes)["rate"] == "double"
    assert M.document_rates(none, labelled, targets).count() == 0
    assert M.document_rates(odd, labelled.where("id > 99"), targets).count() == len(odd_rows)


def test_domains_are_learned(docs, labels):
    names = list(M.TARGETS)
    known = {r.id: r.domain for r in M.labelled_domains(docs, labels).collect()}
    rows = M.document_rates(docs, M.labelled_domains(docs, labels), M.TARGETS).collect()
    right = [names[int(np.argmax(r.posterior))] == known[r.doc_id] for r in rows if r.doc_id in known]
    assert np.mean(right) > 0.9
