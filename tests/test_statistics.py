"""Operators against plain numpy, identities, and recovery of known parameters."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pollspark.functions import columns as C
from pollspark.operators import cells as I
from pollspark.operators import dimension as N
from pollspark.operators import draws as R
from pollspark.operators import fit, ranking, regress
from pollspark.operators import scores as S


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.924, 0.99, 1 - 1e-9]
    got = frame(spark, p=ps).select(C.normal_quantile(F.col("p")).alias("z")).collect()
    assert np.allclose([r.z for r in got], [NormalDist().inv_cdf(p) for p in ps], rtol=1e-12)


def test_t_tail():
    # Closed forms for 1, 2 and 3 degrees of freedom, a numeric integral for 26.
    for t in (0.1, 0.5, 2.0, 12.0):
        assert regress.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t))
        assert regress.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t))
        u = t / math.sqrt(3)
        assert regress.t_two_sided(-t, 3) == pytest.approx(1 - 2 / math.pi * (u / (1 + u * u) + math.atan(u)))
    x = np.linspace(-2.25, 2.25, 200_001)
    density = math.exp(math.lgamma(13.5) - math.lgamma(13)) / math.sqrt(26 * math.pi) * (1 + x * x / 26) ** -13.5
    assert regress.t_two_sided(2.25, 26) == pytest.approx(1 - np.trapezoid(density, x), rel=1e-6)


def test_quantiles_of_large_skewed_groups(spark):
    # Low accuracy forces brackets; one group holds most rows and has many ties.
    rng = np.random.default_rng(3)
    big = np.round(np.exp(rng.normal(size=20_000)), 2)
    small = rng.normal(size=37)
    df = frame(spark, g=["a"] * len(big) + ["b"] * len(small) + ["c"], v=[*big, *small, None])
    probs = [0, 0.05, 0.25, 0.5, 0.95, 1]
    got = {r["g"]: r for r in ranking.quantiles(df.repartition(8), "v", probs, ["g"], accuracy=200).collect()}
    for g, values in (("a", big), ("b", small)):
        want = np.quantile(values, probs)
        assert np.allclose([got[g][f"q{100 * p:g}"] for p in probs], want, rtol=1e-12)
    assert got["c"]["q50"] is None
    total = ranking.quantiles(df, "v", [0.5], accuracy=200).first()[0]
    assert total == pytest.approx(np.median(np.concatenate([big, small])))


def test_quantile_positions_between_values(spark):
    for n in range(1, 12):
        values = [float(i * i) for i in range(n)]
        row = ranking.quantiles(frame(spark, v=values), "v", [0.25, 0.5, 0.9]).first()
        assert np.allclose(list(row), np.quantile(values, [0.25, 0.5, 0.9]))


def test_positions_span_partitions(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 500, 5000)
    df = frame(spark, k=np.arange(5000), v=values).repartition(8)
    got = ranking.row_numbers(df, [F.col("v"), F.col("k")]).orderBy("row").collect()
    assert [r.row for r in got] == list(range(1, 5001))
    assert [(r.v, r.k) for r in got] == sorted(zip(values, range(5000)))
    ranks = ranking.average_ranks(df.withColumn("g", F.col("k") % 2), "v", ["g"]).collect()
    for g in (0, 1):
        mine = pd.Series(values[np.arange(5000) % 2 == g])
        want = dict(zip(mine, mine.rank()))
        assert {r["v"]: r["rank"] for r in ranks if r["g"] == g} == want


def test_robust_and_clustered_errors(spark):
    rng = np.random.default_rng(5)
    n, groups = 300, rng.integers(0, 12, 300)
    x = rng.normal(size=n) + groups
    y = 0.5 * x + groups * 0.3 + rng.normal(size=n) * (1 + np.abs(x))
    df = frame(spark, y=[*y, 1.0], x=[*x, None], g=[*groups, 1]).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))

    def ols(design):
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        bread = np.linalg.inv(design.T @ design)
        resid = y - design @ beta
        lever = np.einsum("ij,jk,ik->i", design, bread, design)
        hc2 = bread @ (design.T * (resid**2 / (1 - lever))) @ design @ bread
        return beta, np.sqrt(np.diag(hc2)), resid, bread

    plain = np.column_stack([np.ones(n), x])
    beta, se, resid, bread = ols(plain)
    row = regress.ols_robust(df, "y", "x").first()
    assert row.n == n
    assert np.allclose([row.intercept, row.slope, row.intercept_se, row.slope_se], [*beta, *se])
    r2 = 1 - resid @ resid / np.sum((y - y.mean()) ** 2)
    assert np.allclose([row.r2, row.adj_r2, row.rmse], [r2, 1 - (1 - r2) * (n - 1) / (n - 2), math.sqrt(resid @ resid / (n - 2))])

    meat = sum(np.outer(plain[groups == g].T @ resid[groups == g], plain[groups == g].T @ resid[groups == g]) for g in set(groups))
    c = len(set(groups))
    cov = bread @ meat @ bread * c / (c - 1) * (n - 1) / (n - 2)
    row = regress.ols_cluster(df, "y", "x", "g").first()
    assert np.allclose([row.intercept_se, row.slope_se], np.sqrt(np.diag(cov)))
    table = {r.term: r for r in regress.coefficient_table(regress.ols_cluster(df, "y", "x", "g")).collect()}
    assert table["slope"].p_value == pytest.approx(regress.t_two_sided(row.slope_t, c - 1))

    dummies = np.column_stack([x, *[(groups == g).astype(float) for g in sorted(set(groups))]])
    beta, se, resid, _ = ols(dummies)
    row = regress.ols_within(df, "y", "x", "g").first()
    assert np.allclose([row.slope, row.slope_se], [beta[0], se[0]])
    without = dummies[:, 1:]
    rss0 = np.sum((y - without @ np.linalg.lstsq(without, y, rcond=None)[0]) ** 2)
    row = regress.partial_r2(df, "y", "x", "g").first()
    assert row.partial_r2 == pytest.approx(1 - resid @ resid / rss0)


def test_pairwise_partial_r2(spark):
    rng = np.random.default_rng(6)
    rows = [(u, t, *np.where(rng.random(3) < 0.7, rng.normal(size=3) + u, np.nan)) for u in range(20) for t in range(4)]
    pdf = pd.DataFrame(rows, columns=["u", "t", "a", "b", "c"])
    wide = spark.createDataFrame(pdf).select("u", "t", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = {(r.x, r.y): r for r in regress.pairwise_partial_r2(wide, ["a", "b", "c"], "u", min_df=10).collect()}
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    for (x, y), row in got.items():
        some = pdf[["u", x, y]].dropna()
        design = np.column_stack([some[x], pd.get_dummies(some.u).to_numpy(float)])
        rss = [np.sum((some[y] - d @ np.linalg.lstsq(d, some[y], rcond=None)[0]) ** 2) for d in (design, design[:, 1:])]
        assert row.partial_r2 == pytest.approx(1 - rss[0] / rss[1])
        assert row.df == len(some) - some.u.nunique() - 1
        assert row.n_years == some.groupby("u").size().max()


def _plain_ess(x):
    """Effective size of an array chain x iteration, lag by lag."""
    m, n = x.shape
    centred = x - x.mean(axis=1, keepdims=True)
    acov = np.array([[np.sum(c[: n - t] * c[t:]) / n for t in range(n)] for c in centred]).mean(axis=0)
    within = acov[0] * n / (n - 1)
    pooled = within * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0)
    rho = 1 - (within - acov) / pooled
    rho[0] = 1
    t, even, odd, kept = 0, 1.0, rho[1], {0: 1.0, 1: rho[1]}
    while t < n - 5 and even + odd > 0:
        t += 2
        even, odd = rho[t], rho[t + 1]
        if even + odd >= 0:
            kept[t], kept[t + 1] = even, odd
    last = t
    if even > 0:
        kept[last] = even
    for t in range(2, last - 1, 2):
        if kept[t] + kept[t + 1] > kept[t - 2] + kept[t - 1]:
            kept[t] = kept[t + 1] = (kept[t - 2] + kept[t - 1]) / 2
    tau = -1 + 2 * sum(kept.get(i, 0.0) for i in range(last)) + kept.get(last, 0.0)
    return m * n / max(tau, 1 / math.log10(m * n))


def _chains(rng, n, phi, chains=4):
    x = np.zeros((chains, n))
    noise = rng.normal(size=(chains, n))
    for i in range(1, n):
        x[:, i] = phi * x[:, i - 1] + noise[:, i]
    return x


def test_effective_size_over_several_blocks(spark):
    rng = np.random.default_rng(7)
    data = {"slow": _chains(rng, 150, 0.97), "fast": _chains(rng, 150, 0.1), "anti": _chains(rng, 150, -0.6)}
    data["trend"] = np.tile(np.linspace(0, 1, 150), (4, 1)) + rng.normal(size=(4, 150)) * 0.01
    rows = [(k, c, i + 1, float(v)) for k, x in data.items() for (c, i), v in np.ndenumerate(x)]
    rows += [("same", c, i + 1, 1.0) for c in range(4) for i in range(150)]
    halves = spark.createDataFrame(rows, "variable string, half long, pos long, value double")
    got = dict(R.effective_size(halves, block=16).select("variable", "ess").collect())
    assert got.pop("same") is None
    for name, x in data.items():
        assert got[name] == pytest.approx(_plain_ess(x), rel=1e-9), name


def test_convergence(spark):
    rng = np.random.default_rng(8)
    good, stuck = _chains(rng, 101, 0.3), _chains(rng, 101, 0.3) + np.arange(4)[:, None] * 3
    rows = [(k, c + 1, i + 1, float(v)) for k, x in (("good", good), ("stuck", stuck)) for (c, i), v in np.ndenumerate(x)]
    draws = spark.createDataFrame(rows, "variable string, chain long, iteration long, value double")

    def split(x):
        return np.concatenate([x[:, : x.shape[1] // 2], x[:, -(x.shape[1] // 2) :]])

    def normal(x):
        ranks = pd.Series(x.ravel()).rank().to_numpy()
        return np.array([NormalDist().inv_cdf((r - 0.375) / (x.size + 0.25)) for r in ranks]).reshape(x.shape)

    def rhat(x):
        n = x.shape[1]
        within = x.var(axis=1, ddof=1).mean()
        return math.sqrt(((n - 1) / n * within + x.mean(axis=1).var(ddof=1)) / within)

    got = {r["variable"]: r for r in R.convergence(draws).collect()}
    for name, x in (("good", good), ("stuck", stuck)):
        halves = split(x)
        q5, q50, q95 = np.quantile(x, [0.05, 0.5, 0.95])
        bulk = normal(halves)
        assert got[name].rhat == pytest.approx(max(rhat(bulk), rhat(normal(np.abs(halves - q50)))), rel=1e-9)
        assert got[name].ess_bulk == pytest.approx(_plain_ess(bulk), rel=1e-9)
        tails = [_plain_ess((halves <= q).astype(float)) for q in (q5, q95)]
        assert got[name].ess_tail == pytest.approx(min(tails), rel=1e-9)
    assert got["good"].rhat < 1.1 < got["stuck"].rhat
    plain = dict(R.split_rhat(draws).collect())
    assert plain["stuck"] == pytest.approx(rhat(split(stuck)))


def test_split_rhat_keeps_unequal_chains_whole(spark):
    rng = np.random.default_rng(12)
    chains = [rng.normal(size=n) for n in (100, 61, 40)]
    rows = [("v", c, i + 1, float(x)) for c, chain in enumerate(chains) for i, x in enumerate(chain)]
    draws = spark.createDataFrame(rows, "variable string, chain long, iteration long, value double")
    halves = [h for x in chains for h in (x[: len(x) // 2], x[len(x) - len(x) // 2 :])]
    n = np.array([len(h) for h in halves])
    m = np.array([h.mean() for h in halves])
    within = sum((k - 1) * h.var(ddof=1) for k, h in zip(n, halves, strict=True)) / (n - 1).sum()
    between = (n * (m - (n * m).sum() / n.sum()) ** 2).sum() / (len(n) - 1) / n.mean()
    expected = math.sqrt(((n.mean() - 1) / n.mean() * within + between) / within)
    assert R.split_rhat(draws).first().rhat == pytest.approx(expected)
    assert 0 < R.convergence(draws).first().ess_bulk < 2 * n.sum()


def test_draw_summary(spark):
    rng = np.random.default_rng(9)
    x = rng.gamma(2, size=500)
    df = frame(spark, variable=["v"] * 500, chain=[1] * 500, iteration=range(500), value=x)
    row = R.summarise_draws(df).first()
    mad = 1.4826 * np.median(np.abs(x - np.median(x)))
    want = [x.mean(), np.median(x), x.std(ddof=1), mad, *np.quantile(x, [0.05, 0.95])]
    assert np.allclose([row["mean"], row["median"], row["sd"], row["mad"], row["q5"], row["q95"]], want)


def _toy(spark, seed=10, countries=4, per=3, periods=4, questions=4, yes=400):
    """Cells drawn from known parameters; the last question has two options less."""
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(countries), per)
    weight = np.concatenate([rng.dirichlet(np.ones(per) * 5) for _ in range(countries)])
    alpha = rng.normal(size=countries)[owner, None] + np.cumsum(rng.normal(size=(len(owner), periods)) * 0.15, axis=1)
    gamma = np.exp(rng.normal(size=questions) * 0.3)
    gamma /= np.exp(np.log(gamma).mean())
    kmin1 = np.array([4] * (questions - 1) + [2])
    beta = [np.sort(rng.normal(size=k)) for k in kmin1]
    beta = [b - np.mean([x.mean() for x in beta]) for b in beta]
    cells, nat = [], []

    def counts(score, j):
        upper = 1 / (1 + np.exp(-gamma[j] * (score - beta[j])))
        p = -np.diff(np.concatenate([[1.0], upper, [0.0]]))
        return rng.multinomial(yes, p)

    for j in range(questions):
        for t in range(periods):
            for r in range(len(owner)):
                cells += [(r + 1, owner[r] + 1, t + 1, j + 1, k + 1, int(c)) for k, c in enumerate(counts(alpha[r, t], j))]
            for c in range(countries):
                score = (alpha[owner == c, t] * weight[owner == c]).sum()
                nat += [(c + 1, t + 1, j + 1, k + 1, int(n)) for k, n in enumerate(counts(score, j))]
    schema = "iso_3166_int int, year_int int, question_int int, option int, yes long"
    cells = spark.createDataFrame([tuple(map(int, row)) for row in cells], "regioncode_int int, " + schema)
    nat = spark.createDataFrame([tuple(map(int, row)) for row in nat], schema)
    places = frame(spark, regioncode_int=np.arange(1, len(owner) + 1), iso_3166_int=owner + 1)
    weights = frame(spark, regioncode_int=np.arange(1, len(owner) + 1), wt=weight)
    return cells, nat, places, weights, alpha, gamma, beta


def _parts(cells, places, weights, d):
    """Region rows as plain arrays: cells, country, weight."""
    rows = fit.region_rows(cells, places, weights).orderBy("unit").toPandas()
    n = rows["t"].map(len).to_numpy()
    flat = [np.concatenate([np.asarray(x) for x in rows[c]]) for c in ("t", "question", "option", "yes")]
    return (np.repeat(np.arange(len(rows)), n), *flat), rows["country"].to_numpy(), rows["wt"].to_numpy()


def _objective(spark, toy, d):
    """The log posterior as a plain function of region scores, walks and phi."""
    cells, nat, places, weights, *_ = toy
    regional, country, wt = _parts(cells, places, weights, d)
    packed = fit._packed(nat, "iso_3166_int").orderBy("unit").toPandas()
    n = packed["t"].map(len).to_numpy()
    national = (np.repeat(packed["unit"].to_numpy() - 1, n), *[np.concatenate([np.asarray(x) for x in packed[c]]) for c in ("t", "question", "option", "yes")])

    def value(alpha, a, phi):
        score = np.zeros_like(a)
        np.add.at(score, country, wt[:, None] * alpha)
        total = fit.slot_sums(regional, alpha, phi, d)["ll"] + fit.slot_sums(national, score, phi, d)["ll"] + fit.items_prior(phi, d)
        for x, log_step, start, (shape, rate) in ((a, phi[0], 5, (2, 8)), (alpha - a[country], phi[1], 3, (1, 8))):
            raw = np.diff(x, axis=1, prepend=0) / np.exp(log_step)
            raw[:, 0] /= start
            total += -0.5 * np.sum(raw**2) + shape * log_step - rate * np.exp(log_step)
        return total

    return value


def test_fit_gradient(spark):
    """The value is the model's, and its slope is 0 in every direction where the fit settles."""
    toy = _toy(spark, countries=2, per=2, periods=2, questions=3, yes=20)
    found = fit.fit(*toy[:4])
    assert found.settled and found.passes < 60
    d, value = found.design, _objective(spark, toy, found.design)
    alpha = np.array([r.alpha for r in found.regions.orderBy("unit").collect()])
    here = value(alpha, found.at.a, found.at.phi)
    assert here == pytest.approx(found.system.value, rel=1e-12)
    theta = np.concatenate([alpha.ravel(), found.at.a.ravel(), found.at.phi])
    cut = [alpha.size, alpha.size + found.at.a.size]

    def split(x):
        return x[: cut[0]].reshape(alpha.shape), x[cut[0] : cut[1]].reshape(found.at.a.shape), x[cut[1] :]

    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-4
        up, down = value(*split(theta + e)), value(*split(theta - e))
        assert abs(up - down) / 2e-4 < 1e-4, i
        assert up < here and down < here, i
    # The spread of scores at given phi is that of the inverse curvature.
    n = cut[1]
    curve = np.zeros((n, n))
    steps = np.eye(len(theta)) * 1e-3
    for i in range(n):
        for j in range(n):
            f = [value(*split(theta + x * steps[i] + y * steps[j])) for x, y in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
            curve[i, j] = -(f[0] - f[1] - f[2] + f[3]) / 4e-6
    cov = np.linalg.inv(curve)
    sd = np.array([r.sd for r in found.regions.orderBy("unit").collect()])
    assert np.allclose(sd.ravel(), np.sqrt(np.diag(cov))[: cut[0]], rtol=1e-3)
    wt = np.asarray(toy[3].orderBy("regioncode_int").toPandas()["wt"])
    lift = np.zeros((found.at.a.size, n))
    for r in range(len(alpha)):
        for t in range(d.periods):
            lift[r // 2 * d.periods + t, r * d.periods + t] = wt[r]
    national = np.array([r.sd for r in found.national_scores().orderBy("iso_3166_int", "year_int").collect()])
    assert np.allclose(national, np.sqrt(np.diag(lift @ cov @ lift.T)), rtol=1e-3)


def test_fit_recovers_parameters(spark):
    cells, nat, places, weights, alpha, gamma, beta = _toy(spark)
    got = dict(fit.fit_map(cells.repartition(4), nat, places, weights, iters=60).collect())
    assert got["converged__"] == 1 and got["slope__"] < 1e-3
    fitted = np.array([[got[f"region_alpha[{r + 1},{t + 1}]"] for t in range(alpha.shape[1])] for r in range(len(alpha))])
    assert np.corrcoef(fitted.ravel(), alpha.ravel())[0, 1] > 0.99
    assert np.abs(fitted - alpha).max() < 0.35
    found = np.array([got[f"gamma[{j + 1}]"] for j in range(len(gamma))])
    assert np.prod(found) == pytest.approx(1.0)
    assert np.abs(found - gamma).max() < 0.15
    mids = [np.mean([got[f"beta[{j + 1},{k + 1}]"] for k in range(len(b))]) for j, b in enumerate(beta)]
    assert np.mean(mids) == pytest.approx(0.0, abs=1e-9)
    assert max(abs(got[f"beta[{j + 1},{k + 1}]"] - v) for j, b in enumerate(beta) for k, v in enumerate(b)) < 0.3


def test_fit_does_not_depend_on_the_start(spark, monkeypatch):
    toy = _toy(spark, countries=3, per=2, periods=3, questions=3, yes=50)

    def elsewhere(d):
        rng = np.random.default_rng(1)
        p = fit.start(d)
        return fit.Point(p.a + rng.normal(size=p.a.shape), p.phi + rng.normal(size=len(p.phi)) * 0.3)

    one = dict(fit.fit_map(*toy[:4]).collect())
    monkeypatch.setattr(fit, "BATCH", 100)  # a region at a time
    found = fit.fit(*toy[:4], begin=elsewhere)
    other = dict(found.variables().collect())
    assert found.settled
    assert max(abs(one[k] - other[k]) for k in one if "[" in k) < 1e-6


def test_fit_of_regions_without_cells(spark):
    cells, nat, places, weights, *_ = _toy(spark, countries=2, per=2, periods=2, questions=3, yes=20)
    found = fit.fit(cells.where("regioncode_int <> 2"), nat.where("iso_3166_int <> 2"), places, weights)
    rows = {(r.regioncode_int, r.year_int): r for r in found.region_scores().collect()}
    assert found.settled and len(rows) == 8
    assert rows[2, 1].sd > rows[1, 1].sd


def test_likelihood_expression_matches_the_fit(spark):
    toy = _toy(spark, countries=2, per=2, periods=2, questions=3, yes=20)
    cells, nat, places, weights, alpha, gamma, beta = toy
    d = fit.design(cells, nat, places)
    rng = np.random.default_rng(4)
    phi = fit.start(d).phi + rng.normal(size=d.free) * 0.2
    m = fit.items_of(phi, d)
    regional, country, wt = _parts(cells, places, weights, d)
    plain = fit.slot_sums(regional, alpha, phi, d)
    items = frame(spark, question=[str(j + 1) for j in range(3)], gamma=m["gamma"], kmin1=[int(k) for k in d.kmin1])
    at = [(str(j + 1), k + 1, float(m["beta"][j, k])) for j in range(3) for k in range(d.kmin1[j])]
    cuts = spark.createDataFrame(at, "question string, k int, beta double")
    scores = spark.createDataFrame([(u + 1, t + 1, float(v)) for (u, t), v in np.ndenumerate(alpha)], "regioncode_int int, year_int int, mean double")
    named = cells.withColumn("question", F.col("question_int").cast("string"))
    on = ["regioncode_int", "year_int"]
    assert S.ordinal_loglik(named, scores, "mean", on, items, cuts).first().loglik == pytest.approx(plain["ll"], rel=1e-10)
    slopes = fit.cell_gradient(named, scores, "mean", on, items, cuts)
    got = {tuple(r[c] for c in on): r for r in fit.score_gradient(named, scores, "mean", on, items, cuts).collect()}
    assert all(got[u + 1, t + 1].d_score == pytest.approx(v, rel=1e-8, abs=1e-8) for (u, t), v in np.ndenumerate(plain["g"]))
    by_item = {(r.question, r.k): r.slope for r in fit.item_gradient(slopes).collect()}
    assert [by_item[str(j + 1), None] for j in range(3)] == pytest.approx(plain["item"][:3].tolist(), rel=1e-8)
    flat = plain["item"][3:].reshape(3, -1)
    assert all(by_item[q, k] == pytest.approx(flat[int(q) - 1, k - 1], rel=1e-8) for q, k in by_item if k)
    assert sum(k is not None for _, k in by_item) == d.kmin1.sum()


def test_cell_probabilities_sum_to_one_and_do_not_underflow(spark):
    items = frame(spark, question=["q"], gamma=[1.5], kmin1=[3])
    cuts = frame(spark, question=["q"] * 3, k=[1, 2, 3], beta=[-1.0, 0.2, 0.9])
    cells = frame(spark, question=["q"] * 4, option=[1, 2, 3, 4], yes=[1] * 4, u=[1] * 4)
    for score in (0.3, 60.0, -700.0):
        scores = frame(spark, u=[1], mean=[score])
        ll = [r.ll for r in S.cell_probabilities(cells, scores, "mean", ["u"], items, cuts).collect()]
        assert np.all(np.isfinite(ll)) and np.exp(ll).sum() == pytest.approx(1.0)


def test_item_identities(spark):
    raw = frame(spark, question=["a", "a", "a", "a", "b", "b", "b", "b"], k=[1, 2, 3, 4] * 2, beta_raw=[0.5, 2, 3, 4.4, 1, 2.5, 103, 104])
    limits = frame(spark, question=["a", "b"], kmin1=[4, 2])
    beta = S.centre_cutpoints(raw, limits).where("used").toPandas()
    assert beta.groupby("question")["beta"].mean().mean() == pytest.approx(0.0)
    gamma = S.scale_discrimination(frame(spark, question=["a", "b"], gamma_raw=[0.5, 3.0])).toPandas()
    assert gamma["gamma"].prod() == pytest.approx(1.0)


def test_one_region_country_keeps_its_score(spark):
    pop = frame(spark, iso_3166=["A", "B", "B"], mergekey=["a", "b1", "b2"], n=[7, 1, 3])
    weights = I.region_weights(pop, "iso_3166", "mergekey", "n")
    scores = frame(spark, iso_3166=["A", "B", "B"], mergekey=["a", "b1", "b2"], year_int=[1] * 3, x=[0.3, 1.0, 2.0])
    got = {r[0]: r[2] for r in S.poststratify(scores, weights, "x").collect()}
    assert got == {"A": pytest.approx(0.3), "B": pytest.approx(1.75)}


def test_eigenvalues_and_factors(spark):
    rng = np.random.default_rng(12)
    common = rng.normal(size=(400, 2))
    x = np.column_stack([common[:, i // 4] + rng.normal(size=400) * 0.5 + 3 for i in range(6)] + [rng.normal(size=400) - 9])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdefg")))
    scaled, kept = N.screen_items(df, list("abcdefg"))
    assert kept == list("abcdef")
    values = N.eigenvalues(scaled, kept)
    assert np.allclose(values, np.linalg.eigvalsh(np.corrcoef(x[:, :6].T))[::-1])
    assert sum(values) == pytest.approx(6)
    chance = N.parallel_analysis(spark, 400, 6, reps=60)
    row = N.n_factors(N.eigen_table(spark, values), chance).first()
    assert (row.kaiser, row.parallel, row.optimal_coordinates, row.acceleration) == (2, 2, 2, 2)


def test_parallel_analysis_has_the_distribution_of_random_tables(spark):
    n, p, reps = 50, 5, 400
    got = {r["rank"]: r for r in N.parallel_analysis(spark, n, p, reps=reps, seed=2).collect()}
    rng = np.random.default_rng(13)
    direct = np.array([np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(n, p)).T))[::-1] for _ in range(reps)])
    for i in range(p):
        assert got[i + 1].parallel_mean == pytest.approx(direct[:, i].mean(), abs=0.03)
        assert got[i + 1].parallel == pytest.approx(np.quantile(direct[:, i], 0.05), abs=0.05)
    again = {r["rank"]: r for r in N.parallel_analysis(spark, n, p, reps=reps, seed=2).collect()}
    assert all(again[k].parallel == got[k].parallel for k in got)


def test_permuted_columns_have_the_distribution_of_random_tables(spark):
    rng = np.random.default_rng(3)
    n, p = 300, 5
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, p)) + rng.normal(size=(n, p)) * 0.5  # far from independent
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"c{i} double" for i in range(p)))
    got = {r["rank"]: r for r in N.permuted_analysis(df, df.columns, reps=200).collect()}
    direct = np.array([np.linalg.eigvalsh(np.corrcoef(rng.permuted(x, axis=0), rowvar=False))[::-1] for _ in range(400)])
    for i in range(p):
        assert got[i + 1].parallel_mean == pytest.approx(direct[:, i].mean(), abs=0.02)
        assert got[i + 1].parallel == pytest.approx(np.quantile(direct[:, i], 0.05), abs=0.04)
    blocked = {r["rank"]: r for r in N.permuted_analysis(df, df.columns, reps=100, block=50).collect()}
    assert blocked[1].parallel_mean == pytest.approx(direct[:, 0].mean(), abs=0.05)


def test_permuted_columns_of_few_rows_and_constants(spark):
    rows = [(float(i), float(i % 2), 1.0, float(-i), float(i * i)) for i in range(4)]  # fewer rows than columns
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = N.permuted_analysis(df, df.columns, reps=20).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]  # the constant has no part
    assert sum(r.parallel_mean for r in got) == pytest.approx(4)
    assert N.permuted_analysis(df.limit(0), df.columns, reps=3).collect() == []
