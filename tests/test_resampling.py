"""Resampling and regression against plain loops and numpy with every dummy spelled out."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.operators.inference import block_bootstrap, tie_averaged_spread
from tidemark.operators.regression import panel_regression
from tidemark.operators.resampling import FIELD, bootstrap_correlations, date_bootstrap, permutation_p_values


def polynomial(seed, sample):
    digest = hashlib.sha256(f"{seed}|{sample}".encode()).hexdigest()
    c = [int(digest[12 * k:12 * k + 12], 16) % FIELD for k in range(4)]
    return lambda x: (((c[3] * x + c[2]) * x + c[1]) * x + c[0]) % FIELD


def ranks(values):
    v = np.asarray(values)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def rho(x, y):
    a, b = ranks(x), ranks(y)
    return np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [("g", f"{k:02}", rng.choice([1.0, 2.0, 3.0]), rng.random(), float(k)) for k in range(12)]
    rows += [("flat", f"{k}", 1.0, float(k), float(k % 3)) for k in range(6)] + [("one", "0", 1.0, 2.0, 3.0), ("g", "null", None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "g string, k string, a double, b double, y double"), [r for r in rows if r[2] is not None]


def test_permutations(scored):
    df, rows = scored
    got = {(r["g"], r["label"]): r for r in permutation_p_values(df, ["a", "b"], "y", ["g"], "k", 50, "s").collect()}
    for g in ("g", "flat", "one"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        y = [r[4] for r in own]
        for label, at in (("a", 2), ("b", 3)):
            x = [r[at] for r in own]
            observed, beyond = rho(x, y), 0
            for s in range(50):
                p = polynomial("s", s)
                order = sorted(range(1, len(own) + 1), key=lambda i: (p(i), i))
                tried = rho([x[i - 1] for i in order], y)
                beyond += observed is not None and abs(tried) >= abs(observed) - 1e-12
            r = got[g, label]
            assert r["n"] == len(own) and r["p"] == pytest.approx((beyond + 1) / 51)
            assert r["ic"] == (None if observed is None else pytest.approx(observed))


def test_bootstraps(spark, scored):
    df, rows = scored
    got = {(r["g"], r["label"]): r for r in bootstrap_correlations(df, "a", "b", "y", ["g"], "k", 60, "s").collect()}
    own = sorted((r for r in rows if r[0] == "g"), key=lambda r: r[1])
    values = {"a": [], "b": [], "a_less_b": []}
    for s in range(60):
        p = polynomial("s", s)
        at = [p(j) % 12 for j in range(1, 13)]
        a, b = (rho([own[i][c] for i in at], [own[i][4] for i in at]) for c in (2, 3))
        if a is not None and b is not None:
            for k, v in (("a", a), ("b", b), ("a_less_b", a - b)):
                values[k].append(v)
    for k, v in values.items():
        r = got["g", k]
        assert r["valid"] == len(v) and [r["low"], r["high"]] == pytest.approx(list(np.quantile(v, [0.025, 0.975]))) and r["positive"] == pytest.approx(np.mean(np.array(v) > 0))
    assert ("flat", "a") not in got and ("one", "b") not in got
    dates = spark.createDataFrame([(k, float(k), 0.5 * k * k) for k in range(7)] + [(9, None, 1.0)], "d int, a double, b double")
    means = [np.mean([polynomial("s", s)(j) % 7 for j in range(1, 8)]) for s in range(40)]
    found = {r["label"]: r for r in date_bootstrap(dates, ["a", "b"], "d", 40, "s").collect()}
    assert set(found) == {"a", "b", "a_less_b"} and [found["a"]["low"], found["a"]["high"]] == pytest.approx(list(np.quantile(means, [0.025, 0.975])))


def test_block_bootstrap_and_drawn_ties(spark):
    v = [0.5, -1.0, 2.0, 0.25, 3.0, -0.5, 1.0]
    series = spark.createDataFrame([("m", k, x) for k, x in enumerate(v)] + [("s", 0, 2.0), ("m", 9, None)], "m string, k int, v double")
    means = []
    for r in range(80):
        drawn = [x for k in range(4) for s in [int(hashlib.sha256(f"b|{r}|{k}".encode()).hexdigest()[:13], 16) % 6] for x in v[s:s + 2]][:7]
        means.append(np.mean(drawn))
    got = {r["m"]: r for r in block_bootstrap(series, "v", "k", ["m"], 2, 80, "b").collect()}
    assert [got["m"]["low"], got["m"]["high"]] == pytest.approx(list(np.quantile(means, [0.025, 0.975]))) and got["s"]["low"] == got["s"]["high"] == 2.0
    rng = random.Random(3)
    rows = [("d", f"{k:02}", float(rng.choice([1, 1, 2, 3, 3])), rng.random()) for k in range(23)] + [("few", "a", 1.0, 1.0)] + [("same", f"{k}", 1.0, float(k)) for k in range(7)]
    spread = {r["d"]: (r["tail_n"], r["spread"]) for r in tie_averaged_spread(spark.createDataFrame(rows, "d string, k string, s double, y double"), "s", "y", ["d"], "k", 40, "t").collect()}
    for d in ("d", "same"):
        own = [r for r in rows if r[0] == d]
        t, want = len(own) // 5, []
        for s in range(40):
            order = sorted(own, key=lambda r: (r[2], hashlib.sha256(f"t|{s}|{r[1]}".encode()).hexdigest()))  # noqa: B023
            want.append(np.mean([r[3] for r in order[-t:]]) - np.mean([r[3] for r in order[:t]]))
        assert spread[d] == (t, pytest.approx(np.mean(want)))
    assert spread["few"] == (0, None)


@pytest.mark.parametrize("controls", [[], ["c1"], ["c1", "c2", "c3"]])
def test_regression_with_dummies(spark, controls):
    """Against a pseudo-inverse over a constant, all controls and a dummy for each period; the third control is the sum of the others."""
    rng = np.random.default_rng(1)
    rows = []
    for unit in range(15):
        for period in range(8):
            c1, c2 = rng.random(), rng.random()
            x = 0.4 * c1 + rng.random()
            rows.append((f"u{unit}", period, float(2 * x - c1 + 0.3 * period + rng.normal()), float(x), float(c1), float(c2), float(c1 + c2)))
    df = spark.createDataFrame([*rows, ("u0", 99, None, 1.0, 1.0, 1.0, 1.0)], "u string, p int, y double, x double, c1 double, c2 double, c3 double")
    got = panel_regression(df, "y", "x", controls, "u", "p").first()
    names = {"c1": 4, "c2": 5, "c3": 6}
    rest = np.column_stack([np.ones(len(rows)), *(np.array([r[names[c]] for r in rows]) for c in controls), *(np.array([float(r[1] == p) for r in rows]) for p in range(1, 8))])
    x, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    full = np.column_stack([x, rest])
    inverse = np.linalg.pinv(full.T @ full)
    beta = inverse @ full.T @ y
    error = y - full @ beta

    def meat(keys):
        sums = {}
        for k, row, e in zip(keys, full, error, strict=True):
            sums[k] = sums.get(k, 0) + row * e
        return sum(np.outer(s, s) for s in sums.values())

    cov = inverse @ (meat([r[0] for r in rows]) + meat([r[1] for r in rows]) - meat([r[:2] for r in rows])) @ inverse
    assert (got["n"], got["units"], got["periods"]) == (120, 15, 8)
    assert got["coefficient"] == pytest.approx(beta[0]) and got["se"] == pytest.approx(max(cov[0, 0], 0) ** 0.5)
    fitted = rest @ np.linalg.pinv(rest.T @ rest) @ rest.T @ x
    assert got["r_squared"] == pytest.approx(1 - ((x - fitted) ** 2).sum() / ((x - x.mean()) ** 2).sum() if controls else 0.0)


def test_regression_without_enough(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0), ("b", 1, 2.0, 1.0)], "u string, p int, y double, x double")
    assert panel_regression(df, "y", "x", [], "u", "p").first()["coefficient"] is None
    flat = spark.createDataFrame([(f"{k}", 1, float(k), 1.0) for k in range(5)], "u string, p int, y double, x double")
    row = panel_regression(flat, "y", "x", [], "u", "p").first()
    assert row["n"] == 5 and row["coefficient"] is None
    assert panel_regression(flat.limit(0), "y", "x", [], "u", "p").first()["n"] == 0


def _written(spark):
    """Rows written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_no_draw_becomes_a_row(spark):
    """Over 5,000 names and 1,000 samples a row a draw would be five million rows in a shuffle."""
    df = spark.range(5000).selectExpr("'g' g", "id k", "pmod(xxhash64(id), 997) / 7.0D a", "pmod(xxhash64(id, 1), 4999) * 1.0D b", "pmod(xxhash64(id, 2), 301) * 1.0D y")
    before = _written(spark)
    assert permutation_p_values(df, ["a", "b"], "y", ["g"], "k", 1000, "s").count() == 2
    assert {r["valid"] for r in bootstrap_correlations(df, "a", "b", "y", ["g"], "k", 1000, "s").collect()} == {1000}
    assert _written(spark) - before < 200_000


def test_large_groups_agree(spark, scored, monkeypatch):
    """Groups too large for one task go through shuffles, with the same results."""
    df, _ = scored
    both = lambda: [sorted(map(tuple, x.collect()), key=str) for x in (permutation_p_values(df, ["a", "b"], "y", ["g"], "k", 70, "s"), bootstrap_correlations(df, "a", "b", "y", ["g"], "k", 70, "s"))]
    near = both()
    monkeypatch.setattr("tidemark.operators.resampling.WIDE", 6)
    assert both() == near


def test_drawn_ties_make_no_rows(spark, monkeypatch):
    """2,000 names with two signals, over 500 simulations: a row a draw would be a million; large ties go through shuffles, with the same result."""
    df = spark.range(2000).selectExpr("'g' g", "cast(id as string) k", "cast(id % 2 as double) s", "if(id = 7, null, pmod(xxhash64(id), 101) / 8.0D) y")
    spread = lambda n: tie_averaged_spread(df, "s", "y", ["g"], "k", n, "t").first()
    before = _written(spark)
    assert spread(500)["tail_n"] == 400
    assert _written(spark) - before < 50_000
    near = spread(30)["spread"]
    monkeypatch.setattr("tidemark.operators.inference.WIDE", 10)
    assert spread(30)["spread"] == pytest.approx(near, abs=1e-12)
