"""Drift and group tests against brute force, known tail values and edge cases."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from plantgauge.functions import tails
from plantgauge.operators import drift, samples


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- tails ---------------------------------------------------------------------------


@pytest.mark.parametrize("x,dof,p", [(3.841458821, 1, 0.05), (18.30703805, 10, 0.05), (124.3421134, 100, 0.05), (2.0, 2, math.exp(-1)), (10.0, 4, 6 * math.exp(-5)), (1100.0, 1000, math.fsum(math.exp(-550 + k * math.log(550) - math.lgamma(k + 1)) for k in range(500)))])
def test_chi2_tail(spark, x, dof, p):
    assert value(spark, tails.chi2_upper(F.lit(x), F.lit(dof))) == pytest.approx(p, rel=1e-7)


@pytest.mark.parametrize("f,a,b,p", [(4.964602744, 1, 10, 0.05), (3.325834530, 5, 10, 0.05), (1.0, 5, 5, 0.5), (2.0, 2, 8, (1 + 0.5) ** -4)])
def test_f_tail(spark, f, a, b, p):
    assert value(spark, tails.f_upper(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(p, rel=1e-7)


def test_missing_tails(spark):
    none = F.lit(None).cast("double")
    assert value(spark, tails.chi2_upper(none, F.lit(3))) == 1.0 and value(spark, tails.chi2_upper(F.lit(5.0), F.lit(0))) == 1.0
    assert value(spark, tails.f_upper(none, F.lit(3), F.lit(3))) == 1.0
    assert value(spark, tails.f_upper(F.lit(float("inf")), F.lit(3), F.lit(3))) == 0.0


@pytest.mark.parametrize("lam,q", [(1.3580986, 0.05), (1.2238478, 0.10), (0.5, 0.9639452), (0.8275735, 0.5), (1.6276236, 0.01)])
def test_kolmogorov_tail(spark, lam, q):
    n = 10**9  # the correction vanishes
    root = math.sqrt(n / 2)
    gap = lam / (root + 0.12 + 0.11 / root)
    assert value(spark, tails.kolmogorov_upper(F.lit(gap), F.lit(n), F.lit(n))) == pytest.approx(q, rel=1e-5)
    assert value(spark, tails.kolmogorov_upper(F.lit(0.0), F.lit(5), F.lit(5))) == 1.0


# --- drift ---------------------------------------------------------------------------


def brute_gap(a, b):
    best = max((round(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)), 12), -v) for v in a + b)
    return best[0], -best[1]


def series(seed, periods=("2024-01-01", "2024-01-08", "2024-01-22"), n=120):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", "hot"):
        for i, p in enumerate(periods):
            for _ in range(rng.randint(n // 2, n)):
                x = 7.0 if key == "hot" and rng.random() < 0.6 else round(rng.gauss(i, 2), 1)
                rows.append((key, p, x))
    return rows


def test_ks_brute(spark):
    rows = series(1) + [("lone", "2024-01-01", 1.0)]
    out = drift.ks_between_periods(spark.createDataFrame(rows, "k string, period string, x double"), ["k"]).collect()
    held = collections.defaultdict(list)
    for k, p, x in rows:
        held[k, p].append(x)
    assert {r["k"] for r in out} == {"a", "b", "hot"} and len(out) == 6
    for r in out:
        a, b = held[r["k"], r["earlier"]], held[r["k"], r["later"]]
        gap, at = brute_gap(a, b)
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        assert r["gap"] == pytest.approx(gap, abs=1e-9) and r["widest_at"] == at and 0 <= r["p"] <= 1


def test_ks_equal_and_disjoint(spark):
    same = [("k", p, float(x)) for p in ("1", "2") for x in range(50)]
    apart = [("m", "1", float(x)) for x in range(50)] + [("m", "2", 100.0 + x) for x in range(50)]
    out = {r["k"]: r for r in drift.ks_between_periods(spark.createDataFrame(same + apart, "k string, period string, x double"), ["k"]).collect()}
    assert out["k"]["gap"] == 0 and out["k"]["p"] == 1
    assert out["m"]["gap"] == 1 and out["m"]["p"] < 1e-12 and out["m"]["widest_at"] == 49
    assert drift.ks_between_periods(spark.createDataFrame([], "k string, period string, x double"), ["k"]).collect() == []


def test_period_values_skip_gaps(spark):
    rows = spark.createDataFrame(
        [("2024-01-03 05:00:00", 1.0, None), (None, 2.0, 3.0), ("2024-01-09 00:00:00", float("nan"), 4.0)], "timestamp string, a double, b double"
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    got = {(r["parameter"], str(r["period"])[:10], r["x"]) for r in drift.period_values(rows, ["a", "b"]).collect()}
    assert got == {("a", "2024-01-01", 1.0), ("b", "2024-01-08", 4.0)}


def brute_profile(xs, bins=10):
    xs = sorted(xs)
    edges = []
    for i in range(1, bins):
        at = (len(xs) - 1) * (i / bins)
        lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
        edges.append(round(lo + (hi - lo) * (at - math.floor(at)), 9))
    edges = sorted(set(edges))
    return edges


def shares(edges, xs):
    counts = collections.Counter(sum(e < x for e in edges) for x in xs)
    return [counts[i] / len(xs) for i in range(len(edges) + 1)]


def test_profile_and_index(spark):
    rows = series(2)
    df = spark.createDataFrame(rows, "k string, period string, x double")
    profile = drift.distribution_profile(df.where("period = '2024-01-01'"), ["k"])
    held = collections.defaultdict(list)
    for k, p, x in rows:
        held[k, p].append(x)
    known = {r["k"]: r for r in profile.collect()}
    for k, r in known.items():
        first = held[k, "2024-01-01"]
        assert r["edges"] == pytest.approx(brute_profile(first)) and r["n"] == len(first)
        assert r["shares"] == pytest.approx(shares(r["edges"], first))
    assert len(known["hot"]["edges"]) < 9  # equal edges are one
    for r in drift.stability_index(profile, df, ["k"], ["period"]).collect():
        p = known[r["k"]]["shares"]
        q = shares(known[r["k"]]["edges"], held[r["k"], r["period"]])
        want = sum((max(b, 1e-4) - max(a, 1e-4)) * math.log(max(b, 1e-4) / max(a, 1e-4)) for a, b in zip(p, q))
        assert r["psi"] == pytest.approx(want) and r["empty_bins"] == sum(b == 0 for b in q)
        if r["period"] == "2024-01-01":
            assert r["psi"] == pytest.approx(0)


def test_profile_of_one_value_and_none(spark):
    one = spark.createDataFrame([("k", "1", 5.0)] * 4 + [("k", "2", 9.0)] * 4, "k string, period string, x double")
    profile = drift.distribution_profile(one.where("period = '1'"), ["k"])
    assert [(r["edges"], r["shares"]) for r in profile.collect()] == [([5.0], [1.0, 0.0])]
    psi = {r["period"]: r["psi"] for r in drift.stability_index(profile, one, ["k"], ["period"]).collect()}
    assert psi["1"] == 0 and psi["2"] == pytest.approx(2 * (1 - 1e-4) * math.log(1e4))
    empty = one.where("false")
    assert drift.distribution_profile(empty, ["k"]).collect() == []
    assert drift.stability_index(profile, empty, ["k"], ["period"]).collect() == []


# --- groups --------------------------------------------------------------------------


def brute_chi(rows):
    cells = collections.Counter(rows)
    a, b = collections.Counter(r[0] for r in rows), collections.Counter(r[1] for r in rows)
    return sum((cells[x, y] - a[x] * b[y] / len(rows)) ** 2 / (a[x] * b[y] / len(rows)) for x in a for y in b), (len(a) - 1) * (len(b) - 1), min(len(a), len(b)) - 1


def test_chi_square(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("abcde"), rng.choice("xyz") if k == "one" else rng.choice("xxxyz")) for k in ("one", "two") for _ in range(300)]
    rows += [("one", "rare", "z")]
    df = spark.createDataFrame(rows + [("one", None, "x"), ("one", "a", None)], "k string, a string, b string")
    for r in samples.chi_square(df, "a", "b", ["k"]).collect():
        own = [(a, b) for k, a, b in rows if k == r["k"]]
        stat, dof, side = brute_chi(own)
        assert r["statistic"] == pytest.approx(stat) and r["dof"] == dof and r["n"] == len(own)
        assert r["cramers_v"] == pytest.approx(math.sqrt(stat / len(own) / side)) and 0 < r["p"] <= 1
    whole = samples.chi_square(df, "a", "b").collect()
    assert len(whole) == 1 and whole[0]["statistic"] == pytest.approx(brute_chi([r[1:] for r in rows])[0])


def test_chi_square_known(spark):
    rows = [("m", "y")] * 10 + [("m", "n")] * 20 + [("f", "y")] * 20 + [("f", "n")] * 10
    r = samples.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r["statistic"] == pytest.approx(20 / 3) and r["p"] == pytest.approx(0.009823275, rel=1e-6)


def test_chi_square_degenerate(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "a string, b string")
    r = samples.chi_square(df, "a", "b").first()
    assert (r["n"], r["statistic"], r["dof"], r["cramers_v"], r["p"]) == (2, 0.0, 0, 0.0, 1.0)
    assert samples.chi_square(df.where("false"), "a", "b").collect() == []
    assert samples.chi_square(df.where("false"), "a", "b", ["a"]).collect() == []


def grouped(seed):
    rng = random.Random(seed)
    return [(k, g, float(round(rng.gauss(i * (k == "two"), 2), 1))) for k in ("one", "two") for i, g in enumerate("pqrs") for _ in range(rng.randint(20, 60))]


def brute_kruskal(rows):
    xs = sorted(x for _, x in rows)
    place = collections.defaultdict(list)
    for i, x in enumerate(xs):
        place[x].append(i + 1)
    n, sums, sizes = len(xs), collections.Counter(), collections.Counter()
    for g, x in rows:
        sums[g] += sum(place[x]) / len(place[x])
        sizes[g] += 1
    h = 12 / (n * (n + 1)) * sum(sums[g] ** 2 / sizes[g] for g in sizes) - 3 * (n + 1)
    return h / (1 - sum(len(p) ** 3 - len(p) for p in place.values()) / (n**3 - n)), len(sizes) - 1


def test_kruskal(spark):
    rows = grouped(5)
    df = spark.createDataFrame(rows + [("one", None, 4.0), ("one", "p", None), ("one", "p", float("nan"))], "k string, g string, x double")
    out = {r["k"]: r for r in samples.kruskal_wallis(df, ["k"], "g", "x").collect()}
    for k, r in out.items():
        h, dof = brute_kruskal([r[1:] for r in rows if r[0] == k])
        assert r["h"] == pytest.approx(h) and r["dof"] == dof
    assert out["two"]["p"] < 1e-3 < out["one"]["p"] + 1


def test_anova(spark):
    rows = [(k, g, x + 1e7) for k, g, x in grouped(6)]
    df = spark.createDataFrame(rows + [("one", None, 4.0)], "k string, g string, x double")
    for r in samples.anova(df, ["k"], "g", "x").collect():
        own = collections.defaultdict(list)
        for k, g, x in rows:
            if k == r["k"]:
                own[g].append(x - 1e7)
        every = [x for xs in own.values() for x in xs]
        mean = sum(every) / len(every)
        between = sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in own.values())
        within = sum((x - sum(v) / len(v)) ** 2 for v in own.values() for x in v)
        assert r["f"] == pytest.approx(between / 3 / (within / (len(every) - 4)), rel=1e-5)
        assert r["eta_squared"] == pytest.approx(between / (between + within), rel=1e-5)


def test_groups_degenerate(spark):
    def run(rows):
        df = spark.createDataFrame([("k", *r) for r in rows], "k string, g string, x double")
        return samples.kruskal_wallis(df, ["k"], "g", "x").collect(), samples.anova(df, ["k"], "g", "x").collect()

    k, a = run([("p", 1.0), ("p", 2.0)])
    assert (k[0]["h"], k[0]["p"]) == (0.0, 1.0) and a[0]["f"] is None and a[0]["p"] == 1.0
    k, a = run([("p", 1.0), ("q", 2.0)])
    assert a[0]["f"] is None and k[0]["h"] == pytest.approx(1.0)
    k, a = run([("p", 3.0)] * 3 + [("q", 3.0)] * 3)
    assert (k[0]["h"], k[0]["p"], a[0]["f"], a[0]["p"]) == (0.0, 1.0, 0.0, 1.0)
    k, a = run([("p", 3.0)] * 3 + [("q", 4.0)] * 3)
    assert a[0]["f"] == float("inf") and a[0]["p"] == 0.0
    k, a = run([("p", 3.0)])
    assert k[0]["h"] == 0.0 and a[0]["f"] is None
    assert run([]) == ([], [])


def brute_u_tail(u, n1, n2):
    """Twice the share of arrangements with U of at least u."""
    ways = {(0, j): {0: 1} for j in range(n2 + 1)} | {(i, 0): {0: 1} for i in range(n1 + 1)}
    for i in range(1, n1 + 1):
        for j in range(1, n2 + 1):
            out = collections.Counter()
            for k, w in ways[i - 1, j].items():
                out[k + j] += w
            for k, w in ways[i, j - 1].items():
                out[k] += w
            ways[i, j] = out
    return min(1.0, 2 * sum(w for k, w in ways[n1, n2].items() if k >= u) / math.comb(n1 + n2, n1))


@pytest.mark.parametrize("u,n1,n2", [(12, 3, 5), (20, 5, 4), (40, 8, 8), (150, 8, 25), (150, 25, 8), (9, 2, 7)])
def test_exact_mann_whitney(spark, u, n1, n2):
    high = max(u, n1 * n2 - u)
    got = value(spark, tails.u_two_sided(F.lit(u), F.lit(n1), F.lit(n2), F.lit(0)))
    assert got == pytest.approx(brute_u_tail(high, n1, n2), rel=1e-9)


def test_exact_mann_whitney_of_a_long_side(spark):
    n1, n2 = 8, 10_000
    for z in (0.5, 1.5, 2.5):
        u = n1 * n2 / 2 + z * math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
        got = value(spark, tails.u_two_sided(F.lit(math.floor(u)), F.lit(n1), F.lit(n2), F.lit(0)))
        assert got == pytest.approx(math.erfc(z / math.sqrt(2)), abs=0.02)
