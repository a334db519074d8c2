from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from spanloom.functions.inference import half_beta, normal_quantile, normal_upper_tail
from spanloom.operators import correlation

# Published (r, n, p) of correlations over four programs.
GOLDEN_P = [
    (0.06180206788263344, 1547, 0.01505084262292635),
    (-0.041414883499748374, 1547, 0.10345941676792568),
    (0.5111556259383718, 108, 1.5791421262146113e-08),
    (0.5427420046300265, 108, 1.2960092574081734e-09),
    (0.38185220924674124, 565, 4.7058009867440966e-21),
    (0.3361090689169023, 565, 2.1822399747153355e-16),
    (0.19212765455979833, 2615, 3.6685176856214975e-23),
    (0.1754268167365156, 2615, 1.6149307201620307e-19),
]

# Published K2 statistics and their p-values.
GOLDEN_K2 = [
    (686.0929222487639, 1.039477030853572e-149),
    (9.355220420457677, 0.009301215297323891),
    (38.165102825670346, 5.158853805549022e-09),
    (79.94298539220037, 4.371206149576158e-18),
    (300.54108778696127, 5.474342866559609e-66),
    (640.2532488311584, 9.349179669668028e-140),
]


def test_p_values(spark):
    df = spark.createDataFrame([(r, n) for r, n, _ in GOLDEN_P], "r double, n long")
    got = {row["r"]: row["p_value"] for row in correlation.with_p_value(df).collect()}
    for r, _, p in GOLDEN_P:
        assert got[r] == pytest.approx(p, rel=1e-9)


def test_p_value_limits(spark):
    df = spark.createDataFrame([(1.0, 9), (0.0, 9), (0.5, 2)], "r double, n long")
    got = {row["r"]: row["p_value"] for row in correlation.with_p_value(df).collect()}
    assert got == {1.0: 0.0, 0.0: pytest.approx(1.0), 0.5: None}


def test_k2_tail():
    for k2, p in GOLDEN_K2:
        assert math.exp(-k2 / 2) == pytest.approx(p, rel=1e-12)


def test_incomplete_beta(spark):
    """Student's t with 1, 2 and 4 degrees of freedom has closed forms; 10 has a table."""
    def t_tail(t, df):
        s = math.sqrt(t * t + df)
        if df == 1:
            return 1 - 2 * math.atan(t) / math.pi
        if df == 2:
            return 1 - t / s
        return 1 - t / s * (1 + 2 / (t * t + 4))

    cases = [(t, df) for t in (0.01, 0.5, 1.0, 3.0, 40.0) for df in (1, 2, 4)]
    rows = [(t, df, df / 2, df / (df + t * t), t * t / (df + t * t)) for t, df in [*cases, (2.228138852, 10)]]
    df = spark.createDataFrame(rows, "t double, df long, a double, x double, rest double")
    got = {(r["t"], r["df"]): r["p"] for r in df.withColumn("p", half_beta(F.col("a"), F.col("x"), F.col("rest"))).collect()}
    for case in cases:
        assert got[case] == pytest.approx(t_tail(*case), rel=1e-7, abs=1e-13)
    assert got[2.228138852, 10] == pytest.approx(0.05, rel=1e-7)


def test_normal_tail(spark):
    zs = [-40.0, -5.0, -2.5, -0.3, 0.0, 1e-9, 0.7, 2.49, 2.5, 2.51, 6.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = {r["z"]: r["q"] for r in df.withColumn("q", normal_upper_tail(F.col("z"))).collect()}
    for z in zs:
        assert got[z] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-11)


def test_many_pairs(spark):
    """Tails over a million pairs, against the normal limit."""
    n = 1_000_000
    df = spark.createDataFrame([(z / math.sqrt(n), n) for z in (0.1, 1.0, 2.0, 3.0)], "r double, n long")
    for row in correlation.with_p_value(df).collect():
        assert row["p_value"] == pytest.approx(math.erfc(row["r"] * math.sqrt(n / 2)), rel=1e-4)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.07, 0.08, 0.3, 0.5, 0.9, 0.95, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = {r["p"]: r["q"] for r in df.withColumn("q", normal_quantile(F.col("p"))).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)


def test_shapiro_textbook(spark):
    """Weights of eleven men, the example of Shapiro and Wilk's paper."""
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("m", float(w), i) for i, w in enumerate(weights)], "g string, x double, i int")
    row = correlation.shapiro_wilk(df, ["g"], "x", "i").head()
    assert row["w"] == pytest.approx(0.7888, abs=1e-3)
    assert row["w_p"] == pytest.approx(0.0067, abs=2e-4)
    assert row["w_normal"] is False


@pytest.mark.parametrize("n", [3, 4, 5, 6, 12, 200])
def test_shapiro_accepts_normal_scores(spark, n):
    scores = [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]
    df = spark.createDataFrame([("g", s, i) for i, s in enumerate(scores)], "g string, x double, i int")
    whole = correlation.shapiro_wilk(df, ["g"], "x", "i").head()
    cut = correlation.shapiro_wilk(df, ["g"], "x", "i", slices=2).head()
    assert whole["w"] > 0.95 and whole["w_p"] > 0.5 and whole["w_normal"]
    assert cut["w"] == pytest.approx(whole["w"])


def test_verdict_reasons(spark):
    nan = float("nan")
    data = [("few", 1.0), ("few", 2.0)] + [("bad", x) for x in (1.0, 2.0, nan, nan)]
    data += [("flat", float(x)) for x in [0] * 30 + [100]]
    df = spark.createDataFrame([(g, x, i) for i, (g, x) in enumerate(data)], "g string, x double, i int")
    got = {r["g"]: (r["is_normal"], r["reason"]) for r in correlation.normality_verdict(df, ["g"], "x", "i").collect()}
    assert got == {
        "few": (False, "insufficient_data"),
        "bad": (False, "insufficient_valid_data"),
        "flat": (False, None),
    }


def test_spearman_shares_ranks(spark):
    rng = random.Random(3)
    data = [("g", rng.randrange(6), rng.randrange(6)) for _ in range(80)]

    def mean_ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    a, b = mean_ranks([d[1] for d in data]), mean_ranks([d[2] for d in data])
    ma, mb = sum(a) / 80, sum(b) / 80
    top = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    expected = top / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    df = spark.createDataFrame(data, "g string, a int, b int")
    for cut in (None, 2):
        got = correlation.spearman(df, ["g"], "a", "b", slices=cut).head()
        assert got["r"] == pytest.approx(expected)
