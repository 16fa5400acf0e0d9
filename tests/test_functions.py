import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q

SLOT = 1_736_424_300_000


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_microprice_and_quotes(spark):
    q = [F.lit(float(x)) for x in (100, 1, 102, 3)]
    none = [F.lit(float(x)) for x in (100, 0, 102, 0)]
    row = one(spark, Q.microprice(*q), Q.microprice(*none), Q.microprice(*none, or_mid=True), Q.valid_quote(*q), Q.valid_quote(*none), Q.valid_quote(q[0], q[1], F.lit(None).cast("double"), q[3]))
    assert tuple(row) == (100.5, None, 101.0, True, False, False)


@pytest.mark.parametrize(("price", "expected"), [(40.25, False), (39.75, False), (40.3, True), (39.0, True), (40.0, False)])
def test_moved(spark, price, expected):
    assert one(spark, Q.moved(F.lit(price), F.lit(40.0), F.lit(0.25)))[0] is expected


@pytest.mark.parametrize(("into", "slot"), [(10_249, None), (10_250, SLOT), (14_249, SLOT), (14_250, None)])
def test_event_slot(spark, into, slot):
    assert one(spark, Q.event_slot(F.lit(SLOT + into), clock=20_000, opens=10_250, length=4_000))[0] == slot


def test_clocks(spark):
    row = one(spark, Q.next_slot(F.lit(SLOT + 1), clock=20_000), Q.next_slot(F.lit(SLOT), clock=20_000), Q.to_ms(F.lit(1_736_424_305_125_000)), Q.to_ms(F.lit(1_736_424_305_125)), Q.season_slot(F.lit(4 * 86_400_000)), Q.season_slot(F.lit(9 * 86_400_000)), Q.ms_to_utc(F.lit(1)))
    assert tuple(row) == (SLOT + 20_000, SLOT, 1_736_424_305_125, 1_736_424_305_125, 0, 720, "1970-01-01T00:00:00.001+00:00")


def test_tick_size(spark):
    info = '{"filters":[{"filterType":"LOT_SIZE"},{"filterType":"PRICE_FILTER","tickSize":"0.05"}]}'
    df = spark.createDataFrame([(info, 0.1), ("{}", 0.1), (None, 0.1)], "info string, own double")
    assert [r[0] for r in df.select(Q.tick_size("info", "own")).collect()] == [0.05, 0.1, 0.1]


def test_crps(spark):
    q = F.array(*[F.lit(11.0)] * 100)
    row = one(spark, L.pinball_crps(q, F.lit(10.0)), L.pinball_crps(q, F.lit(11.0)), F.size(L.violations(q)))
    assert row[0] == pytest.approx(1.0) and row[1] == 0 and row[2] == 0


def test_violations(spark):
    good = [1.0 + i for i in range(100)]
    rows = [(good,), (good[:99],), ([-1.0, *good[1:]],), ([*good[:50], 1.0, *good[51:]],), ([float("nan"), *good[1:]],), (None,)]
    df = spark.createDataFrame(rows, "q array<double>")
    assert [r[0] for r in df.select(L.violations(F.col("q"))).collect()] == [[], ["length"], ["not_positive"], ["decreasing"], ["not_finite"], ["missing"]]


def test_mirrored_bins(spark):
    bins = F.array(*[F.lit(0.0)] * 30, *[F.lit(0.002)] * 20)
    got = one(spark, L.mirrored(bins, F.lit(100.0), F.lit(0.0)))[0]
    assert got == sorted(got) and sum(v == 100.0 for v in got) == 60


def test_point_mass_and_sanitize(spark):
    q = [100_000 + 1.5 + 4 * (i - 49.5) / 25 for i in range(100)]
    df = spark.createDataFrame([(q, 100_000.0, 0.3), (q, 100_000.0, 0.0)], "q array<double>, p double, m double")
    a, b = [r[0] for r in df.select(L.with_point_mass(F.col("q"), F.col("p"), F.col("m"))).collect()]
    assert a == sorted(a) and 29 <= sum(v == 100_000.0 for v in a) <= 31 and b == pytest.approx(q)
    messy = spark.createDataFrame([([float("nan"), 5.0, 4.0, *[6.0] * 97],)], "q array<double>")
    s = messy.select(L.sanitized(F.col("q"))).first()[0]
    assert all(x < y for x, y in zip(s, s[1:], strict=False)) and s[0] > 0


def test_mixture_of_equal_ladders_is_the_ladder(spark):
    q = [float(i) for i in range(1, 101)]
    df = spark.createDataFrame([(q, q, 0.3)], "a array<double>, b array<double>, w double")
    assert df.select(L.mixed(F.col("a"), F.col("b"), F.col("w"))).first()[0] == q


def test_robust_z_and_logistic(spark):
    row = one(spark, Q.robust_z(F.lit(100.0), F.lit(0.0), F.lit(1.0)), Q.robust_z(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)), Q.logistic(0.0, [F.lit(0.0)], [1.0]))
    assert tuple(row) == (2.0, 0.0, 0.5)


def test_mixture_quantiles():
    z = np.array(L.mixture_z())
    cdf = lambda x, b: np.where(x < 0, 0.5 * np.exp(x / b), 1 - 0.5 * np.exp(-x / b))
    assert np.allclose(0.85 * cdf(z, 1.0) + 0.15 * cdf(z, 3.0), L.GRID, atol=1e-12) and (np.diff(z) > 0).all()
    assert np.allclose(L.mixture_z(share=0.0), L.laplace_z())


def test_still_mixtures_against_a_fine_mixture():
    """A million draws' worth of levels of the reshaped ladder beside the point, against the inverted lines."""
    rng = np.random.default_rng(6)
    for mass, widen, shift, hole in ((0.3, 0.5, 0.4, 0.2), (0.05, 0.0, 0.0, 0.0), (0.8, 0.2, 0.0, 1.0)):
        x = np.sort(100 + rng.normal(0, 1, (4, L.N)), axis=1)
        price = np.array([100.0, 99.5, 90.0, 120.0])
        width = np.abs(x - 0.5 * (x[:, 49:50] + x[:, 50:51])).mean(1)
        got = L.still_rows(x, price, np.full(4, mass), width, widen=widen, shift=shift, hole=hole)
        for row, px, w, out in zip(x, price, width, got, strict=True):
            middle = 0.5 * (row[49] + row[50])
            off = shift * mass / (1 - mass) * (middle - px)
            r = row + off + widen * mass * (row - middle)
            if hole:
                d = np.abs(r - px)
                r = px + np.sign(r - px) * (d + hole * w * (1 - np.exp(-d / (hole * w))))
            fine = np.interp((np.arange(200_000) + 0.5) / 200_000, L.GRID, r)
            both = np.sort(np.concatenate([fine, np.full(round(200_000 * mass / (1 - mass)), px)]))
            want = both[(np.array(L.GRID) * len(both)).astype(int)]
            assert np.abs(out - want).max() < 2e-3 and (np.diff(out) >= 0).all()
            if 95 < px < 105:
                assert abs((out == px).mean() - mass) <= 0.011


def test_robust_z_kinds(spark):
    nan, inf, one_ = float("nan"), float("inf"), F.lit(1.0)
    of = lambda v, kind, **k: Q.robust_z(F.lit(v).cast("double"), F.lit(1.0), F.lit(2.0), kind=kind, **k)
    row = one(spark, of(3.0, "robust"), of(100.0, "robust"), of(nan, "robust"), of(nan, "raw"), of(inf, "raw"), of(None, "raw"), of(-0.5, "raw"))
    assert tuple(row) == (pytest.approx(1 / 3), 2.0, 0.0, 0.0, 0.0, 0.0, -0.5)
    row = one(spark, of(np.e**2 - 1, "log1p"), of(np.e**3 * 2, "log_width", width=F.lit(2.0)), of(-1.0, "log_width", width=one_), of(1.0, "log_width", width=F.lit(0.0)), Q.robust_z(one_, one_, F.lit(0.0)))
    assert tuple(row) == (pytest.approx(1 / 6), pytest.approx(1 / 3), -2.0, 0.0, 0.0)
