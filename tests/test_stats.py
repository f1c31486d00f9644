import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import scale as M
from gridcast.operators import stats as S


@pytest.fixture
def table(spark):
    pdf = pd.DataFrame(
        {
            "a": [1.0, 2.0, None, 4.0, 5.5],
            "b": [2.0, 1.0, 3.0, float("nan"), 9.0],
            "flat": [7.0] * 5,
            "gone": [None] * 5,
        }
    ).astype(float)
    rows = [tuple(None if i == 2 and v != v else v for i, v in enumerate(r)) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "a double, b double, flat double, gone double")


def test_correlation_is_pairwise_complete(table):
    pdf, df = table
    want = pdf.corr()
    got = {(r["a"], r["b"]): r["r"] for r in S.correlation(df, list(pdf.columns)).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        if r is None:
            assert np.isnan(want.loc[a, b])
        else:
            assert r == pytest.approx(want.loc[a, b])
    assert {r["column"]: r["r"] is None for r in S.correlation_with(df, "a", ["a", "b", "flat"]).collect()} == {"b": False, "flat": True}


def test_correlation_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert S.correlation(df, ["a", "b"]).first()["r"] is None
    assert S.correlation(df.limit(0), ["a", "b"]).first()["r"] is None


def test_correlation_of_many_columns_is_one_scan(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 40)) + 1e5 * np.arange(40)
    x[draw.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 0.1
    x[150:, 8] = np.where(np.isnan(x[150:, 8]), np.nan, 3.3)
    x[:150, 9] = np.nan  # present only where column 8 is constant
    names = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)
    found = S.correlation(df, names)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    with np.errstate(all="ignore"):
        want = pd.DataFrame(x - np.nanmean(x, axis=0), columns=names).corr()  # large means would cost digits here
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    assert len(got) == 780 and got["c7", "c1" if ("c7", "c1") in got else "c10"] is None and got["c8", "c9"] is None
    for (a, b), r in got.items():
        if "c7" not in (a, b) and (a, b) != ("c8", "c9"):
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlation_by_group_equals_each_group(spark):
    rows = [(i % 3, float(i), float((i * 7) % 11), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, a double, b double, c double")
    grouped = {(r["g"], r["a"], r["b"]): r["r"] for r in S.correlation(df, ["a", "b", "c"], ["g"]).collect()}
    for g in range(3):
        for r in S.correlation(df.where(F.col("g") == g), ["a", "b", "c"]).collect():
            assert grouped[g, r["a"], r["b"]] == pytest.approx(r["r"], abs=1e-12)


@pytest.mark.parametrize(
    "low,high,width",
    [(0.1, 99.9, 5.0), (1, 1000, 50.0), (0.01, 490.02, 20.0), (0, 28, 1.0), (2, 61, 2.0), (5, 5, 5.0), (100, 100, 20.0)],
)
def test_round_bin_width(spark, low, high, width):
    got = spark.range(1).select(S.pretty_step(F.lit(float(low)), F.lit(float(high)), 30)).first()[0]
    assert got == pytest.approx(width)


def test_histogram_bins_are_closed_on_the_right(spark):
    values = [0.0, -3.0, 1.0, 2.0, 2.0, 2.5, 3.0, 30.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["bin_start"]: r["n"] for r in S.histogram(df, "x").collect()}
    assert got == {1.0: 3, 2.0: 2, 29.0: 1}


def test_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 1.0, 4.0])
    rows = [(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0), (3.0, float("nan"))]
    df = spark.createDataFrame(rows, "truth double, prediction double")
    r = S.error_metrics(df, capacity=10).first()
    assert r["n"] == 3
    assert r["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert r["mae"] == pytest.approx(np.abs(y - p).mean())
    assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["capacity_error"] == pytest.approx(r["mse"] / 10)


def test_r2_of_constant_truth(spark):
    exact = spark.createDataFrame([(2.0, 2.0)] * 2, "truth double, prediction double")
    wrong = spark.createDataFrame([(2.0, 3.0)] * 2, "truth double, prediction double")
    assert S.error_metrics(exact).first()["r2"] == 1.0
    assert S.error_metrics(wrong).first()["r2"] == 0.0
    assert S.error_metrics(wrong.limit(0)).first()["r2"] is None


def test_mape_leaves_out_zero_truth(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 1.0)], "truth double, prediction double")
    assert df.agg(S.mape(F.col("truth"), F.col("prediction"))).first()[0] == 50.0


def test_column_info_counts_nan_as_missing(table):
    _, df = table
    assert {r["column"]: r["n"] for r in S.column_info(df).collect()} == {"a": 4, "b": 4, "flat": 5, "gone": 0}


def test_scale_and_back(table):
    _, df = table
    columns = ["a", "b", "flat"]
    fit = M.fit_minmax(df, columns)
    scaled = M.minmax(df, fit, columns)
    flat = {r["flat"] for r in scaled.collect()}
    assert flat == {0.0}
    back = M.minmax_inverse(scaled, fit, {c: c for c in columns})
    for got, want in zip(back.collect(), df.collect()):
        for c in columns:
            assert (got[c] is None and want[c] is None) or got[c] == pytest.approx(want[c], nan_ok=True)


def test_fit_rows_and_series(spark):
    df = spark.createDataFrame(
        [("s", 0.0, True), ("s", 10.0, True), ("s", 20.0, False), ("t", 5.0, True)], "series_id string, x double, train boolean"
    )
    fit = M.fit_minmax(df, ["x"], where=F.col("train"))
    assert [r["x"] for r in M.minmax(df, fit, ["x"]).collect()] == [0.0, 1.0, 2.0, 0.5]
    by = ["series_id"]
    fit = M.fit_standard(df, ["x"], where=F.col("train"), by=by)
    scaled = M.standardise(df, fit, ["x"], by)
    assert sorted(r["x"] for r in scaled.collect()) == [-1.0, 0.0, 1.0, 3.0]
    back = M.standardise_inverse(scaled, fit, {"x": "x"}, by)
    assert sorted(r["x"] for r in back.collect()) == [0.0, 5.0, 10.0, 20.0]


def test_log_demean_is_invertible(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", None), ("t", float("nan")), ("t", 3.0)], "series_id string, value double")
    scaled = M.log_demean(df, M.fit_log_mean(df), name="z")
    assert {r["series_id"]: r["m"] for r in scaled.groupBy("series_id").agg(F.sum("z").alias("m")).collect()} == pytest.approx({"s": 0, "t": 0})
    back = [r["v"] for r in M.log_demean_inverse(scaled, "z", name="v").collect()]
    assert sorted(back) == pytest.approx([0.0, 0.0, 1.0, 3.0])


def test_fold_summary_and_warmup(spark):
    scores = spark.createDataFrame([("m", 1.0), ("m", 3.0)], "model string, rmse double")
    assert tuple(S.fold_summary(scores, ["rmse"]).first()) == ("m", "rmse", 2.0, 1.0)
    steps = spark.createDataFrame([(i, 0.0, 100.0 if i < 50 else 2.0) for i in range(60)], "step int, y double, p double")
    assert S.warmup_mse(steps, "y", "p").first()["mse"] == 4.0
