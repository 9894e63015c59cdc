"""Edge rules on small tables, with results worked out by hand or by numpy."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsynth import expr, features, gate, impute, metrics, privacy, report, sample, schema
from tabsynth.nearest import nearest_rows
from tabsynth.ordered import number_within, running_sums
from tabsynth.tiles import kernel_mean


def test_names_and_types(spark):
    df = spark.createDataFrame([(1.0, "a", True, 2)], "` Load (kN)` double, `_x_` string, ok boolean, n int")
    assert schema.sanitize_columns(df).columns == ["Load__kN", "x", "ok", "n"]
    with pytest.raises(ValueError):
        schema.sanitize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    assert schema.infer_schema(df) == {" Load (kN)": "numerical", "_x_": "categorical", "ok": "categorical", "n": "numerical"}
    assert schema.align_schema(df, {"n": "categorical", "gone": "numerical"}, {"_x_": "numerical"}) == {" Load (kN)": "numerical", "_x_": "numerical", "ok": "categorical", "n": "categorical"}


def test_keys_and_schema_file(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    with pytest.raises(ValueError):
        schema.validate_table(df, {"id": "primary_key"})
    with pytest.raises(ValueError):
        schema.validate_table(df, {"other": "numerical"})
    schema.save_schema({"a": "numerical"}, f"{tmp_path}/s.json")
    assert schema.load_schema(f"{tmp_path}/s.json") == {"a": "numerical"}


def test_nan_is_null(spark):
    df = schema.nan_to_null(spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "a double"))
    assert df.agg(F.max("a"), F.count("a")).first() == (2.0, 1)


def test_formulas(spark):
    df = spark.createDataFrame([(6.0, 0.0), (7.0, -3.0), (5.0, 2.0), (0.0, 0.0)], "a double, b double")
    out = expr.add_formulas(df, {"a": "0/1", "m": "c0 % c1", "k": "0.001", "twice": "c0 * 2.0", "bad": "c9 + 1.0", "worse": "open('x')"})
    rows = [tuple(r) for r in out.select("a", "m", "k", "twice").collect()]
    assert rows[0][0] == math.inf and math.isnan(rows[3][0]) and math.isnan(rows[0][1])
    assert rows[1][:2] == (-7 / 3, -2.0) and rows[2][:2] == (2.5, 1.0)
    assert [r[2] for r in rows] == [0.001] * 4 and [r[3] for r in rows] == [12.0, 14.0, 10.0, 0.0]
    assert "bad" not in out.columns and "worse" not in out.columns


def test_constraints(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, None, "y"), (3, 5.0, None)], "a int, b double, s string")
    keep = lambda *c: [r.a for r in expr.drop_violators(df, list(c)).orderBy("a").collect()]
    assert keep("c1 > 1") == [1, 3]
    assert keep("c1 != 2") == [2, 3]
    assert keep("not c1 > 1") == [2]
    assert keep("1 < c0 <= 3 and c2 != 'y'") == [3]
    assert keep("c2 in ['x', 'y']") == [1, 2] and keep("c2 not in ['x']") == [2, 3]
    assert keep("~(c0 == 1) | (c1 == 2)") == [1, 2, 3]
    assert keep("c0 > 1 & c1 > 4") == [3] and keep("c0 > 2 | c1 < 3") == [1, 3] and keep("c2 == 'a & b' | c0 == 2") == [2]
    zeros = spark.createDataFrame([(1, 0.0, 0.0), (2, 6.0, 2.0), (3, 1.0, 0.0), (4, float("nan"), 1.0)], "a int, x double, y double")
    kept = lambda c: [r.a for r in expr.drop_violators(zeros, [c]).orderBy("a").collect()]
    assert kept("c1 / c2 > 1") == [2, 3] and kept("c1 / c2 == c1 / c2") == [2, 3] and kept("c1 / c2 != 3") == [1, 3, 4] and kept("c1 < 100") == [1, 2, 3]
    assert keep("c0 ==", "exec('1')", "c7 > 1", "c0 > 1") == [2, 3]
    assert expr.auto_bounds(df) == ["c0 >= 1", "c0 <= 3", "c1 >= 2.0", "c1 <= 5.0"]
    assert expr.violation_rate(df, ["c1 > 1"]).first()[0] == pytest.approx(1 / 3)
    assert expr.violation_rate(df.limit(0), ["c1 > 1"]).first()[0] is None
    assert {r.constraint: r.violated for r in expr.violations_by_constraint(df, ["c1 > 1", "c0 < 3"]).collect()} == {"c1 > 1": 1, "c0 < 3": 1}


def test_gate(spark):
    rows = spark.createDataFrame([(0.9, 0.0, 1), (0.9, 0.5, 2), (float("nan"), 0.0, 3)], "Marginal double, violation_rate double, i int")
    out = {r.i: (r.passed, r.failures) for r in gate.threshold_gate(rows, {"Marginal": 0.7, "violation_rate": 0.1}).collect()}
    assert out == {1: (True, []), 2: (False, ["violation_rate"]), 3: (False, ["Marginal"])}
    assert not gate.threshold_gate(rows, {"cov_score": 0.1}).first()["passed"]
    assert gate.next_batch(100, 0.5, 10_000, gate.Settings()) == 500 and gate.next_batch(9_000, 0.5, 10_000, gate.Settings()) == 10_000
    assert gate.fold_target(80, 100, 500) == 400 and gate.target_rows(3) == 500


def test_self_comparison(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), "ab"[i % 2]) for i in range(60)], "k long, x double, y double, s string")
    meta = {"x": "numerical", "y": "numerical", "s": "categorical"}
    row = gate.compare_tables(df, df, meta, ["c1 >= 0"], ("k", "k"), ["Marginal", "boundary_score", "corr_score", "cov_score", "violation_rate", "DCR_mean", "DCR_min", "wd_score", "mmd_score", "fd_score"]).first().asDict()
    assert row == pytest.approx({"Marginal": 1, "boundary_score": 1, "corr_score": 1, "cov_score": 1, "violation_rate": 0, "DCR_mean": 0, "DCR_min": 0, "wd_score": 0, "mmd_score": 0, "fd_score": 0}, abs=1e-9)


def test_degenerate_columns(spark):
    a = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, b double, c double")
    meta = dict.fromkeys("abc", "numerical")
    assert metrics.correlation_similarity(a, a, meta).first()[0] == 1.0
    assert metrics.covariance_similarity(a, a, meta).first()[0] == pytest.approx(1.0)
    s = spark.createDataFrame([("x",)], "s string")
    none = s.select(F.lit(None).cast("string").alias("s"))
    assert metrics.tv_complement(s, none, ["s"]).first()["value"] == 0.5
    both = {r["column"]: r["value"] for r in metrics.marginals(a, a, meta).collect()}
    assert both["a"] == both["b"] == 1.0 and "c" not in both


def test_ecdf_distances_equal_numpy(spark):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=300).round(1), rnd.normal(0.4, 1.2, 200).round(1)
    frame = lambda v: spark.createDataFrame([(float(i),) for i in v], "v double")
    grid = np.unique(np.concatenate([x, y]))
    fx, fy = (np.searchsorted(np.sort(v), grid, "right") / len(v) for v in (x, y))
    assert metrics.ks_complement(frame(x), frame(y), ["v"]).first()["value"] == pytest.approx(1 - np.abs(fx - fy).max())
    assert metrics.wasserstein(frame(x), frame(y), {"v": "numerical"}).first()[0] == pytest.approx((np.abs(fx - fy)[:-1] * np.diff(grid)).sum())


def test_running_sums_and_numbers(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "id as v", "1 as one")
    got = running_sums(df, ["g"], "v", {"n": "one"}, "nxt").where("n != (v - g) / 3 + 1 or (nxt != v + 3 and nxt is not null)")
    assert got.count() == 0
    df = spark.range(1000).selectExpr("id", "id % 2 as g", "(id * 7919) % 4294967296 as h")
    one, two = (sorted(tuple(r) for r in number_within(df, ["g"], ["h", "id"], spread=s).collect()) for s in ("h", None))
    assert one == two


def test_deciles(spark):
    df = spark.createDataFrame([(i, float(min(i, 23))) for i in range(25)], "k int, x double")
    got = [r["x"] for r in sample.rank_deciles(df, ["x"], ["k"]).collect()]
    assert [got.count(b) for b in range(10)] == [3, 2, 3, 2, 3, 2, 2, 3, 2, 3]


def test_oversampling_and_folds(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b" if i < 20 else None) for i in range(25)], "k int, y string")
    got = sample.oversample(df, "y", ["k"]).collect()
    assert sorted([r.y for r in got]) == ["a"] * 17 + ["b"] * 17 and all((r.k < 3) == (r.y == "a") for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, sample.oversample(df.repartition(3), "y", ["k"]).collect()))
    assert sample.oversample(df, "none", ["k"]).count() == 25
    assert sample.stratified_kfold(df, "y", 5, 1, ["k"]).count() == 0
    folds = sample.stratified_kfold(df, "y", 3, 2, ["k"])
    assert folds.groupBy("repeat", "fold", "y").count().where("y = 'a'").select("count").distinct().collect()[0][0] == 1
    assert sample.kfold(df.limit(2), 3, 1, ["k"]).count() == 0
    one = sample.stratified_kfold(df.where("y = 'b'"), "y", 3, 1, ["k"])
    assert one.count() == 0


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "b", None), (2, None, "a", None), (3, 4.0, None, None), (4, 7.0, "a", None), (5, 2.0, "b", None)], "k int, x double, s string, t string")
    a = impute.impute_simple(df, keep=["k"])[0].orderBy("k").collect()
    assert [r.x for r in a] == [1.0, 3.0, 4.0, 7.0, 2.0] and a[2].s == "a" and a[0].t is None
    assert impute.impute_simple(df, keep=["k"], missing="Missing")[0].first()["t"] == "Missing"
    marked = impute.add_missing_indicators(df)
    assert marked.columns == ["k", "x", "s", "t", "missingindicator_x", "missingindicator_s", "missingindicator_t"]
    meta = {"x": "numerical", "s": "categorical", "t": "categorical"}
    repaired = impute.impute_categorical_rf(df, meta=meta, trees=3)[0]
    assert repaired.where("s is null").count() == 0 and repaired.select("t").distinct().collect()[0][0] == "Missing"
    one = spark.createDataFrame([("x", 1.0), (None, 2.0)], "s string, v double")
    assert [r.s for r in impute.impute_categorical_rf(one, meta={"s": "categorical", "v": "numerical"})[0].collect()] == ["x", "x"]


@pytest.mark.parametrize("most", [1000, 0])
def test_knn_imputation_equals_brute_force(spark, most):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(40, 3)).round(2)
    x[rnd.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k long, a double, b double, c double")
    got = np.array([tuple(r)[1:] for r in impute.impute_knn(df, meta=dict.fromkeys("abc", "numerical"), key="k", k=3, most_spaces=most)[0].orderBy("k").collect()])
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        d = []
        for o in range(40):
            both = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if not np.isnan(x[o, j]) and both.any():
                d.append((math.sqrt(((x[i] - x[o])[both] ** 2).sum() * 3 / both.sum()), o))
        near = [x[o, j] for _, o in sorted(d)[:3]]
        want[i, j] = np.mean(near) if near else np.nanmean(x[:, j])
    assert np.allclose(got, want)


def test_iterative_imputation_recovers_a_line(spark):
    df = spark.createDataFrame([(float(i), None if i % 5 == 0 else 3.0 * i + 2) for i in range(1, 41)], "a double, b double")
    got = impute.impute_iterative(df, meta={"a": "numerical", "b": "numerical"})[0].collect()
    assert all(abs(r.b - (3 * r.a + 2)) < 0.05 for r in got)


def test_codes_and_types(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    coded, lists = features.encode_categories(df, ["s"])
    assert [r.s for r in coded.collect()] == [1.0, 0.0, None]
    unseen = spark.createDataFrame([("z",), ("a",)], "s string")
    assert [r.s for r in features.encode_categories(unseen, ["s"], lists)[0].collect()] == [None, 0.0]
    assert [r.s for r in features.decode_categories(spark.createDataFrame([(0.5,), (1.5,), (-3.0,), (None,)], "s double"), lists).collect()] == ["a", "b", "a", None]
    a, b = features.one_hot(df, unseen, cols=["s"])
    assert a.columns == b.columns == ["s_a", "s_b"] and [tuple(r) for r in b.collect()] == [(0, 0), (1, 0)]
    t = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5, 600000), timedelta(days=1, seconds=2.5), True, 7, 2.5), (None, None, None, None, None)], "ts timestamp, iv interval day to second, f boolean, n int, d double")
    n = features.to_numeric_types(t)
    assert n.first()["iv"] == 86402.5 and n.first()["f"] == 1
    assert [tuple(r) for r in features.from_numeric_types(n, t.schema).collect()] == [tuple(r) for r in t.collect()]
    half = spark.createDataFrame([(2.5,), (3.5,)], "n double")
    assert [r.n for r in features.restore_types(half, spark.createDataFrame([], "n int").schema).collect()] == [2, 4]


def test_tiles_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(70, 3)), rnd.normal(size=(50, 3))
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, x double, y double, z double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    import tabsynth.tiles as tiles

    tiles_block, tiles.BLOCK = tiles.BLOCK, 16
    try:
        got = {r.key: r.distances for r in nearest_rows(frame(a), frame(b), ["x", "y", "z"], "k", "k", 2).collect()}
        assert np.allclose([got[i] for i in range(70)], np.sort(d, 1)[:, :2])
        assert kernel_mean(frame(a), frame(b), ["x", "y", "z"], "k", "k", 0.5) == pytest.approx(np.exp(-0.5 * d**2).mean())
    finally:
        tiles.BLOCK = tiles_block
    exact = privacy.mmd_rbf(frame(a), frame(b), dict.fromkeys("xyz", "numerical"), "k", "k").first()[0]
    rough = privacy.mmd_features(frame(a), frame(b), dict.fromkeys("xyz", "numerical"), features=400).first()[0]
    assert abs(exact - rough) < 0.02


def test_outliers(spark):
    rnd = np.random.default_rng(2)
    real = spark.createDataFrame([tuple(map(float, r)) for r in rnd.normal(size=(50, 2))], "a double, b double")
    syn = spark.createDataFrame([(0.0, 0.1), (90.0, 0.0), (None, 0.0)], "a double, b double")
    meta = {"a": "numerical", "b": "numerical"}
    assert [tuple(r) for r in privacy.drop_covariance_outliers(real, syn, meta).collect()] == [(0.0, 0.1)]
    assert privacy.drop_covariance_outliers(real, syn, {"a": "numerical"}).count() == 3
    assert privacy.chi_square_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert privacy.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-4)


def test_scores(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int").withColumn("g", F.lit(0))
    r = metrics.classification_scores(pred, ["g"]).first()
    assert (r.accuracy, r.balanced_accuracy, r.f1_macro) == pytest.approx((0.5, (0.5 + 1 + 0) / 3, (2 / 3 + 0.5 + 0) / 3))
    auc = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.4), (False, 0.1)], "positive boolean, score double").withColumn("g", F.lit(0))
    assert metrics.roc_auc(auc, ["g"]).first()["roc_auc"] == pytest.approx(0.875)
    assert metrics.roc_auc(auc.where("positive"), ["g"]).first()["roc_auc"] is None
    r = report.summarize_regression(spark.createDataFrame([("d", "r", 1, 1.0, 1.0, 0.5, 2.0)], "Dataset string, Regressor string, Fold int, mae double, rmse double, r2 double, mape double"), ["Dataset", "Regressor"]).first()
    assert r.mae_mean == 1.0 and r.mae_std is None and r.folds == 1


def test_medians_and_modes_of_large_tables(spark, monkeypatch):
    rows = [(i, float(i * 7 % 31) if i % 4 else None, i % 5, "xyzz"[i % 4] if i % 3 else None, i % 2 == 0, None) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, a double, b int, s string, f boolean, gone double")
    small = impute.fill_values(df, ["a", "b", "s", "f", "gone"])
    monkeypatch.setattr(impute, "BUFFER_ROWS", 10)
    assert impute.fill_values(df, ["a", "b", "s", "f", "gone"]) == small and small["gone"] is None
    assert small["a"] == float(np.median([r[1] for r in rows if r[1] is not None]))


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    from tabsynth import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    df = spark.range(1000).selectExpr("id % 3 as g", "cast((id * 7919) % 1000 as double) as v", "1 as one", "abs(xxhash64(id)) % 4294967296 as h", "id").cache()
    assert ordered.range_count(df) == 25
    got = {(r.g, r.v): (r.n, r.nxt, r.all) for r in running_sums(df.where("v >= 0"), ["g"], "v", {"n": "one"}, "nxt", {"all": "one"}).collect()}
    for g in range(3):
        values = sorted(r.v for r in df.where(f"g = {g}").collect())
        assert [got[g, v] for v in values] == [(i + 1, values[i + 1] if i + 1 < len(values) else None, len(values)) for i in range(len(values))]
    one, two = (sorted(tuple(r) for r in number_within(df, ["g"], ["h", "id"], spread=s).collect()) for s in ("h", None))
    assert one == two
    with pytest.raises(ValueError):
        number_within(df, [], ["h"])
    rising = running_sums(df, ["g"], "v", {"n": "one"})
    assert "SinglePartition" not in rising._jdf.queryExecution().executedPlan().toString()


def test_iterative_imputation_by_patterns_equals_rounds(spark):
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(150, 4)) @ rnd.normal(size=(4, 4)) + [5, -3, 100, 0]
    x[rnd.random(x.shape) < 0.15] = np.nan
    cols = "abcd"
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k long, a double, b double, c double, d double")
    train, test = df.where("k < 110"), df.where("k >= 110")
    meta = dict.fromkeys(cols, "numerical")
    one = impute.impute_iterative(train, test, meta=meta)
    two = impute.impute_iterative(train, test, meta=meta, most_patterns=1)
    for a, b in zip(one, two, strict=True):
        a, b = (np.array([tuple(r) for r in df.orderBy("k").collect()], float) for df in (a, b))
        assert not np.isnan(a).any()
        assert np.allclose(a, b, rtol=1e-6)


def test_wide_moments_equal_pairs(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 30)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rnd.normal(size=300) / 9
    x[rnd.random(x.shape) < 0.1] = np.nan
    x[:, 5] = 7.0  # a constant
    x[:, 6] = np.nan
    cols = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols)).repartition(5)
    mean, cov, corr = metrics.moment_matrices(df, cols)
    for i in range(30):
        for j in range(30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.cov(x[both, i], x[both, j])[0, 1] if both.sum() > 1 else 0.0
            assert cov[i, j] == pytest.approx(want, abs=1e-6)
            fixed = {5, 6} & {i, j}
            assert corr[i, j] == pytest.approx(0.0 if fixed else want / (x[both, i].std(ddof=1) * x[both, j].std(ddof=1)), abs=1e-6)
    assert np.isnan(mean[6])
    assert mean[0] == pytest.approx(np.nanmean(x[:, 0]))
    small = [metrics.moment_matrices(df.select(cols[:8]), cols[:8]), tuple(m[..., :8] for m in (mean, cov[:8], corr[:8]))]
    for a, b in zip(*small, strict=True):
        assert np.allclose(a, b, atol=1e-6, equal_nan=True)


def test_ranks_of_a_hot_value_are_cut_into_ranges(spark, monkeypatch):
    from tabsynth import ordered

    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rows = [(i, 0.0 if i % 10 else float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(4)
    got = ordered.ranked(df, ["x", "k"], "rn")
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["k"]: r["rn"] for r in got.collect()} == want
    assert max(r["count"] for r in got.groupBy(F.floor((F.col("rn") - 1) / 1000)).count().collect()) == 1000
    deciles = sample.rank_deciles(df, ["x"], ["k"])
    assert {r["x"]: r["count"] for r in deciles.groupBy("x").count().collect()} == dict.fromkeys(range(10), 100)
