"""Generators, gates and validation runs, by invariants."""

import pytest
from pyspark.sql import functions as F

from tabsynth import cv, detect, gate, pipeline, synth
from tabsynth.expr import auto_bounds

META = {"a": "numerical", "b": "numerical", "s": "categorical"}


@pytest.fixture(scope="module")
def real(spark):
    rows = [(i, float(i % 10), 2.0 * (i % 10) + (i % 3), "xyz"[i % 3] if i % 13 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, a double, b double, s string")
    return df.cache()


def test_cart_draws_donors(spark, real):
    body = real.drop("k")
    fitted = synth.CartSynthesizer(META, smooth=False).fit(body)
    one, same, other = (sorted(map(tuple, fitted.sample(200, s).collect()), key=str) for s in (1, 1, 2))
    assert len(one) == 200 and one == same != other
    values = [{r[i] for r in body.collect()} for i in range(3)]
    assert all(r[i] in values[i] for r in one for i in range(3))
    gap = [abs(r[1] - 2 * r[0] - 1) for r in one]
    assert sum(gap) / len(gap) < 3


def test_smoothing_stays_in_range(spark, real):
    lo, hi = 0.0, 9.0
    s = synth.smoothing(real, "a")
    out = synth.smooth_column(real.select("k", "a"), "a", lo, hi, 1, ["k"]).agg(F.min("a"), F.max("a"), F.count_distinct("a")).first()
    assert lo <= out[0] and out[1] <= hi + s["bandwidth"] and out[2] > 50
    fixed = spark.createDataFrame([(i, 5.0 if i % 10 else float(i)) for i in range(100)], "k long, a double")
    assert synth.smoothing(fixed, "a")["mode"] == 5.0
    top = spark.createDataFrame([(i, float(i) if i < 59 else 1e5) for i in range(60)], "k long, a double")
    assert synth.smoothing(top, "a")["top"] == 1e5
    repeated = spark.createDataFrame([(i, float(i) if i < 58 else 1e5) for i in range(60)], "k long, a double")
    assert synth.smoothing(repeated, "a")["top"] is None  # the second largest value is the largest again
    constant = synth.smoothing(spark.createDataFrame([(1, 2.0)], "k long, a double"), "a")
    assert constant["bandwidth"] is None


def test_copula_keeps_margins(spark, real):
    out = synth.synthesize_copula(real.drop("k"), 2000, META, seed=3)
    assert out.count() == 2000 and out.schema == real.drop("k").schema
    row = gate.compare_tables(real.drop("k"), out, META, wanted=["Marginal", "boundary_score", "corr_score"]).first()
    assert row.Marginal > 0.85 and row.boundary_score > 0.999 and row.corr_score > 0.9


def test_generate_until(spark, real, tmp_path):
    body = real.drop("k")
    make = lambda df, n, seed: spark.range(n).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 20).cast("double").alias("b"), F.lit("x").alias("s"))
    got = gate.generate_until(make, body, body, 700, META, ["c0 >= 5"], f"{tmp_path}/b")
    assert got.count() == 700 and got.where("a < 5").count() == 0
    with pytest.raises(RuntimeError):
        gate.generate_until(make, body, body, 700, META, ["c0 > 50"], f"{tmp_path}/c", settings=gate.Settings(max_failed=3))
    with pytest.raises(RuntimeError):
        gate.generate_until(make, body, body, 700, META, [], f"{tmp_path}/d", {"boundary_score": 1.1}, settings=gate.Settings(max_failed=2))
    assert set(gate.run_generators({"good": make, "bad": lambda *a: make(*a).limit(0)}, body, body, 500, META, auto_bounds(body), f"{tmp_path}/e", retries=1)) == {"good"}


def test_an_empty_batch_ends_after_failures_of_either_kind(spark, real, tmp_path):
    body, calls = real.drop("k"), []

    def make(df, n, seed):  # four batches fail the gate, the next one is empty
        calls.append(n)
        return df.limit(0) if len(calls) == 5 else df.withColumn("a", F.col("a") + 1000)

    with pytest.raises(RuntimeError):
        gate.generate_until(make, body, body, 100, META, [], f"{tmp_path}/f", {"boundary_score": 0.99}, settings=gate.Settings(max_failed=12))
    assert len(calls) == 5


def test_model_metrics(spark, real):
    same = detect.propensity_score(real, real, META, ["k"]).first()[0]
    far = detect.propensity_score(real, real.withColumn("a", F.col("a") + 100), META, ["k"]).first()[0]
    assert far < 0.1 < same
    one = detect.log_cluster(real, real, {"a": "numerical", "b": "numerical"}, k=1).first()[0]
    import numpy as np

    x = np.array([(r.a, r.b) for r in real.collect()])
    cov = np.cov(x.T, bias=True)
    d = x - x.mean(0)
    want = (-0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)) + 2 * np.log(2 * np.pi))).mean()
    assert one == pytest.approx(want, rel=1e-3)
    out, shares = detect.pca_projection(real, real, {"a": "numerical", "b": "numerical"})
    assert out.count() == 240 and sum(shares) == pytest.approx(1)


def test_mixture_of_three(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    middle, size = np.array([[0.0, 0.0], [30.0, 5.0], [-20.0, 40.0]]), [200, 300, 500]
    parts = [rnd.normal(size=(n, 2)) @ np.array([[1.0, 0.4], [0.0, 1.5]]) + m for n, m in zip(size, middle, strict=True)]
    frame = lambda x: spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    asked = np.concatenate([p[:40] + 0.5 for p in parts])
    meta = {"a": "numerical", "b": "numerical"}
    got = detect.log_cluster(frame(np.concatenate(parts)), frame(asked), meta).first()[0]
    # far apart, each part is one Gaussian of the fitted mixture
    each = []
    for p in parts:
        cov, d = np.cov(p.T, bias=True), asked - p.mean(0)
        each.append(np.log(len(p) / 1000) - 0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)) + 2 * np.log(2 * np.pi)))
    assert got == pytest.approx(np.logaddexp.reduce(each).mean(), rel=1e-2)


@pytest.mark.parametrize("method", ["iter", "knn"])
def test_fold_imputation_fills_all_but_the_target(spark, real, method):
    from tabsynth import impute

    gaps = real.withColumn("b", F.when(F.col("k") % 7 != 0, F.col("b"))).withColumn("a", F.when(F.col("k") % 11 != 0, F.col("a")))
    train, test = impute.impute_fold(gaps.where("k % 4 != 0"), gaps.where("k % 4 = 0"), META | {"k": "primary_key"}, method, "a", "k")
    whole = {r["k"]: (r["b"], r["s"]) for r in real.collect()}
    for df in (train, test):
        assert df.where("b is null or s is null").count() == 0
        assert df.where("a is null").count() == gaps.where("a is null").join(df.select("k"), "k").count()
        known = [r for r in df.collect() if r["k"] % 7]
        assert all(r["b"] == whole[r["k"]][0] and whole[r["k"]][1] in (None, r["s"]) for r in known)
    # the linear relation to a column that is known is found
    if method == "iter":
        near = [abs(r["b"] - whole[r["k"]][0]) for r in train.collect() if r["k"] % 7 == 0]
        assert len(near) > 5


def test_cross_validation(spark, real, tmp_path):
    meta = META | {"k": "primary_key"}
    summary, folds = cv.augmented_classification_cv(real, "s", meta, "k", generator=synth.copula_generator(META), path=f"{tmp_path}/c", splits=2, repeats=1, trees=2)
    assert folds.count() == 4 and summary.count() == 2
    assert folds.where("accuracy between 0 and 1").count() == 4
    summary, folds = cv.regression_cv(real, "b", "k", splits=2, repeats=1, trees=2, boosted_trees=3)
    assert folds.count() == 4 and summary.where("r2_mean > 0.5").count() == 2


def test_whole_run(spark, real, tmp_path):
    real.select("k", "a", "b", "s").write.option("header", True).csv(f"{tmp_path}/in")
    config = pipeline.Config(f"{tmp_path}/in", f"{tmp_path}/out", imputations=("mi",), generators=("GaussianCopula",), thresholds={"Marginal": 0.5}, rows=500, wanted=["Marginal", "corr_score", "DCR_mean"], formulas={"r": "1/0"})
    reports = pipeline.run_pipeline(spark, config)
    assert reports["metrics"].count() == 1
    back = spark.read.parquet(f"{tmp_path}/out/datasets")
    assert {(r.generator, r["count"]) for r in back.groupBy("generator").count().collect()} == {("real", 120), ("GaussianCopula", 500)}
    assert "r" in back.columns and not [c for c in back.columns if c.startswith("missingindicator")]


def test_registered_queries_use_the_operators_defaults(spark, monkeypatch):
    from tabsynth import catalog

    called = {}
    for owner, name in [(catalog, "augmented_classification_cv"), (catalog, "augmented_regression_cv"), (catalog, "regression_cv"), (catalog.impute, "impute_categorical_rf")]:
        monkeypatch.setattr(owner, name, lambda df, *_, _name=name, **options: called.update({_name: options}) or [df, df])
    for query in (catalog.cv1_augmented_classification, catalog.cv2_augmented_regression, catalog.cv3_regression, catalog.im3_categorical_forest):
        query(spark, "/root/testdata/sf0.001")
    assert len(called) == 4 and not {"splits", "repeats", "trees", "boosted_trees"} & {k for o in called.values() for k in o}


def test_late_rows_count(spark):
    late = spark.range(0, 1_000_200, 1, 4).select(F.when(F.col("id") < 1_000_000, 1.0).otherwise(9.0).alias("a"))
    fitted = synth.CartSynthesizer({"a": "numerical"}).fit(late)
    assert fitted.range["a"] == (1.0, 9.0) and fitted.donors["a"].where("value = 9").count() == 200
    rows = spark.range(0, 200_600, 1, 4).selectExpr("case when id < 200000 then 0D else 50D end x", "case when id < 100000 then 'b' when id < 200000 then 'c' when id < 200599 then 'late' end s")
    from tabsynth import impute

    repaired = impute.impute_categorical_rf(rows, meta={"x": "numerical", "s": "categorical"}, trees=3)[0]
    assert repaired.where("s = 'late'").count() == 600
